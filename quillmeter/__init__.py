"""Usage, billing, site and document analytics as PySpark DataFrame operators."""
