"""Importing this module registers every query."""

from importlib import import_module

from quillmeter.plans.registry import ORACLES, QUERIES

for _name in (
    "usage_queries",
    "ledger_queries",
    "quota_queries",
    "billing_queries",
    "site_queries",
    "profile_queries",
    "layout_queries",
    "cell_queries",
    "qa_queries",
    "source_queries",
):
    import_module(f"quillmeter.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
