"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.llm.common import materialised


def _minima(edges: DataFrame) -> DataFrame:
    """Per first node the least of itself and its neighbours; combines before the shuffle."""
    return edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    pair = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.select(F.explode(pair).alias("e")).select("e.a", "e.b")


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node that has a link to another, with the least node reachable from it.

    ``links`` has one row per undirected link, any orientation, repeats and loops allowed; rows with a null end are
    no links. A node with many neighbours is a hot key of joins only, which Spark splits, never of a window or a
    collected list. Each round is written to the shared folder; the number of rounds grows with the logarithm of
    the longest chain.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = materialised(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _signature(edges)
    while before[0]:
        both = _both(edges)
        # large star: every larger neighbour of a node is tied to the least node around it
        large = both.join(_minima(both), "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # small star: a node and its smaller neighbours are tied to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        ties = large.join(least, "a")
        small = ties.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialised(small.select("e.a", "e.b").where("a <> b").distinct(), "links")
        after = _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
