"""Page-set operations (survey group M) on rows (doc_id, page_no, ...); page_no counts from 1.

Numbers are computed from page counts and list positions, not by sorting a whole document in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillmeter.operators.scans import running_total


def merge_documents(pages: DataFrame, members: DataFrame) -> DataFrame:
    """M1: pages of the documents of a target in list order. members(target, doc_id, seq), seq a whole number.

    The offset of a document is the running page count of the documents before it in its target, summed in two
    levels by stretches of seq, so that no task sees all documents of a target.
    """
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n"))
    sized = members.join(counts, "doc_id")
    stretch = F.floor(F.col("seq") / 4096).cast("long")
    placed = running_total(sized, ["target"], ["seq"], {"__sum": F.col("__n")}, stretch).withColumn("__off", F.col("__sum") - F.col("__n"))
    return pages.join(placed.select("target", "doc_id", "__off"), "doc_id").withColumn("new_page", F.col("__off") + F.col("page_no")).drop("__off")


def split_by_ranges(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """M2: ranges(doc_id, part, first, last) expanded to page numbers and joined by equality."""
    wanted = ranges.where(F.col("first") <= F.col("last")).select(
        "doc_id", "part", "first", F.explode(F.sequence("first", "last")).alias("page_no")
    )
    return pages.join(wanted, ["doc_id", "page_no"]).withColumn("new_page", F.col("page_no") - F.col("first") + 1).drop("first")


def split_every(pages: DataFrame, n: int) -> DataFrame:
    """M3: parts of n pages."""
    zero = F.col("page_no") - 1
    return pages.withColumns({"part": F.floor(zero / n).cast("long"), "new_page": (zero % n + 1).cast("long")})


def reorder(pages: DataFrame, orders: DataFrame) -> DataFrame:
    """M4: orders(doc_id, page_order); a document whose list has another length than its pages keeps none."""
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n"))
    good = orders.join(counts, "doc_id").where(F.size("page_order") == F.col("__n"))
    return extract(pages, good.select("doc_id", F.col("page_order").alias("page_list")))


def rejected_orders(pages: DataFrame, orders: DataFrame) -> DataFrame:
    """M4: documents whose list length differs from their page count."""
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    return orders.join(counts, "doc_id").select("doc_id", "pages", F.size("page_order").cast("long").alias("listed")).where("pages <> listed")


def extract(pages: DataFrame, lists: DataFrame) -> DataFrame:
    """M5: the listed pages in list order. lists(doc_id, page_list)."""
    wanted = lists.select("doc_id", F.posexplode("page_list").alias("__i", "page_no"))
    return pages.join(wanted, ["doc_id", "page_no"]).withColumn("new_page", (F.col("__i") + 1).cast("long")).drop("__i")


def delete(pages: DataFrame, lists: DataFrame) -> DataFrame:
    """M6: the listed pages vanish; a page moves up by the number of deleted pages before it."""
    gone = F.coalesce(F.array_distinct("page_list"), F.array().cast("array<bigint>"))
    return (
        pages.join(lists, "doc_id", "left").withColumn("__g", gone)
        .where(~F.array_contains("__g", F.col("page_no")))
        .withColumn("new_page", F.col("page_no") - F.size(F.filter("__g", lambda d: (d >= 1) & (d < F.col("page_no")))))
        .drop("__g", "page_list")
    )


def insert_blank(pages: DataFrame, inserts: DataFrame) -> DataFrame:
    """M7: one blank page after page ``after`` (0: in front; past the end or null: at the end).
    inserts(doc_id, after)."""
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n"))
    spots = inserts.join(counts, "doc_id").select("doc_id", F.least(F.coalesce("after", F.col("__n")), F.col("__n")).alias("__after"))
    moved = pages.join(spots, "doc_id", "left").withColumn(
        "new_page", F.col("page_no") + F.coalesce((F.col("page_no") > F.col("__after")).cast("long"), F.lit(0))
    ).drop("__after")
    blank = spots.select("doc_id", (F.col("__after") + 1).alias("new_page"))
    return moved.unionByName(blank, allowMissingColumns=True)


def rotate(pages: DataFrame, rotations: DataFrame) -> DataFrame:
    """M8: angles of a page add up, modulo 360. pages carry ``rotation``; rotations(doc_id, page_no, angle)."""
    turns = rotations.groupBy("doc_id", "page_no").agg(F.sum("angle").alias("__a"))
    return pages.join(turns, ["doc_id", "page_no"], "left").withColumn(
        "rotation", F.pmod(F.col("rotation") + F.coalesce("__a", F.lit(0)), F.lit(360)).cast("long")
    ).drop("__a")
