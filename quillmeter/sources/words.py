"""The word table: one row per word with its box, derived from running text or read as given.

Layout rule: lines wrap after ``WIDTH`` characters, a page holds ``LINES`` wrapped lines, a character
is 6 wide and a line 12 high, so a page is 540 x 600. The first line of a document is a heading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

WIDTH, LINES, CHAR_W, LINE_H, FONT, HEADING_FONT = 90, 50, 6.0, 12.0, 10.0, 16.0
PAGE_W, PAGE_H = WIDTH * CHAR_W, LINES * LINE_H
#: Characters of text per partition of the word table. A word row takes about thirty times its text in a sort.
PART_CHARS = 2_000_000


def partitions_for(docs: DataFrame, text: str = "text") -> int:
    """So many partitions that each holds about ``PART_CHARS`` characters of text, counted in one pass over the texts.

    Sizes of shuffled lines say little about the words that a task makes of them; an exchange that Spark coalesces by
    size leaves so many words to a task that its sorts spill.
    """
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-chars // PART_CHARS))


def words_from_text(docs: DataFrame, doc: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Words of whole texts. One exchange of the texts by document serves both running sums and, because pages
    belong to one document, every later window by (document, page)."""
    parts = parts or partitions_for(docs, text)
    before_line = W.partitionBy(doc).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    before_word = W.partitionBy(doc, "line_no").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)

    def zero(c):
        return F.coalesce(c, F.lit(0)).cast("long")

    lines = docs.select(doc, text).repartition(parts, doc).select(doc, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumns(
        {
            "first_row": zero(F.sum(F.greatest(F.lit(1), F.ceil(F.length("line") / WIDTH))).over(before_line)),
            "first_char": zero(F.sum(F.length("line") + 1).over(before_line)),
        }
    )
    words = lines.select(
        doc, "line_no", "first_row", "first_char", F.posexplode(F.split("line", " ")).alias("pos", "text")
    ).withColumn("off", zero(F.sum(F.length("text") + 1).over(before_word)))
    row = F.col("first_row") + F.floor(F.col("off") / WIDTH)
    heading = F.col("line_no") == 0
    x0 = (F.col("off") % WIDTH) * F.lit(CHAR_W)
    y0 = F.col("__row") % LINES * F.lit(LINE_H)
    return (
        words.where(F.length("text") > 0)
        .withColumn("__row", row)
        .select(
            doc,
            (F.floor(F.col("__row") / LINES) + 1).cast("long").alias("page"),
            (F.col("first_char") + F.col("off")).alias("word_id"),
            "text",
            x0.alias("x0"),
            y0.alias("y0"),
            (x0 + F.length("text") * F.lit(CHAR_W)).alias("x1"),
            (y0 + F.when(heading, F.lit(HEADING_FONT)).otherwise(F.lit(FONT))).alias("y1"),
            F.when(heading, F.lit(HEADING_FONT)).otherwise(F.lit(FONT)).alias("font_size"),
            heading.alias("bold"),
            ((F.lit(50) + (F.col("first_char") + F.col("off")) % 50) / F.lit(100.0)).alias("confidence"),
        )
    )
