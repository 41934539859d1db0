"""The most similar text of the same page for each text, without comparing each with each.

Similarity is that of ``text_similarity``: equal 1, one contained in the other 0.8, else shared words over all words.
Three equality joins propose candidates; none misses a pair that scores enough:

* equal texts;
* texts whose word sets overlap enough share a word among the first ``n - ceil(t n) + 1`` words of both, in any fixed
  order of words. Long words come first, as they are rare; sizes must also fit;
* a text contained in another has all its pieces of five letters in it. Of each text one piece is looked for, the
  one with the least hash; only these pieces of a page are cut out of the longer texts. Texts of up to five letters are a
  piece themselves, so the first text that has it needs no comparison.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.functions.exprs import col
from quillmeter.session import settled

PIECE = 5


def bare(text: str | Column) -> Column:
    return F.lower(F.regexp_replace(col(text), r"^\s+|\s+$", ""))


def word_set(text: str | Column) -> Column:
    """Different words, the longest first."""
    words = F.array_distinct(F.filter(F.split(col(text), r"\s+"), lambda w: w != ""))
    return F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))), lambda s: s["w"])


def prefix(words: Column, least: float) -> Column:
    n = F.size(words)
    return F.slice(words, 1, F.greatest(F.lit(0), (n - F.ceil(n * F.lit(least) - 1e-9) + 1).cast("int")))


def own_piece(text: Column) -> Column:
    """The piece of a text that is looked for in others."""
    starts = F.sequence(F.lit(1), F.length(text) - PIECE + 1)
    cut = F.transform(starts, lambda i: F.substring(text, i, F.lit(PIECE)))
    pieces = F.transform(cut, lambda p: F.struct(F.xxhash64(p).alias("h"), p.alias("p")))
    return F.when(F.length(text) <= PIECE, text).otherwise(F.array_min(pieces)["p"])


def pieces_among(text: Column, wanted: Column) -> Column:
    """The ``wanted`` pieces, of one to ``PIECE`` letters, that occur in a text."""
    return F.filter(wanted, lambda p: text.contains(p))


def best_match(needles: DataFrame, hay: DataFrame, keys: Sequence[str], text: str, hay_text: str, order: str, floor: float) -> DataFrame:
    """(keys, text, order, score): for each different text the most similar ``hay`` row of its keys, above ``floor``.

    Texts are taken bare (lower case, trimmed) and empty ones match nothing; of equally similar rows the least ``order``
    wins. ``text`` in the result is bare. Texts of one key value are a bounded group (a page). The different texts of
    both sides, with their words and pieces, and the pieces found in texts are settled, as several joins read them.
    """
    keys = list(keys)
    x = needles.select(*keys, bare(text).alias("x")).where("x <> ''").distinct()
    y = hay.select(*keys, bare(hay_text).alias("y"), F.col(order).alias("o")).where("y <> ''").groupBy(*keys, "y").agg(F.min("o").alias("o"))
    x, y = (settled(t.withColumns({f"w{n}": word_set(n), "p": own_piece(F.col(n))})) for t, n in ((x, "x"), (y, "y")))
    wx, wy = x.drop("p"), y.drop("p")
    found = [x.select(*keys, "x").join(y.select(*keys, F.col("y").alias("x"), "o"), [*keys, "x"]).select(*keys, "x", "o", F.lit(1.0).alias("s"))]
    inside = lambda a, b: a.contains(b) | b.contains(a)

    px = wx.withColumn("w", F.explode(prefix(F.col("wx"), floor)))
    py = wy.withColumn("w", F.explode(prefix(F.col("wy"), floor)))
    nx, ny = F.size("wx"), F.size("wy")
    near = (F.least(nx, ny) >= F.greatest(nx, ny) * (floor - 1e-9)) & ~inside(F.col("x"), F.col("y"))
    shared = F.size(F.array_intersect("wx", "wy"))
    found.append(px.join(py, [*keys, "w"]).where(near).select(*keys, "x", "o", (shared / (nx + ny - shared)).alias("s")))

    def contained(small: DataFrame, s: str, large: DataFrame, b: str) -> DataFrame:
        """Pairs with text ``s`` of ``small`` inside text ``b`` of ``large``; short ones meet only the first such text."""
        cut, large = small.drop(f"w{s}"), large.drop("p", f"w{b}")
        wanted = cut.groupBy(*keys).agg(F.collect_set("p").alias("ps"))
        posted = settled(large.join(wanted, keys).withColumn("p", F.explode(pieces_among(F.col(b), F.col("ps")))).drop("ps"))
        short = F.length(s) <= PIECE
        if s == "x":  # the first row of the hay that has the piece
            first = posted.groupBy(*keys, "p").agg(F.min("o").alias("o"))
            of_short = cut.where(short).join(first, [*keys, "p"])
        else:
            first = cut.where(short).groupBy(*keys, "p").agg(F.min("o").alias("o"))
            of_short = posted.join(first, [*keys, "p"]).groupBy(*keys, "x").agg(F.min("o").alias("o"))
        of_long = cut.where(~short).join(posted, [*keys, "p"]).where(F.col(b).contains(F.col(s)))
        return of_short.select(*keys, "x", "o").unionByName(of_long.select(*keys, "x", "o")).withColumn("s", F.lit(0.8))

    found += [contained(x, "x", y, "y"), contained(y, "y", x, "x")]
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    best = every.where(F.col("s") > floor).groupBy(*keys, "x").agg(F.max(F.struct("s", (-F.col("o")).alias("o"))).alias("b"))
    return best.select(*keys, F.col("x").alias(text), (-F.col("b.o")).alias(order), F.col("b.s").alias("score"))
