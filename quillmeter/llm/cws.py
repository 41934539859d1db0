"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text is a set of words weighted by how often they occur. For each of ``samples`` samples and each word, two
gamma(2, 1) variates ``r`` and ``c`` and a uniform ``beta`` follow from hashes of the word and the sample's number.
With ``t = floor(ln(weight) / r + beta)`` the word with the least ``ln c - r * (t - beta + 1)`` is drawn, and the
pair of word and ``t`` is the sample. Two texts draw the same pair with the probability of their generalised
Jaccard similarity, the sum of the smaller weights over the sum of the larger. A fingerprint keeps 16 bits a sample.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 40
#: Equal shares into which the gamma law is cut for its quantile tables, as bits of a hash.
R_BITS, C_BITS = 7, 6
R_CELLS, C_CELLS = 1 << R_BITS, 1 << C_BITS
#: Documents per range of ids, and the most ranges: 1024 quantiles of up to 64 equal parts.
RANGE_ROWS, QUANTILES, PARTS = 1024, 1024, 64
#: Draws lie between -60 and 10; they are kept as ``(value + OFFSET) * 2**54`` above 16 bits of the pair.
OFFSET = 128


def _ranges(docs: DataFrame, doc_id: str) -> Column:
    """Range number of an id, ascending with the id: quantiles, each cut into equal parts. Null ids come first."""
    n = docs.count()
    k = max(1, min(QUANTILES, -(-n // RANGE_ROWS)))
    parts = max(1, min(PARTS, -(-n // (RANGE_ROWS * k))))
    if k == 1:
        return F.when(F.col(doc_id).isNull(), -1).otherwise(0)
    row = docs.agg(
        F.percentile_approx(doc_id, [i / k for i in range(1, k)], 10_000).alias("cuts"), F.min(doc_id).alias("low"), F.max(doc_id).alias("high")
    ).first()
    cuts = sorted(set(row["cuts"] or []))
    limits = [row["low"], *cuts, (row["high"] or 0) + 1]
    literal = lambda values: F.array(*[F.lit(v).cast("decimal(20,0)") for v in values])
    q = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col(doc_id)))
    if parts == 1:
        at = q
    else:
        low, high = F.element_at(literal(limits[:-1]), q + 1), F.element_at(literal(limits[1:]), q + 1)
        part = F.floor((F.col(doc_id) - low).cast("double") / F.greatest(high - low, F.lit(1)).cast("double") * parts)
        at = q * PARTS + F.least(part, F.lit(parts - 1)).cast("int")
    return F.when(F.col(doc_id).isNull(), -1).otherwise(at)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(range, rn, borrowed, doc_id, text, next_text): each text beside that of the next larger id, cyclically.

    Rows are dealt by ranges of ids; the first row of each range is also lent to the range before (``borrowed``),
    so that neighbours meet in one task and no order spans all rows. Equal ids are ordered by text.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("range", _ranges(rows, "doc_id"))
    # at most QUANTILES * PARTS + 1 ranges: a bounded window, and a bounded broadcast
    firsts = rows.groupBy("range").agg(F.min("doc_id").alias("first"))
    order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("range").over(Window.orderBy("range")), F.max("range").over(order))
    firsts = firsts.select("range", "first", before.alias("before"))
    lent = rows.join(F.broadcast(firsts), "range")
    own, other = F.struct("range", F.lit(False).alias("borrowed")), F.struct(F.col("before").alias("range"), F.lit(True).alias("borrowed"))
    places = F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.array(own, other)).otherwise(F.array(own))
    dealt = lent.select("doc_id", "text", F.explode(places).alias("at")).select("at.range", "at.borrowed", "doc_id", "text")
    within = Window.partitionBy("range").orderBy("borrowed", "doc_id", "text")
    return dealt.select(
        "range", "borrowed", "doc_id", "text", F.row_number().over(within).alias("rn"), F.coalesce(F.lead("text").over(within), F.lit("")).alias("next_text")
    )


def weighted_terms(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per distinct word of a text: its hash ``term`` and the logarithm ``w`` of its number of occurrences.

    Equal hashes form runs in sorted order. A text without words keeps one row with a null term.
    """
    words = F.array_remove(F.split(F.lower(text), "[ \\t-\\r]+"), "")
    hashed = rows.select(*keep, F.sort_array(F.transform(words, lambda w: F.xxhash64(w))).alias("a"))
    size = F.size("a")
    indexes = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.get(F.col("a"), i)
    runs = hashed.select(*keep, "a", F.filter(indexes, lambda i: (i == 0) | (at(i) != at(i - 1))).alias("q"))

    def entry(start: Column, j: Column) -> Column:
        length = F.coalesce(F.get(F.col("q"), j + 1), F.size("a")) - start
        return F.struct(at(start).alias("term"), F.log(length.cast("double")).alias("w"))

    return runs.select(*keep, F.explode_outer(F.transform("q", entry)).alias("e")).select(*keep, "e.term", "e.w")


def gamma_quantile(u: float) -> float:
    """Quantile of the gamma(2, 1) law, whose distribution function is 1 - exp(-x) * (1 + x)."""
    low, high = 0.0, 60.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - math.exp(-mid) * (1 + mid) < u else (low, mid)
    return (low + high) / 2


def _tables() -> list[Column]:
    """``r`` at the middle of each of 128 equal shares; ``ln c`` at the borders of 64 shares and its rise over each;
    the same for 64 equal parts of the lowest of them, which decides most minima. Short tables keep plans small."""
    r = [gamma_quantile((i + 0.5) / R_CELLS) for i in range(R_CELLS)]
    out = [r]
    for scale in (C_CELLS, C_CELLS * C_CELLS):
        borders = [math.log(gamma_quantile(min(max(i, 0.05), scale - 0.1) / scale)) for i in range(C_CELLS + 1)]
        out += [borders[:-1], [b - a for a, b in zip(borders, borders[1:], strict=False)]]
    return [F.expr("array(" + ", ".join(f"{v!r}D" for v in values) + ")") for values in out]


def _draw(k: int, tables: list[Column]) -> Column:
    """The word's draw for sample ``k``, packed so that the least number has the least draw.

    One hash gives 7 bits for ``r``, 30 for ``c`` and 23 for ``beta``. Gamma quantiles come from tables, linear
    within a share.
    """
    r_table, c_table, c_rise, low_table, low_rise = tables
    x = F.expr(f"xxhash64(term, {k})")
    part = lambda shift, bits: F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    r = r_table[part(0, R_BITS)]
    beta = (part(9, 23) + 0.5) * (1.0 / (1 << 23))
    cell, within = part(32, C_BITS), part(40, 24) * (1.0 / (1 << 24))
    sub, below = part(64 - C_BITS, C_BITS), part(40, 24 - C_BITS) * (1.0 / (1 << (24 - C_BITS)))
    ln_c = F.when(cell == 0, low_table[sub] + below * low_rise[sub]).otherwise(c_table[cell] + within * c_rise[cell])

    t = F.floor(F.col("w") / r + beta)
    high = ((ln_c - r * (t - beta + 1.0) + float(OFFSET)) * float(1 << 54)).cast("long")
    pair = F.col("term").bitwiseXOR(F.shiftleft(t, 5)).bitwiseAND(F.lit(65535).cast("long"))
    return high.bitwiseAND(F.lit(-65536).cast("long")).bitwiseOR(pair)


def signatures(rows: DataFrame, text: str, keep: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keep`` (which identifies a row) with ``signature``, the samples as array of int; no words: empty."""
    tables = _tables()
    least = weighted_terms(rows, text, keep).groupBy(*keep).agg(*[F.min(_draw(k, tables)).alias(f"m{k}") for k in range(samples)])
    low = F.transform(F.array(*[f"m{k}" for k in range(samples)]), lambda m: m.bitwiseAND(F.lit(65535).cast("long")).cast("int"))
    return least.select(*keep, F.when(F.col("m0").isNull(), F.array().cast("array<int>")).otherwise(low).alias("signature"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples; two texts without words are alike, one without words is unlike all others."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same / F.lit(float(samples)))


def as_text(signature: Column) -> Column:
    """Four hexadecimal digits a sample."""
    return F.array_join(F.transform(signature, lambda m: F.lower(F.lpad(F.hex(m), 4, "0"))), "")


def compare_with_edit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edit, whose second half is the beginning of the next text.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts
    count as empty; the next document of the last is the first; a single document is its own next. One shuffle of
    the texts, by ranges of ids; all that follows stays in the same partitions.
    """
    rows = with_next(docs, doc_id, text).withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.expr("left(text, cast(n_chars - n_chars div 2 as int))"), F.expr("left(next_text, cast(n_chars div 2 as int))"))
    rows = rows.withColumn("edited", edited).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    both = F.array(F.struct(F.lit(0).alias("part"), F.col("text").alias("body")), F.struct(F.lit(1).alias("part"), F.col("edited").alias("body")))
    keep = ["range", "rn", "part", "borrowed", "doc_id", "n_chars", "edited_sha256"]
    halves = rows.select(*[c for c in keep if c != "part"], F.explode(both).alias("e")).select(*[c for c in keep if c != "part"], "e.part", "e.body")
    prints = signatures(halves, "body", keep, samples)
    # behind each text stand its edit and the next text, in the same range
    order = Window.partitionBy("range").orderBy("rn", "part")
    own, edit, after = F.col("signature"), F.lead("signature", 1).over(order), F.lead("signature", 2).over(order)
    return (
        prints.select("*", edit.alias("edit"), after.alias("after"))
        .where("part = 0 AND NOT borrowed")
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            as_text(own).alias("fingerprint"),
            as_text(F.col("edit")).alias("edited_fingerprint"),
            likeness(own, F.col("edit"), samples).alias("near_edited"),
            likeness(own, F.col("after"), samples).alias("near_next"),
        )
    )
