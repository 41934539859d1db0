"""Search ranking over index entries (survey group H)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.functions.exprs import first_rule
from quillmeter.operators.scans import top_k
from quillmeter.sources.sinks import written


#: A stated list of up to so many queries is scored beside every entry; longer lists and tables go through postings.
FEW_QUERIES = 64


def _as_table(items: DataFrame, queries: DataFrame | Sequence[str]) -> DataFrame:
    if isinstance(queries, DataFrame):
        return queries.select("query").where("query IS NOT NULL").distinct()
    return items.sparkSession.createDataFrame([(q,) for q in dict.fromkeys(queries)], "query string")


def _pieces(text: Column, *sizes: int) -> Column:
    """Different stretches of so many letters."""
    def of(n: int) -> Column:
        at = F.sequence(F.lit(1), F.length(text) - (n - 1))
        return F.when(F.length(text) >= n, F.transform(at, lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(of, sizes)))


def _rarest_pieces(needles: DataFrame, postings: DataFrame) -> DataFrame:
    """(query, piece): for each needle (query, needle) the piece of three letters that fewest entries have.

    A needle with a piece that no entry has is in no entry and gets none.
    """
    own = needles.select("query", "needle", F.explode(_pieces(F.col("needle"), 3)).alias("piece"))
    found = postings.join(own.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    counted = own.join(found, "piece", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = counted.groupBy("query", "needle").agg(F.min(F.struct("n", "piece")).alias("b"))
    return best.where("b.n > 0").select("query", F.col("b.piece").alias("piece")).distinct()


def _with_queries(items: DataFrame, queries: DataFrame | Sequence[str], key: str) -> DataFrame:
    """Entries beside the queries they may score for; queries are a list or a table with column ``query``.

    A score above zero needs one text inside another: the query or one of its words (three letters or more) in a
    title, description, category or keyword, or a keyword or title in the query. Postings of pieces of three letters
    list the entries; of each needle only the rarest piece is looked up. Keywords and titles are looked up in the
    queries by their first three letters and compared at once. Shorter needles meet the texts that have them as a piece
    of their own size, which is a hit and no mere candidate. So a pair is proposed only where the rarest piece agrees.
    Entries are written once, as they may be costly to derive. Keywords and titles are not empty. A short list of
    queries needs no index: it stands beside each entry.
    """
    low = items.select("*", F.lower("title").alias("__t"), F.lower("description").alias("__d"),
                       F.lower("category").alias("__c"), F.transform("keywords", lambda k: F.lower(k)).alias("__k"))
    if not isinstance(queries, DataFrame) and len(queries) <= FEW_QUERIES:
        few = [q for q in dict.fromkeys(queries) if q is not None]
        listed = F.array(*map(F.lit, few)) if few else F.array().cast("array<string>")
        return low.withColumn("query", F.explode(listed)).withColumn("__q", F.lower(F.trim("query"))).where("__q <> ''")
    low = written(low, "search-entries")
    asked = _as_table(items, queries).withColumn("__q", F.lower(F.trim("query"))).where("__q <> ''")
    words = F.filter(F.split("__q", r"\s+"), lambda w: F.length(w) >= 3)
    needles = asked.select("query", F.explode(F.array_distinct(F.concat(F.array("__q"), words))).alias("needle"))
    texts = F.array_compact(F.concat(F.array("__t", "__d", "__c"), F.col("__k")))
    titles = low.select(key, F.explode(F.array_distinct(F.array_compact(F.concat(F.array("__t"), F.col("__k"))))).alias("needle"))

    def held(*sizes: int) -> DataFrame:
        pieces = F.array_distinct(F.flatten(F.transform(texts, lambda x: _pieces(x, *sizes))))
        return low.select(key, F.explode(pieces).alias("piece"))

    def parts(*sizes: int) -> DataFrame:
        return asked.select("query", "__q", F.explode(_pieces(F.col("__q"), *sizes)).alias("piece"))

    long_, postings = F.length("needle") >= 3, held(3)
    pairs = _rarest_pieces(needles.where(long_), postings).join(postings, "piece").select("query", key)
    inside = titles.where(long_).withColumn("piece", F.substring("needle", 1, 3)).join(parts(3), "piece")
    pairs = pairs.unionByName(inside.where(F.col("__q").contains(F.col("needle"))).select("query", key))
    pairs = pairs.unionByName(titles.where(~long_).withColumnRenamed("needle", "piece").join(parts(1, 2), "piece").select("query", key))
    short = needles.where(~long_).withColumnRenamed("needle", "piece")
    if not short.isEmpty():
        pairs = pairs.unionByName(short.join(held(1, 2), "piece").select("query", key))
    return pairs.distinct().join(asked, "query").join(low, key)


def _hits(words: Column, test) -> Column:
    return F.size(F.filter(words, test))


def _pair_hits(words: Column, keywords: Column) -> Column:
    return F.aggregate(
        words, F.lit(0), lambda n, w: n + F.size(F.filter(keywords, lambda k: k.contains(w) | w.contains(k)))
    )


def smart_search(items: DataFrame, queries: DataFrame | Sequence[str], key: str, k: int = 8) -> DataFrame:
    """H1 (k=8) and H3 (k=5): weighted score over title, keywords and description, best k per query."""
    q, t, d, kw = (F.col(c) for c in ("__q", "__t", "__d", "__k"))
    words = F.filter(F.split(q, " "), lambda w: F.length(w) > 2)
    score = (
        F.when(t == q, 100).otherwise(0)
        + F.when(t.contains(q), 50).otherwise(0)
        + 15 * _hits(words, lambda w: t.contains(w))
        + 30 * _hits(kw, lambda x: x == q)
        + 20 * _hits(kw, lambda x: (x != q) & q.contains(x))
        + 15 * _hits(kw, lambda x: ~q.contains(x) & x.contains(q))
        + 10 * _pair_hits(words, kw)
        + 5 * _hits(words, lambda w: d.contains(w))
    )
    scored = _with_queries(items, queries, key).select("query", key, "title", score.cast("long").alias("score"))
    return top_k(scored.where("score > 0"), ["query"], [F.col("score").desc(), F.col(key)], k)


def tiered_search(items: DataFrame, queries: DataFrame | Sequence[str], key: str, k: int = 10) -> DataFrame:
    """H2: scores from 70 come first, then the rest; queries shorter than two letters give nothing."""
    q, t, d, kw = (F.col(c) for c in ("__q", "__t", "__d", "__k"))
    c = F.col("__c")
    words = F.filter(F.split(q, r"\s+"), lambda w: F.length(w) >= 3)
    score = (
        first_rule([(t == q, 100), (t.contains(q), 80), (q.contains(t), 70)], 0)
        + F.when(d.contains(q), 30).otherwise(0)
        + F.when(c.contains(q), 20).otherwise(0)
        + 40 * _hits(kw, lambda x: x == q)
        + 20 * _hits(kw, lambda x: (x != q) & (x.contains(q) | q.contains(x)))
        + 15 * _hits(words, lambda w: t.contains(w))
        + 10 * _hits(words, lambda w: d.contains(w))
        + 10 * _pair_hits(words, kw)
    )
    rows = _with_queries(items, queries, key).where(F.length(q) >= 2)
    scored = rows.select("query", key, "title", score.cast("long").alias("score")).where("score > 0")
    tiered = scored.withColumn("tier", F.when(F.col("score") >= 70, 1).otherwise(2))
    return top_k(tiered, ["query"], [F.col("tier"), F.col("score").desc(), F.col(key)], k)
