"""Page rules and the word table hold a bounded part of their input at a time."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmeter.operators import pagefolds as P
from quillmeter.sources.words import PART_CHARS, words_from_text


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10")
    yield
    spark.conf.set(key, before)


def page_words(spark, pages, per_page):
    return spark.range(pages * per_page).select(
        F.lit(1).cast("long").alias("doc_id"), F.floor(F.col("id") / per_page).cast("long").alias("page"), F.col("id").alias("word_id"),
        F.lit("w").alias("text"), F.lit(0.0).alias("x0"), (F.col("id") % per_page * 20.0).alias("y0"), F.lit(6.0).alias("x1"),
        (F.col("id") % per_page * 20.0 + 10).alias("y1"), F.lit(10.0).alias("font_size"))


def test_a_rule_sees_few_pages_at_once(spark, small_batches):
    """A hundred pages of four words in one partition, ten words to a batch: no more than a batch and a page at once."""
    def run(batch, ends):
        assert batch.column(1).to_pylist()[ends[0]:ends[1]] == [batch.column(1)[0].as_py()] * 4
        return pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([len(ends) - 1])], names=["rows", "pages"])

    seen = P._pages(page_words(spark, 100, 4).coalesce(1), ["doc_id", "page"], ["word_id"], run, "rows long, pages long").collect()
    assert sum(r["pages"] for r in seen) == 100 and max(r["rows"] for r in seen) <= 14


@pytest.mark.parametrize("per_page", [1, 4, 10, 37])
def test_pages_across_batches_are_whole(spark, small_batches, per_page):
    rows = P.rows_by_font(page_words(spark, 20, per_page)).collect()
    assert sorted((r["page"], r["row"]) for r in rows) == [(p, i) for p in range(20) for i in range(per_page)]


def test_no_page_lists_are_collected(spark):
    plan = P.merge_vertical(page_words(spark, 3, 4))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_partitions_grow_with_the_text(spark):
    """A text that compresses to nothing still gets its share of partitions."""
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), PART_CHARS // 10).alias("text"))
    words = words_from_text(docs)
    assert words.rdd.getNumPartitions() >= 20
    assert words_from_text(docs.limit(0)).count() == 0


def test_texts_of_a_match_are_settled_once(spark, monkeypatch):
    """Words and pieces of each side are worked out once, not in every join."""
    from quillmeter.operators import textjoin as X

    kept = []
    monkeypatch.setattr(X, "settled", lambda df, old=X.settled: kept.append(df.columns) or old(df))
    x = spark.createDataFrame([(1, "alpha beta gamma")], "k long, v string")
    y = spark.createDataFrame([(1, 7, "alpha beta gamma delta"), (1, 8, "other words")], "k long, o long, t string")
    plan = X.best_match(x, y, ["k"], "v", "t", "o", 0.7)
    assert [tuple(r) for r in plan.collect()] == [(1, "alpha beta gamma", 7, 0.8)]
    assert [c[-2:] for c in kept[:2]] == [["wx", "p"], ["wy", "p"]] and len(kept) == 4
    assert "xxhash64" not in plan._jdf.queryExecution().optimizedPlan().toString()
