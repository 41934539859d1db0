"""Tables that one pass over the words of a page gives are those of the single operators, without a second exchange of words."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillmeter.operators import layout as J
from quillmeter.operators import pagefolds as P

WORD = "doc_id long, page long, word_id long, text string, x0 double, x1 double, y0 double, y1 double, font_size double"
TEXTS = ["a", "b:", "12", "4711", " lead", "1234 5678 9012", "98 76 54 32 10", "trail ", "  ", None, ""]


@pytest.fixture(scope="module")
def made_up(spark):
    """Pages of one word, of one row, of many rows in few columns, and of words that lie anywhere; with and without headings."""
    rng, rows = random.Random(38), []
    for page in range(90):
        step, deep, heads = rng.choice([1 / 180, 0.05, 0.2]), rng.choice([1, 3, 30]), rng.random() < 0.5
        texts = rng.choice([TEXTS, TEXTS[:4]])
        for i in range(rng.choice([1, 2, 40, 120])):
            x, y = rng.randrange(0, 6) * step, rng.randrange(deep) * rng.choice([0.02, 0.03])
            rows.append((page // 40, page, i, rng.choice(texts), x, x + rng.choice([0.0, 2 * step, 0.1]), y, y + rng.choice([0.01, 0.02]), 16.0 if heads and y == 0.06 else 10.0))
    return spark.createDataFrame(rows, WORD).repartition(3, "doc_id").cache()


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_soft_table_equals_the_single_operators(made_up):
    words = made_up.fillna("", ["text"])  # without nulls, which the single operators do not take
    numbered = J.with_row_number(words, J.rounded_y(100))
    merged = P.merge_vertical(numbered.where("row > 0").drop("row"))
    anchors = P.leader_columns(J.with_row_number(merged, J.rounded_y(50)), 0.05, 3)
    want = found(J.soft_table(numbered.where("row = 0"), merged, anchors))
    assert found(P.soft_table(words)) == want and len({r[:2] for r in want}) > 10 and len({r[4] for r in want if r[3] > 0}) > 10


def test_key_values_equal_the_single_operators(spark, made_up):
    fields = spark.createDataFrame(
        [(0, 3, 2, " n ", "v"), (0, 3, 1, "", "w "), (0, 4, 1, " ", ""), (0, 5, 7, None, "x"), (9, 1, 1, "only fields", None)],
        "doc_id long, page long, n int, name string, value string")
    bands = J.row_bands(made_up, 0.015)
    heads = bands.groupBy(*J.KEY, "row").agg(F.avg("font_size").alias("f")).where("f > 12")
    anchors = J.header_anchors(bands, heads)
    for given in (None, fields):
        want = found(J.key_value_columns(made_up, anchors, given).select(*J.KEY, "row", "col", "value", "is_label"))
        assert found(P.key_value_columns(made_up, 0.015, fields=given)) == want and len(want) > 500


def test_merged_lines_of_many_pages_equal_a_loop(spark):
    """Pages in several batches, some of mixed languages, some without a word of positive height (these vanish), and null texts."""
    rng, rows = random.Random(25), []
    for page in range(60):
        mixed, flat = rng.random() < 0.3, page % 9 == 8
        for i in range(rng.choice([1, 7, 60])):
            y = rng.choice([0.0, 4.0, 6.5, 9.0, 12.0, 25.0])
            rows.append((page // 25, page, rng.randrange(2), rng.randrange(2), i, rng.choice(["a", "b c", None, ""]), rng.random(), float(i), i + 1.0, y, y + (0.0 if flat else 10.0), mixed))
    df = spark.createDataFrame(rows, "doc_id long, page long, row long, col long, word_id long, text string, confidence double, x0 double, x1 double, y0 double, y1 double, m boolean")
    want = []
    for d, p, r, c in sorted({k[:4] for k in rows if k[1] % 9 < 8}):
        left = sorted((k for k in rows if k[:4] == (d, p, r, c)), key=lambda k: k[4])
        while left:
            near = 9.0 if left[0][11] else 6.0
            taken = [k for k in left if k is left[0] or abs(k[9] - left[0][9]) < near]
            left = [k for k in left if k not in taken]
            want.append((d, p, r, c, " ".join(k[5] for k in taken if k[5] is not None), *(f(k[n] for k in taken) for f, n in ((min, 6), (min, 7), (max, 8), (min, 9), (max, 10))), len(taken)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert found(J.merge_lines(df, mixed=F.col("m"))) == sorted(want, key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("name", ["j25_merge_lines", "j37_key_value_columns", "j38_soft_table"])
def test_words_are_made_and_dealt_once(spark, name):
    """One page rule reads the words; nothing is written in between."""
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("posexplode") == 2 and "ExistingRDD" not in plan
