"""Facts and columns that one pass over the words of a page gives are those of the single operators."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillmeter.operators import layout as J
from quillmeter.operators import pagefolds as P

WORD = "doc_id long, page long, word_id long, text string, x0 double, x1 double, y0 double, y1 double"
TEXTS = ["a", "b 1", "12", "4711", "1234 5678 9012", "12345678901234567890123", None, ""]


@pytest.fixture(scope="module")
def made_up(spark):
    """Pages of one word, of one row, of equal words and of many words that lie a step of 1/180 or 0.05 apart."""
    rng, rows = random.Random(34), []
    for page in range(120):
        step, deep = rng.choice([1 / 180, 0.05, 0.004]), rng.choice([1, 3, 30])
        for i in range(rng.choice([1, 2, 40, 150])):
            x, y = rng.randrange(0, 19) * step, rng.randrange(deep) * rng.choice([0.02, 0.01])
            rows.append((page // 50, page, i, rng.choice(TEXTS), x, x + rng.choice([0.0, 2 * step, 0.1]), y, y + rng.choice([0.01, 0.02])))
    return spark.createDataFrame(rows, WORD).repartition(3, "doc_id").cache()


def found(df, *names):
    rows = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*J.KEY, *names).collect()]
    return sorted(rows, key=repr)


def test_page_facts_equal_the_single_operators(made_up):
    facts = J.measured_facts(made_up)
    bands = P.leader_columns(J.with_row_number(made_up, J.rounded_y(50)), 0.08)
    names = J.CANDIDATE[2:]
    nothing = F.coalesce("numeric_blocks", F.lit(0)).alias("numeric_blocks")
    candidates = J.visual_table_candidate(J.table_candidate_facts(made_up).withColumn("numeric_blocks", nothing), bands)
    assert found(facts, *names) == found(candidates, *names)
    halves = ["blocks", "left_blocks", "right_blocks", "label_value", "row_grid"]
    assert found(facts, *halves) == found(J.left_right_alignment(made_up), *halves)
    assert found(facts, "columns") == found(P.column_count(made_up), "columns")
    assert {r.is_candidate for r in facts.collect()} == {True, False}


@pytest.mark.parametrize("tol, share", [(0.004, 0.6), (0.04, 0.6), (0.06, 0.2), (0.004, 1.0)])
def test_consensus_equals_bands_and_columns(made_up, tol, share):
    names = ["col", "x", "row_support"]
    assert found(P.consensus_columns(made_up, 0.015, tol, share), *names) == found(J.consensus_columns(J.row_bands(made_up, 0.015), tol, share), *names)


@pytest.mark.parametrize("name", ["j11_consensus_columns", "j34_table_candidate", "l15_visual_table_confidence", "l8_route_measured"])
def test_words_are_made_and_dealt_once(spark, name):
    """Words come from one exchange of the texts, are made once, and one page rule reads them."""
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("posexplode") == 2 and plan.count("MapInArrow") == 1


def test_halves_round_to_even(spark):
    values = [0.01, 0.03, 0.05, 0.07, 0.009999, 1.01, 0.0, -0.001, 123456.789]
    rows = spark.createDataFrame([(v, v) for v in values], "y0 double, y1 double")
    both = rows.select(J.rounded_y(50).alias("a"), (F.bround(J.y_center() * 50) / 50).alias("b")).collect()
    assert [repr(r.a) for r in both] == [repr(r.b) for r in both]
