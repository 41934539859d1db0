"""Queries on the word table exchange texts by document once; words never move again by (document, page)."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillmeter.operators import layout as J

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["j18_snap_text_to_grid", "j37_key_value_columns", "j39_hybrid_grid", "j39_visual_grid", "j44_generic_rows"])
def test_words_are_not_dealt_by_page(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"Exchange hashpartitioning\(doc_id#\d+L?, page#", plan)


def test_slots_are_those_of_a_comparison_with_every_boundary(spark):
    """Edges before, on, between and in the middle of boundaries, one boundary only, and a page without boundaries."""
    bounds = {1: [0.0, 10.0, 14.0, 30.0], 2: [7.0]}
    spots = [(p, float(x), float(x + w)) for p in (1, 2, 3) for x in range(-3, 36) for w in (0, 2, 5, 13, 40)]
    words = spark.createDataFrame([(1, p, i, a, b) for i, (p, a, b) in enumerate(spots)], "doc_id long, page long, word_id long, x0 double, x1 double")
    grid = spark.createDataFrame([(1, p, b) for p, b in bounds.items()], "doc_id long, page long, columns array<double>")

    def slot(page: int, a: float, b: float) -> int | None:
        known, centre = bounds.get(page), (a + b) / 2
        if known is None:
            return None
        best = min(range(len(known)), key=lambda i: (abs(a - known[i]), i))
        after = known[best + 1] if best + 1 < len(known) else None
        return best + (after is not None and abs(centre - after) < abs(centre - known[best]) and a >= known[best])

    got = {r.word_id: r.c for r in J._slots(words, grid, "columns", "x0", J.x_center(), "c").collect()}
    assert got == {i: slot(*s) for i, s in enumerate(spots)}


def test_header_rows_missing_on_a_page(spark):
    """A page with header rows takes these, one without takes row 0."""
    rows = spark.createDataFrame(
        [(1, 1, 0, 0.1, 0.2), (1, 1, 1, 0.5, 0.6), (1, 2, 0, 0.3, 0.4), (1, 2, 1, 0.7, 0.8)], "doc_id long, page long, row long, x0 double, x1 double")
    heads = spark.createDataFrame([(1, 1, 1)], "doc_id long, page long, row long")
    found = J.header_anchors(rows, heads, 0.2).select("page", F.round("x", 6).alias("x")).collect()
    assert {(r.page, r.x) for r in found} == {(1, 0.55), (2, 0.35)}
