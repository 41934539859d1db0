"""Cells meet the blocks of their page in one pass: the best match is that of a comparison of all texts."""

import random

import pytest

import __spark_entry__ as entry
from quillmeter.operators import layout as J

CELL = "doc_id long, page long, row long, col long, value string, x0 double, y0 double, x1 double, y1 double"
BLOCK = "doc_id long, page long, word_id long, text string, x0 double, y0 double, x1 double, y1 double"


def score(v: str, t: str) -> float:
    a, b = set(v.split()), set(t.split())
    return 1.0 if v == t else 0.8 if v in t or t in v else len(a & b) / len(a | b)


@pytest.mark.parametrize("floor", [0.4, 0.7, 0.85])
def test_matches_equal_comparing_all(spark, floor):
    """Pages of few and of many short blocks, with texts that hold, repeat and reorder others, and a character zero."""
    rng = random.Random(30)
    word = lambda: rng.choice(["ab", "Abc", "x", "long words", "cd ef gh", "q\0r", "ß", "zz"])
    text = lambda most: rng.choice(["", " ", "\t"]) + rng.choice([" ", "  "]).join(word() for _ in range(rng.randint(0, most)))
    cells, blocks = [], []
    for page in range(80):
        cells += [(page % 4, page, i, 0, rng.choice([None, text(6), text(9)]), rng.choice([None, None, 7.0]), None, None, None) for i in range(rng.choice([0, 3, 20]))]
        blocks += [(page % 4, page, 50 - i, rng.choice([None, text(6), text(2)]), float(i), 1.0, 2.0, 3.0) for i in range(rng.choice([0, 1, 8, 50]))]
    want = {}
    for d, p, i, _, v, x0, *_ in cells:
        near = [(score(v.strip().lower(), t.strip().lower()), -w, a) for e, q, w, t, a, *_ in blocks if (d, p) == (e, q) and t and t.strip() and v and v.strip()]
        best = max((n for n in near if n[0] > floor), default=None) if x0 is None and v and v.strip(" ") else None
        want[d, p, i] = (-best[1], best[2]) if best else (None, x0)
    got = J.match_cells_to_blocks(spark.createDataFrame(cells, CELL), spark.createDataFrame(blocks, BLOCK), floor).collect()
    assert {(r.doc_id, r.page, r.row): (r.matched_word, r.x0) for r in got} == want and len(got) == len(cells)
    assert len([1 for m, _ in want.values() if m is not None]) > 15


def test_cells_are_dealt_once_and_nothing_is_written(spark):
    plan = entry.queries()["j30_match_cells"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert "Join" not in plan.executedPlan().toString() and "ExistingRDD" not in plan.executedPlan().toString()
    assert plan.executedPlan().toString().count("Exchange hashpartitioning") <= 2  # the texts, dealt once and read for cells and lines
