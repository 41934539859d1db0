"""Matching texts of a page, and merging of lines, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quillmeter.operators import layout as J
from quillmeter.operators import pagefolds as P
from quillmeter.operators import textjoin as X


def plain_similarity(a, b):
    a, b = a.lower().strip(), b.lower().strip()
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if a in b or b in a:
        return 0.8
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y)


def made_up_text(rng, words):
    n = rng.choice([0, 1, 1, 2, 3, 6, 12])
    return rng.choice(["", " "]) + rng.choice([" ", "  "]).join(rng.choice(words) for _ in range(n))


@pytest.mark.parametrize("floor", [0.5, 0.7, 0.85])
def test_best_match_equals_comparing_all(spark, floor):
    rng = random.Random(int(floor * 100))
    words = ["a", "B", "to", "the", "total", "Amount", "amounting", "invoice", "x1", "größe", "हिन्दी", "in", "voice"]
    cells = [(rng.randint(1, 4), 1, i, made_up_text(rng, words)) for i in range(160)]
    blocks = [(rng.randint(1, 4), 1, i, made_up_text(rng, words)) for i in range(120)]
    # near copies of blocks, with one word changed
    for i, (doc, page, _, text) in enumerate(list(blocks)):
        parts = text.split()
        if len(parts) > 5:
            parts[rng.randrange(len(parts))] = "changed"
            cells.append((doc, page, 1000 + i, " ".join(rng.sample(parts, len(parts)))))
    want = {}
    for doc, page, _, v in cells:
        scored = [(plain_similarity(v, t), -o) for d, p, o, t in blocks if (d, p) == (doc, page)]
        best = max((s for s in scored if s[0] > floor), default=None)
        if best:
            want[doc, page, v.lower().strip()] = (-best[1], pytest.approx(best[0]))
    x = spark.createDataFrame(cells, "doc_id long, page long, cell long, v string")
    y = spark.createDataFrame(blocks, "doc_id long, page long, o long, t string")
    got = {(r.doc_id, r.page, r.v): (r.o, r.score) for r in X.best_match(x, y, ["doc_id", "page"], "v", "t", "o", floor).collect()}
    assert got == want and len(want) > 25


def test_no_cell_meets_all_blocks(spark):
    """1000 cells and 1000 blocks of one page: the joins propose few pairs."""
    x = spark.range(1000).select(F.lit(1).alias("k"), F.concat(F.lit("item number "), F.sha2(F.col("id").cast("string"), 256)).alias("v"))
    y = x.select("k", F.col("v").alias("t"), F.monotonically_increasing_id().alias("o"))
    plan = X.best_match(x, y, ["k"], "v", "t", "o", 0.7)
    assert plan.count() == 1000
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()


def test_cells_keep_their_boxes_and_blank_cells_match_nothing(spark):
    cells = spark.createDataFrame(
        [(1, 1, 0, 0, "Total", None, None, None, None), (1, 1, 0, 1, "Total", 9.0, 9.0, 9.0, 9.0), (1, 1, 1, 0, "  ", None, None, None, None), (2, 1, 0, 0, "Total", None, None, None, None)],
        "doc_id long, page long, row long, col long, value string, x0 double, y0 double, x1 double, y1 double",
    )
    blocks = spark.createDataFrame([(1, 1, 5, "the total", 1.0, 2.0, 3.0, 4.0), (1, 1, 7, "total", 5.0, 6.0, 7.0, 8.0)], "doc_id long, page long, word_id long, text string, x0 double, y0 double, x1 double, y1 double")
    got = {(r.doc_id, r.row, r.col): (r.matched_word, r.x0) for r in J.match_cells_to_blocks(cells, blocks).collect()}
    assert got == {(1, 0, 0): (7, 5.0), (1, 0, 1): (None, 9.0), (1, 1, 0): (None, None), (2, 0, 0): (None, None)}


def word_rows(ys, row=0):
    return [(1, 1, row, 0, i, f"w{i}", 0.5, float(i), i + 0.5, y, y + 10.0) for i, y in enumerate(ys)]


WORD = "doc_id long, page long, row long, col long, word_id long, text string, confidence double, x0 double, x1 double, y0 double, y1 double"


def test_left_over_words_open_cells_of_their_own(spark):
    df = spark.createDataFrame(word_rows([0.0, 0.0, 20.0, 20.0]), WORD)
    assert sorted(r.value for r in J.merge_lines(df).collect()) == ["w0 w1", "w2 w3"]
    near = spark.createDataFrame(word_rows([0.0, 7.0, 14.0]), WORD)  # line height 10: within 6, or within 9 if mixed
    assert sorted(r.value for r in J.merge_lines(near).collect()) == ["w0", "w1", "w2"]
    assert sorted(r.value for r in J.merge_lines(near, mixed=F.lit(True)).collect()) == ["w0 w1", "w2"]


def test_merge_lines_equals_loop(spark):
    rng = random.Random(8)
    rows = []
    for row in range(30):
        rows += word_rows([rng.uniform(0, 40) for _ in range(rng.randint(1, 12))], row)
    want = []
    for row in range(30):
        left = [r for r in rows if r[2] == row]
        while left:
            first, rest, taken = left[0], [], []
            for r in left:
                (taken if abs(r[9] - first[9]) < 6 - 1e-9 else rest).append(r)
            want.append((row, " ".join(r[5] for r in taken)))
            left = rest
    got = [(r.row, r.value) for r in J.merge_lines(spark.createDataFrame(rows, WORD)).collect()]
    assert sorted(got) == sorted(want)


def test_multiline_cells_follow_the_lower_edge(spark):
    cells = [(1, 1, 0, 0, "a", 0.0, 30.0), (1, 1, 1, 0, "b", 26.0, 28.0), (1, 1, 2, 0, "c", 33.0, 36.0), (1, 1, 3, 0, "d", 60.0, 70.0), (1, 1, 0, 1, "e", 0.0, 1.0)]
    df = spark.createDataFrame(cells, "doc_id long, page long, row long, col long, value string, y0 double, y1 double")
    got = sorted((r.col, r.row, r.value, r.y0, r.y1) for r in J.merge_multiline(df).collect())
    assert got == [(0, 0, "a b c", 0.0, 36.0), (0, 3, "d", 60.0, 70.0), (1, 0, "e", 0.0, 1.0)]




def test_spans_are_swept_not_listed(spark):
    rng = random.Random(3)
    cells = [(k, rng.randint(0, 5), rng.randint(0, 5), rng.randint(0, 4), rng.randint(1, 4)) for k in range(40) for _ in range(rng.randint(1, 8))]
    want = {}
    for k in range(40):
        count = {}
        for _, r, c, rs, cs in (x for x in cells if x[0] == k):
            for i in range(r, r + max(1, rs)):
                for j in range(c, c + cs):
                    count[i, j] = count.get((i, j), 0) + 1
        if count:
            want[k] = (1 + max(r for r, _ in count), 1 + max(c for _, c in count), len(count), sum(v > 1 for v in count.values()))
    schema = "k long, row long, col long, rowspan int, colspan int"
    got = {r.k: (r.rows, r.cols, r.covered, r.conflicts) for r in J.covered_area(spark.createDataFrame(cells, schema), ["k"]).collect()}
    assert got == want
    huge = spark.createDataFrame([(1, 0, 0, 10**6, 10**6), (1, 5, 7, 1, 1)], schema)
    assert J.grid_integrity(huge, ["k"]).drop("k").first() == (10**6, 10**6, 10**12, 1, False)
    assert J.grid_integrity(huge.limit(1), ["k"]).first().is_valid


def test_nearest_band_takes_the_upper_one_on_ties(spark):
    cells = spark.createDataFrame([(1, 1, i, y, y) for i, y in enumerate([0.0, 4.0, 5.0, 6.0, 10.5, 99.0])] + [(2, 1, 0, 1.0, 1.0)], "doc_id long, page long, n long, y0 double, y1 double")
    bands = spark.createDataFrame([(1, 1, 0, 0.0), (1, 1, 1, 10.0)], "doc_id long, page long, row long, y double")
    got = {(r.doc_id, r.n): r.row for r in J.nearest_band(cells, bands, 5.0).collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 0, (1, 3): 1, (1, 4): 1}


def test_native_tables_decide_the_number_of_columns(spark):
    words = spark.createDataFrame([(d, 1, i, x, x + 0.01) for d in (1, 2, 3) for i, x in enumerate([0.1, 0.1, 0.5, 0.5])], "doc_id long, page long, word_id long, x0 double, x1 double")
    native = spark.createDataFrame([(1, 1, t, r, c) for t, r, n in [(0, 0, 3), (0, 1, 2), (1, 0, 4)] for c in range(n)] + [(2, 1, 0, 0, 0)], "doc_id long, page long, table_id long, row long, col long")
    got = {r.doc_id: (r.columns, r.from_native) for r in P.detected_columns(words, native).collect()}
    assert got == {1: (4, True), 2: (2, False), 3: (2, False)}
