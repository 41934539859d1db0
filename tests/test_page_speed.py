"""Page rules that leave out work give what the plain loops over all words gave."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillmeter.operators import layout as J
from quillmeter.operators import pagefolds as P

WORD = "doc_id long, page long, word_id long, text string, x0 double, y0 double, x1 double, y1 double, font_size double"


def made_up_pages(rng, pages, texts):
    rows = []
    for page in range(pages):
        step = rng.choice([4.0, 9.0, 12.0])
        for i in range(rng.choice([1, 5, 40])):
            x, y = rng.randrange(0, 60) / 2, rng.randrange(0, 8) * step
            rows.append((1, page, i, rng.choice(texts), x, y, x + rng.choice([0.0, 2.0, 6.0, 25.0]), y + rng.choice([8.0, 10.0, 16.0]), 10.0))
    return rows


def plain_kind(text):
    """Share of digits and script of a text, letter by letter."""
    bare = [c for c in text if c not in " -/."]
    share = sum(c.isdigit() for c in bare) / len(bare) if bare else 0.0
    if not text:
        return share, "unknown"
    if sum("ऀ" <= c <= "ॿ" for c in text) / len(text) > 0.3:
        return share, "devanagari"
    if sum("a" <= c.lower() <= "z" for c in text) / len(text) > 0.3:
        return share, "latin"
    return share, "numeric" if sum(c.isdigit() for c in text) / len(text) > 0.5 else "mixed"


def plain_cells(words):
    """J21 with every later word of the page compared."""
    words = sorted(words, key=lambda w: (w[5], w[4], w[2]))
    x0, y0, x1, y1 = ([w[k] for w in words] for k in (4, 5, 6, 7))
    limit = (sum(y1) - sum(y0)) / len(words) * 1.5
    yc = [(a + b) / 2 for a, b in zip(y0, y1)]
    kinds = [plain_kind(w[3] or "") for w in words]
    owner, cells = [-1] * len(words), 0
    for i in range(len(words)):
        if owner[i] >= 0:
            continue
        members, lowest, owner[i] = [i], yc[i], cells
        for j in range(i + 1, len(words)):
            if y0[j] - lowest > limit:
                break
            if owner[j] < 0 and any(
                (common := min(x1[m], x1[j]) - max(x0[m], x0[j])) > 0 and common / min(x1[m] - x0[m], x1[j] - x0[j]) >= 0.7 and abs(yc[m] - yc[j]) <= limit
                and ((kinds[m][0] >= 0.6 and kinds[j][0] >= 0.6) or kinds[m][1] == kinds[j][1] != "unknown") for m in members
            ):
                members.append(j)
                owner[j], lowest = cells, max(lowest, yc[j])
        cells += 1
    return {(w[1], w[2]): c for w, c in zip(words, owner)}


def by_page(rows):
    pages = {}
    for r in rows:
        pages.setdefault(r[1], []).append(r)
    return pages.values()


def test_logical_cells_equal_comparing_all_words(spark):
    rng = random.Random(21)
    rows = made_up_pages(rng, 120, ["total", "12.50", "7", "कुल", "naïve", "", None, "a1", "--", "K1"])
    want = {k: v for page in by_page(rows) for k, v in plain_cells(page).items()}
    got = {(r.page, r.word_id): r.cell for r in P.logical_cells(spark.createDataFrame(rows, WORD)).collect()}
    assert got == want and len(set(want.values())) > 10


def plain_merge(words, gap=2.0):
    out = []
    spaced = lambda t: " " in t and 10 <= sum(c.isdigit() for c in t) <= 12
    for w in sorted(words, key=lambda w: (w[5], w[4], w[2])):
        b = out[-1] if out else None
        if b and abs(b[5] + b[7] - w[5] - w[7]) / 2 <= (b[7] - b[5]) * 0.5 and w[4] - b[6] <= gap and (spaced(b[3]) or spaced(w[3])):
            out[-1] = (*b[:3], f"{b[3]} {w[3]}".strip(), min(b[4], w[4]), min(b[5], w[5]), max(b[6], w[6]), max(b[7], w[7]), b[8])
        else:
            out.append(w)
    return out


def test_merged_numbers_equal_the_plain_loop(spark):
    """Pages with spaced numbers among pages without any, the latter left as they are."""
    rng = random.Random(22)
    rows = made_up_pages(rng, 60, ["98 7654 3210", "1234 5678 9012", "total", "7", "two words"])
    rows += [(1, p + 100, *r[2:]) for p, r in ((r[1], r) for r in made_up_pages(rng, 60, ["total", "7", "two words"]))]
    want = sorted(b for page in by_page(rows) for b in plain_merge(page))
    got = sorted(tuple(r) for r in P.merge_numeric_pieces(spark.createDataFrame(rows, WORD), gap=2.0).select(*P.BLOCK).collect())
    assert got == want and len(got) < len(rows)


def test_pages_without_a_spaced_number_are_not_walked(spark, monkeypatch):
    """Words are not turned into Python objects where nothing can join."""
    rows = [(1, p, i, "w", i * 10.0, 0.0, i * 10.0 + 9, 10.0, 10.0) for p in range(3) for i in range(4)]
    seen = {}
    monkeypatch.setattr(P, "_pages", lambda df, names, order, run, schema: seen.update(run=run))
    monkeypatch.setattr(P, "_values", lambda column: pytest.fail("a page without a spaced number was walked"))
    P.merge_numeric_pieces(spark.createDataFrame(rows, WORD))
    columns = [pa.array(c) for c in zip(*rows)]
    batch = pa.RecordBatch.from_arrays(columns, names=P.BLOCK)
    assert seen["run"](batch, [0, 4, 8, 12]).to_pylist() == batch.to_pylist()


def test_a_word_is_compared_with_few_others(spark, monkeypatch):
    """Fifty lines of forty words that overlap no other column: comparisons grow with the words, not with words by lines."""
    looked = []

    class Watched(list):
        def __getitem__(self, k):
            looked.append(k)
            return super().__getitem__(k)

    rules = []
    monkeypatch.setattr(P, "_label", lambda words, order, name, reads, rule: rules.append(rule))
    P.logical_cells(spark.createDataFrame([], WORD).withColumn("cell", F.lit(1)))
    at = [(line, k) for line in range(50) for k in range(40)]
    page = {"x0": Watched(k * 10.0 for _, k in at), "x1": [k * 10.0 + 9 for _, k in at], "y0": [n * 30.0 for n, _ in at], "y1": [n * 30.0 + 25 for n, _ in at], "text": ["a" if n % 2 else "1" for n, _ in at]}
    assert len(set(rules[0](page))) == 2000
    assert len(looked) < 10 * 2000


def plain_grid(words, parts, tol, min_rows, far):
    """J39 of one page of words that need no merging, word by word."""
    centre = {w[2]: (w[4] + w[6]) / 2 for w in words}
    height = {w[2]: round((w[5] + w[7]) / 2 * parts) / parts for w in words}
    row = {w: sorted(set(height.values())).index(h) for w, h in height.items()}
    clusters = []
    for x in sorted(set(centre.values())):
        near = next((c for c in clusters if abs(x - c[0] / c[1]) <= tol), None)
        if near:
            near[0], near[1] = near[0] + x, near[1] + 1
        else:
            clusters.append([x, 1])
    columns = [m for m in (t / n for t, n in clusters) if len({row[w] for w, x in centre.items() if abs(x - m) <= tol}) >= min_rows]
    columns = sorted({*columns, *(x for x in centre.values() if not columns or min(abs(x - c) for c in columns) > far)})
    cells = {}
    for w in sorted(words, key=lambda w: (w[4], w[2])):
        col = min(range(len(columns)), key=lambda i: (abs(columns[i] - centre[w[2]]), i))
        cells.setdefault((w[1], row[w[2]], col), []).append(w[3])
    return {k: " ".join(v) for k, v in cells.items()}


def test_grid_equals_placing_word_by_word(spark):
    """Columns from clusters, and from words that lie far from all clusters; pages without any cluster too."""
    rng, scale = random.Random(39), 60.0
    rows = [(*r[:4], *(v / scale for v in r[4:8]), r[8]) for r in made_up_pages(rng, 80, ["a", "b", "12"])]
    frame = spark.createDataFrame(rows, WORD)
    for parts, tol, min_rows, far in ((50, 0.05, 3, 0.10), (100, 0.06, 1, 0.08), (50, 0.01, 30, 0.02)):
        want = {k: v for page in by_page(rows) for k, v in plain_grid(page, parts, tol, min_rows, far).items()}
        got = J.visual_grid(P.numeric_pieces_and_columns(frame, parts, tol, min_rows), far).collect()
        assert {(r.page, r.row, r.col): r.value for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("name", ["j39_visual_grid", "j39_hybrid_grid"])
def test_merged_words_are_dealt_once_and_not_written(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "ExistingRDD" not in plan and "Join" not in plan
