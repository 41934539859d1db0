"""Layout queries over the words of all documents. Average positions are rounded to nine decimals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillmeter.operators import layout as J
from quillmeter.operators import pagefolds as P
from quillmeter.plans.profile_queries import dealt_as_words, words
from quillmeter.plans.registry import ORACLES, Tables, query
from quillmeter.plans.sqltext import text_list
from quillmeter.plans.wordsql import WORDS
from quillmeter.session import settled
from quillmeter.sources import words as S

KEY = "doc_id, page"


def r9(*names: str) -> dict:
    return {n: F.round(n, 9) for n in names}


def unit(t: Tables) -> DataFrame:
    return J.unit_page(words(t), S.PAGE_W, S.PAGE_H)


UNIT = f"""(SELECT doc_id, page, word_id, text, font_size, bold, confidence, x0 / {S.PAGE_W}::DOUBLE AS x0, x1 / {S.PAGE_W}::DOUBLE AS x1,
  y0 / {S.PAGE_H}::DOUBLE AS y0, y1 / {S.PAGE_H}::DOUBLE AS y1 FROM {WORDS})"""
XC, YC = "((x0 + x1) / 2)", "((y0 + y1) / 2)"


def islands(src: str, pos: str, tol: str | float, label: str, order: str | None = None, cmp: str = ">", absolute: bool = False) -> str:
    step = f"pos - lag(pos) OVER (PARTITION BY {KEY} ORDER BY {order or 'pos'})"
    step = f"abs({step})" if absolute else step
    return f"""(SELECT * EXCLUDE (pos, opens), CAST(sum(opens) OVER (PARTITION BY {KEY} ORDER BY {order or 'pos'} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS {label}
  FROM (SELECT *, CASE WHEN {step} {cmp} {tol} THEN 1 ELSE 0 END AS opens FROM (SELECT *, {pos} AS pos FROM {src})))"""


def nearest(src: str, cols: str, pos: str = XC) -> str:
    """Adds col, anchor_x, distance; cols has doc_id, page, col, x."""
    return f"""(SELECT * EXCLUDE (best, anchors), best.c AS col, best.x AS anchor_x, best.d AS distance FROM (
  SELECT w.*, a.anchors, list_min(list_transform(a.anchors, lambda k: {{'d': abs(k.x - {pos}), 'c': k.c, 'x': k.x}})) AS best
  FROM {src} w LEFT JOIN (SELECT {KEY}, list({{'x': x, 'c': col}}) AS anchors FROM {cols} GROUP BY {KEY}) a USING ({KEY})))"""


@query("j1_valid_blocks", f"SELECT * FROM {WORDS} WHERE trim(text, ' ') <> '' AND x1 > x0 AND y1 > y0")
def valid_blocks(t: Tables) -> DataFrame:
    return J.valid_blocks(words(t))


@query("j35_line_height", f"SELECT {KEY}, round(avg(y1 - y0), 9) AS line_height FROM {WORDS} GROUP BY {KEY}")
def line_height(t: Tables) -> DataFrame:
    return J.line_height(words(t)).withColumns(r9("line_height"))


ROWS = islands(UNIT, YC, 0.015, "row", "pos, word_id")


@query("j2_row_bands", f"SELECT {KEY}, word_id, row, round(avg({YC}) OVER (PARTITION BY {KEY}, row), 9) AS row_center FROM {ROWS}")
def row_bands(t: Tables) -> DataFrame:
    return J.row_bands(unit(t), 0.015).select(*J.KEY, "word_id", "row", F.round("row_center", 9).alias("row_center"))


ORDERED = islands(UNIT, YC, 0.015, "row", "word_id", absolute=True)


@query("j3_rows_in_order", f"SELECT {KEY}, word_id, row FROM {ORDERED}")
def rows_in_order(t: Tables) -> DataFrame:
    return J.rows_in_order(unit(t), 0.015).select(*J.KEY, "word_id", "row")


@query("j4_rows_by_font", f"""
WITH RECURSIVE w AS (SELECT {KEY}, word_id, {YC} AS y, font_size AS f, row_number() OVER (PARTITION BY {KEY} ORDER BY y0, word_id) AS rn FROM {WORDS}),
st AS (SELECT {KEY}, rn, word_id, 0::BIGINT AS row, y AS yc, f AS fc FROM w WHERE rn = 1
  UNION ALL SELECT w.doc_id, w.page, w.rn, w.word_id,
    CASE WHEN abs(w.y - s.yc) <= (w.f + s.fc) / 2 * 0.5::DOUBLE AND abs(w.f - s.fc) <= 2 THEN s.row ELSE s.row + 1 END,
    CASE WHEN abs(w.y - s.yc) <= (w.f + s.fc) / 2 * 0.5::DOUBLE AND abs(w.f - s.fc) <= 2 THEN (s.yc + w.y) / 2 ELSE w.y END,
    CASE WHEN abs(w.y - s.yc) <= (w.f + s.fc) / 2 * 0.5::DOUBLE AND abs(w.f - s.fc) <= 2 THEN (s.fc + w.f) / 2 ELSE w.f END
  FROM st s JOIN w ON w.doc_id = s.doc_id AND w.page = s.page AND w.rn = s.rn + 1)
SELECT {KEY}, word_id, row FROM st""")
def rows_by_font(t: Tables) -> DataFrame:
    return P.rows_by_font(words(t)).select(*J.KEY, "word_id", "row")


JOINS_5 = """(w.y - s.ys / s.wt <= least(greatest((w.f + s.ff) * 0.6::DOUBLE * 0.25::DOUBLE, 2.0), 10.0)
  AND abs(s.ff - w.f) / greatest(s.ff, w.f) < 0.25 AND s.lo - 50 <= w.a AND w.a <= s.hi + 50)"""


@query("j5_rows_dynamic", f"""
WITH RECURSIVE w AS (SELECT {KEY}, word_id, y0 AS y, font_size AS f, x0 AS a, x1 AS b, row_number() OVER (PARTITION BY {KEY} ORDER BY y0, word_id) AS rn FROM {WORDS}),
st AS (SELECT {KEY}, rn, word_id, 0::BIGINT AS row, y * f AS ys, f AS wt, f AS ff, a AS lo, b AS hi FROM w WHERE rn = 1
  UNION ALL SELECT doc_id, page, rn, word_id, CASE WHEN j THEN row ELSE row + 1 END, CASE WHEN j THEN ys + y * f ELSE y * f END, CASE WHEN j THEN wt + f ELSE f END,
    CASE WHEN j THEN ff ELSE f END, CASE WHEN j THEN least(lo, a) ELSE a END, CASE WHEN j THEN greatest(hi, b) ELSE b END
  FROM (SELECT w.*, s.row, s.ys, s.wt, s.ff, s.lo, s.hi, {JOINS_5} AS j FROM st s JOIN w ON w.doc_id = s.doc_id AND w.page = s.page AND w.rn = s.rn + 1))
SELECT {KEY}, word_id, row FROM st""")
def rows_dynamic(t: Tables) -> DataFrame:
    return P.rows_dynamic(words(t)).select(*J.KEY, "word_id", "row")


@query("j6_rows_by_overlap", f"""
WITH RECURSIVE w AS (SELECT {KEY}, word_id, y0 AS a, y1 AS b, row_number() OVER (PARTITION BY {KEY} ORDER BY word_id) AS rn FROM {WORDS}),
st AS (
  SELECT {KEY}, rn, word_id, [{{'lo': a, 'hi': b}}] AS open_rows, 0::BIGINT AS row FROM w WHERE rn = 1
  UNION ALL
  SELECT doc_id, page, rn, word_id,
    CASE WHEN hit IS NULL THEN list_append(open_rows, {{'lo': a, 'hi': b}})
         ELSE list_transform(open_rows, lambda s, i: CASE WHEN i = hit THEN {{'lo': least(s.lo, a), 'hi': greatest(s.hi, b)}} ELSE s END) END,
    COALESCE(hit, len(open_rows) + 1) - 1
  FROM (SELECT w.*, st.open_rows, list_min(list_filter(list_transform(st.open_rows, lambda s, i:
      CASE WHEN least(w.b, s.hi) > greatest(w.a, s.lo) AND (least(w.b, s.hi) - greatest(w.a, s.lo)) / (greatest(w.b, s.hi) - least(w.a, s.lo)) >= 0.7 THEN i END),
      lambda k: k IS NOT NULL)) AS hit
    FROM st JOIN w ON w.doc_id = st.doc_id AND w.page = st.page AND w.rn = st.rn + 1))
SELECT {KEY}, word_id, row FROM st""")
def rows_by_overlap(t: Tables) -> DataFrame:
    return P.rows_by_overlap(words(t)).select(*J.KEY, "word_id", "row")


def rounded(n: int) -> str:
    return f"(round_even({YC} * {n}, 0) / {n})"


def numbered(src: str, key: str) -> str:
    return f"(SELECT *, dense_rank() OVER (PARTITION BY {KEY} ORDER BY {key}) - 1 AS row FROM {src})"


@query("j7_rows_rounded", f"SELECT {KEY}, word_id, row FROM {numbered(UNIT, rounded(50))}")
def rows_rounded(t: Tables) -> DataFrame:
    return J.with_row_number(unit(t), J.rounded_y(50)).select(*J.KEY, "word_id", "row")


EDGES = f"(SELECT {KEY}, x0, max(x1) AS x1 FROM {WORDS} GROUP BY {KEY}, x0)"
LEFT_COLS = f"""(SELECT {KEY}, col, x0, COALESCE(lead(x0) OVER (PARTITION BY {KEY} ORDER BY col) - 10, max(x1) OVER (PARTITION BY {KEY})) AS x1
  FROM (SELECT {KEY}, col, avg(x0) AS x0, max(x1) AS x1 FROM {islands(EDGES, 'x0', 6.0, 'col')} GROUP BY {KEY}, col))"""
LEFT_COLS = LEFT_COLS.replace("- 10,", "- 6.0::DOUBLE,")


@query("j8_columns_by_left_edge", f"SELECT {KEY}, col, round(x0, 9) AS x0, round(x1, 9) AS x1 FROM {LEFT_COLS}")
def columns_by_left_edge(t: Tables) -> DataFrame:
    return J.columns_by_left_edge(words(t), 6.0).withColumns(r9("x0", "x1"))


def leaders(placed: str, tol: float, least_rows: int) -> str:
    """Clusters of centres, left to right, joined to the first cluster whose mean is near; ``placed`` has x and row."""
    return f"""
WITH RECURSIVE c AS ({placed}),
d AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY x) AS rn FROM (SELECT DISTINCT {KEY}, x FROM c)),
st AS (
  SELECT {KEY}, rn, [{{'total': x, 'n': 1}}] AS clusters FROM d WHERE rn = 1
  UNION ALL
  SELECT doc_id, page, rn, CASE WHEN hit IS NULL THEN list_append(clusters, {{'total': x, 'n': 1}})
    ELSE list_transform(clusters, lambda s, i: CASE WHEN i = hit THEN {{'total': s.total + x, 'n': s.n + 1}} ELSE s END) END
  FROM (SELECT d.*, st.clusters, list_min(list_filter(list_transform(st.clusters, lambda s, i: CASE WHEN abs(d.x - s.total / s.n) <= {tol} THEN i END), lambda k: k IS NOT NULL)) AS hit
    FROM st JOIN d ON d.doc_id = st.doc_id AND d.page = st.page AND d.rn = st.rn + 1)),
m AS (SELECT {KEY}, k.total / k.n AS x FROM (SELECT {KEY}, unnest(arg_max(clusters, rn)) AS k FROM st GROUP BY {KEY})),
n AS (SELECT m.doc_id, m.page, m.x, count(DISTINCT c.row) AS row_support FROM m JOIN c ON c.doc_id = m.doc_id AND c.page = m.page AND abs(c.x - m.x) <= {tol} GROUP BY ALL)
SELECT {KEY}, row_number() OVER (PARTITION BY {KEY} ORDER BY x, row_support) - 1 AS col, round(x, 9) AS x, row_support FROM n WHERE row_support >= {least_rows}"""


@query("j9_leader_columns", leaders(f"""SELECT u.doc_id, u.page, {XC} AS x, r.row FROM {UNIT} u
  JOIN ({ORACLES['j2_row_bands']}) r ON r.doc_id = u.doc_id AND r.page = u.page AND r.word_id = u.word_id""", 0.05, 3))
def leader_columns(t: Tables) -> DataFrame:
    return P.leader_columns(J.row_bands(unit(t), 0.015), 0.05, 3).withColumns(r9("x"))


WEIGHTED = f"""(SELECT {KEY}, row_number() OVER (PARTITION BY {KEY} ORDER BY x, weight) - 1 AS col, x, weight, false AS ruled FROM (
  SELECT *, bool_or(keep) OVER (PARTITION BY {KEY}) AS anyone FROM (
    SELECT {KEY}, sum(x * n) / sum(n) AS x, CAST(sum(n) AS BIGINT) AS weight, sum(n) >= any_value(nrows) * 0.1 AS keep
    FROM (SELECT *, sum(opens) OVER (PARTITION BY {KEY} ORDER BY x ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT s.*, f.nrows, CASE WHEN x - lag(x) OVER (PARTITION BY {KEY} ORDER BY x) >= greatest(f.font * 0.6::DOUBLE * 3, 15.0) THEN 1 ELSE 0 END AS opens
      FROM (SELECT {KEY}, floor(x0 + 0.5) AS x, count(*) AS n FROM {WORDS} GROUP BY ALL) s
      JOIN (SELECT {KEY}, avg(f) AS font, count(*) AS nrows FROM (SELECT {KEY}, y0, arg_min(font_size, word_id) AS f FROM {WORDS} GROUP BY {KEY}, y0) GROUP BY {KEY}) f USING ({KEY})))
    GROUP BY {KEY}, run)) WHERE keep OR NOT anyone)"""


def line_rows(t: Tables) -> DataFrame:
    return words(t).withColumn("row", (F.col("y0") / S.LINE_H).cast("long"))


@query("j10_weighted_columns", f"SELECT {KEY}, col, round(x, 9) AS x, weight, ruled FROM {WEIGHTED}")
def weighted_columns(t: Tables) -> DataFrame:
    return J.weighted_columns(line_rows(t)).withColumns(r9("x"))


@query("j10_weighted_columns_ruled")
def weighted_columns_ruled(t: Tables) -> DataFrame:
    w = line_rows(t)
    hints = w.select(*J.KEY).distinct().select(*J.KEY, F.explode(F.array(F.lit(90.0), F.lit(271.0), F.lit(450.0))).alias("x"))
    return J.weighted_columns(w, hints).withColumns(r9("x"))


SPOTS = f"(SELECT DISTINCT {KEY}, row, {XC} AS x FROM {ROWS})"
RUNS = f"(SELECT {KEY}, run, avg(x) AS cx FROM {islands(SPOTS, 'x', 0.004, 'run', 'pos, row')} GROUP BY {KEY}, run)"
CONSENSUS = f"""(SELECT {KEY}, row_number() OVER (PARTITION BY {KEY} ORDER BY cx) - 1 AS col, cx AS x, row_support FROM (
  SELECT *, bool_or(ok) OVER (PARTITION BY {KEY}) AS anyone, min(cx) OVER (PARTITION BY {KEY}) AS first FROM (
    SELECT r.doc_id, r.page, r.cx, count(DISTINCT s.row) AS row_support, count(DISTINCT s.row) >= floor(any_value(n.n) * 0.6) AS ok
    FROM {RUNS} r JOIN (SELECT {KEY}, count(DISTINCT row) AS n FROM {SPOTS} GROUP BY {KEY}) n USING ({KEY})
    LEFT JOIN {SPOTS} s ON s.doc_id = r.doc_id AND s.page = r.page AND abs(s.x - r.cx) <= 0.004 GROUP BY r.doc_id, r.page, r.cx)) WHERE ok OR (NOT anyone AND cx = first))"""


@query("j11_consensus_columns", f"SELECT {KEY}, col, round(x, 9) AS x, row_support FROM {CONSENSUS}")
def consensus_columns(t: Tables) -> DataFrame:
    return P.consensus_columns(unit(t), 0.015, 0.004).withColumns(r9("x"))


def medians(spots: str, tol: float) -> str:
    return f"(SELECT {KEY}, col, list_sort(list(x))[len(list(x)) // 2 + 1] AS x FROM {islands(spots, 'x', tol, 'col')} GROUP BY {KEY}, col)"


HEADS = f"(SELECT {KEY}, row FROM {ROWS} GROUP BY {KEY}, row HAVING avg(font_size) > 12)"
HEAD_SPOTS = f"""(SELECT DISTINCT {KEY}, unnest([x0, x1, {XC}]) AS x FROM {ROWS} r WHERE EXISTS (SELECT 1 FROM {HEADS} h WHERE h.doc_id = r.doc_id AND h.page = r.page AND h.row = r.row)
  OR (r.row = 0 AND NOT EXISTS (SELECT 1 FROM {HEADS} h WHERE h.doc_id = r.doc_id AND h.page = r.page)))"""
ANCHORS = medians(HEAD_SPOTS, 0.02)


def anchors(t: Tables) -> DataFrame:
    rows = J.row_bands(unit(t), 0.015)
    heads = rows.groupBy(*J.KEY, "row").agg(F.avg("font_size").alias("f")).where("f > 12").drop("f")
    return J.header_anchors(rows, heads)


@query("j12_header_anchors", f"SELECT * FROM {ANCHORS}")
def header_anchors(t: Tables) -> DataFrame:
    return anchors(t)


GLOBAL = medians(f"(SELECT DISTINCT {KEY}, {XC} AS x FROM {UNIT})", 0.004)


@query("j13_global_columns", f"SELECT {KEY}, word_id, CASE WHEN distance <= 0.02 THEN col ELSE last + 1 END AS col, round(distance, 9) AS distance FROM {nearest(UNIT, GLOBAL)} JOIN (SELECT {KEY}, max(col) AS last FROM {GLOBAL} GROUP BY {KEY}) USING ({KEY})")
def global_columns(t: Tables) -> DataFrame:
    w = unit(t)
    return J.assign_or_new(w, J.global_columns(w, 0.004), 0.02).select(*J.KEY, "word_id", "col", F.round("distance", 9).alias("distance"))


@query("j14_column_count", f"""
WITH RECURSIVE w AS (SELECT {KEY}, {XC} AS x, row_number() OVER (PARTITION BY {KEY} ORDER BY {XC}) AS rn, count(*) OVER (PARTITION BY {KEY}) AS n FROM {UNIT}),
st AS (SELECT {KEY}, rn, n, 0::BIGINT AS c, x AS total, 1::BIGINT AS k FROM w WHERE rn = 1
  UNION ALL SELECT w.doc_id, w.page, w.rn, w.n, CASE WHEN abs(w.x - s.total / s.k) <= 0.02::DOUBLE THEN s.c ELSE s.c + CASE WHEN s.k >= 2 THEN 1 ELSE 0 END END,
    CASE WHEN abs(w.x - s.total / s.k) <= 0.02::DOUBLE THEN s.total + w.x ELSE w.x END, CASE WHEN abs(w.x - s.total / s.k) <= 0.02::DOUBLE THEN s.k + 1 ELSE 1 END
  FROM st s JOIN w ON w.doc_id = s.doc_id AND w.page = s.page AND w.rn = s.rn + 1)
SELECT {KEY}, CASE WHEN n < 3 THEN 1 ELSE c + CASE WHEN k >= 2 THEN 1 ELSE 0 END END AS columns FROM st WHERE rn = n""")
def column_count(t: Tables) -> DataFrame:
    return P.column_count(unit(t))


NATIVE_MARK = "|"


@query("j14_native_columns", f"""
SELECT {KEY}, COALESCE(n.native, c.columns) AS columns, n.native IS NOT NULL AS from_native FROM ({ORACLES['j14_column_count']}) c LEFT JOIN (
  SELECT {KEY}, max(n) AS native FROM (SELECT {KEY}, row, count(*) AS n FROM
    (SELECT DISTINCT {KEY}, CAST(y0 / {S.LINE_H} AS BIGINT) AS row, CAST(floor(x0 / 180) AS BIGINT) AS col, bool_or(contains(text, '{NATIVE_MARK}')) OVER (PARTITION BY {KEY}) AS marked FROM {WORDS})
    WHERE marked GROUP BY {KEY}, row) GROUP BY {KEY} HAVING max(n) >= 2) n USING ({KEY})""")
def native_columns(t: Tables) -> DataFrame:
    """Pages with a bar in some word count as having a native table: its cells are the thirds of their lines."""
    placed = line_rows(t).withColumn("col", F.floor(F.col("x0") / 180).cast("long"))
    pages = placed.groupBy(*J.KEY).agg(F.bool_or(F.col("text").contains(NATIVE_MARK)).alias("marked")).where("marked")
    native = placed.select(*J.KEY, "row", "col").distinct().join(pages, J.KEY, "left_semi").withColumn("table_id", F.lit(0))
    return P.detected_columns(unit(t), native)


@query("j11_nearest_band", f"""
WITH b AS (SELECT {KEY}, row, avg({YC}) AS y FROM {ROWS} GROUP BY {KEY}, row),
c AS (SELECT {KEY}, word_id, {YC} + CAST(word_id % 9 AS DOUBLE) / 701.0::DOUBLE AS yc FROM {UNIT}),
n AS (SELECT c.doc_id, c.page, c.word_id, arg_min({{'row': b.row, 'd': abs(b.y - c.yc)}}, (abs(b.y - c.yc), b.row)) AS near FROM c JOIN b ON b.doc_id = c.doc_id AND b.page = c.page GROUP BY c.doc_id, c.page, c.word_id)
SELECT {KEY}, word_id, near.row AS row FROM n WHERE near.d <= 0.012""")
def nearest_band(t: Tables) -> DataFrame:
    """Words that lie a little below their line, against the bands of the lines."""
    bands = J.row_bands(unit(t), 0.015).groupBy(*J.KEY, "row").agg(F.avg((F.col("y0") + F.col("y1")) / 2).alias("y"))
    shift = (F.col("word_id") % 9).cast("double") / 701.0
    moved = unit(t).withColumns({"y0": J.y_center() + shift, "y1": J.y_center() + shift}).select(*J.KEY, "word_id", "y0", "y1")
    return J.nearest_band(moved, bands, 0.012).select(*J.KEY, "word_id", "row")


@query("j15_assign_nearest", f"SELECT {KEY}, word_id, col, round(distance, 9) AS distance FROM {nearest(UNIT, ANCHORS)}")
def assign_nearest(t: Tables) -> DataFrame:
    return J.assign_nearest(unit(t), anchors(t)).select(*J.KEY, "word_id", "col", F.round("distance", 9).alias("distance"))


@query("j15_assign_interval", f"""SELECT {KEY}, word_id, COALESCE(list_filter(cols, lambda k: (k.a <= x0 AND x0 <= k.b) OR (x0 < k.b AND x1 > k.a))[1].c,
  list_min(list_transform(cols, lambda k: {{'d': abs(x0 - k.a), 'c': k.c}})).c) AS col
FROM {WORDS} JOIN (SELECT {KEY}, list_sort(list({{'c': col, 'a': x0, 'b': x1}})) AS cols FROM {LEFT_COLS} GROUP BY {KEY}) USING ({KEY})""")
def assign_interval(t: Tables) -> DataFrame:
    w = words(t)
    return J.assign_interval(w, J.columns_by_left_edge(w, 6.0)).select(*J.KEY, "word_id", "col")


@query("j16_snap_to_anchors", f"""SELECT {KEY}, word_id, ok AS snapped, CASE WHEN ok THEN col END AS col, round(CASE WHEN ok THEN anchor_x ELSE {XC} END, 9) AS snapped_x
FROM (SELECT *, COALESCE(distance <= CASE WHEN confidence < 0.7 THEN 0.01::DOUBLE ELSE 0.02::DOUBLE END, false) AS ok FROM {nearest(UNIT, ANCHORS)})""")
def snap_to_anchors(t: Tables) -> DataFrame:
    return J.snap_to_anchors(unit(t), anchors(t), F.col("confidence")).select(
        *J.KEY, "word_id", "snapped", "col", F.round("snapped_x", 9).alias("snapped_x"))


def pages(t: Tables) -> DataFrame:
    """One plan per query, written once: lines and rectangles both come from it."""
    if "page_table" not in vars(t):
        t.page_table = dealt_as_words(t, settled(words(t).select(*J.KEY).distinct()))
    return t.page_table


def ruled_lines(t: Tables) -> DataFrame:
    """Two upright lines on every third page, one level line on every fifth."""
    k = F.col("doc_id") + F.col("page")
    line = lambda a, b, c, d, h: F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (a, b, c, d))],
                                          F.lit(h).alias("is_horizontal"), F.lit(not h).alias("is_vertical"))
    none = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double,is_horizontal:boolean,is_vertical:boolean>>")
    both = F.concat(F.when(k % 3 == 0, F.array(line(180, 0, 180, 600, False), line(360, 0, 360, 600, False))).otherwise(none),
                    F.when(k % 5 == 0, F.array(line(0, 120, 540, 120, True))).otherwise(none))
    return pages(t).select(*J.KEY, F.inline(both))


def rectangles(t: Tables) -> DataFrame:
    marked = pages(t).where((F.col("doc_id") + F.col("page")) % 4 == 0)
    return marked.select(*J.KEY, F.lit(60.0).alias("x0"), F.lit(60.0).alias("y0"), F.lit(480.0).alias("x1"), F.lit(300.0).alias("y1"))


def grid(t: Tables) -> DataFrame:
    return J.grid_boundaries(words(t), ruled_lines(t), rectangles(t), S.PAGE_W)


@query("j17_grid_boundaries")
def grid_boundaries(t: Tables) -> DataFrame:
    """Every border of columns and rows, with the confidence of its page."""
    borders = F.array(F.struct(F.lit("column").alias("axis"), F.col("columns").alias("at")), F.struct(F.lit("row").alias("axis"), F.col("rows").alias("at")))
    each = grid(t).select(*J.KEY, F.round("confidence", 9).alias("confidence"), F.explode(borders).alias("b"))
    return each.select(*J.KEY, "confidence", "b.axis", F.posexplode("b.at").alias("pos", "border"))


@query("j18_snap_text_to_grid")
def snap_text_to_grid(t: Tables) -> DataFrame:
    return J.snap_text_to_grid(words(t), dealt_as_words(t, settled(grid(t))))


ZONED = f"""(SELECT w.*, CASE WHEN y0 <= lo + (hi - lo) * 0.1::DOUBLE THEN 'header' WHEN y1 >= hi - (hi - lo) * 0.1::DOUBLE THEN 'footer' END AS zone
  FROM {WORDS} w JOIN (SELECT {KEY}, min(y0) AS lo, max(y1) AS hi FROM {WORDS} GROUP BY {KEY}) USING ({KEY}))"""


@query("j19_repeated_edges", f"""SELECT doc_id, zone, trim(text, ' ') AS text, count(*) AS times, any_value(n) AS pages
FROM {ZONED} JOIN (SELECT doc_id, count(DISTINCT page) AS n FROM {WORDS} GROUP BY doc_id) USING (doc_id)
WHERE zone IS NOT NULL AND n >= 2 GROUP BY doc_id, zone, trim(text, ' ') HAVING count(*) >= any_value(n) * 0.5""")
def repeated_edges(t: Tables) -> DataFrame:
    return J.repeated_edges(words(t))


@query("j19_suppressed_on_page", f"""SELECT {KEY}, word_id, text FROM (SELECT *, count(*) OVER (PARTITION BY {KEY}, zone, lower(trim(text, ' '))) AS n FROM (
  SELECT *, CASE WHEN y0 < {S.PAGE_H * 0.1} THEN 'header' WHEN y0 > {S.PAGE_H * 0.9} THEN 'footer' ELSE 'body' END AS zone FROM {WORDS})) WHERE zone = 'body' OR n <= 2""")
def suppressed_on_page(t: Tables) -> DataFrame:
    return J.suppress_repeated_on_page(words(t), S.PAGE_H).select(*J.KEY, "word_id", "text")


@query("j20_two_column_split", f"""SELECT {KEY}, "left", middle, "right", unnest(range(0, len(bs))) AS pos, unnest(bs) AS bound FROM (
  SELECT {KEY}, greatest(0.0, xs[1] - 20) AS "left", xs[len(xs) // 2 + 1] AS middle, least({S.PAGE_W}::DOUBLE, xs[-1] + 20) AS "right",
    list_sort(list_distinct(ys || [greatest(list_max(ys), {S.PAGE_H}::DOUBLE), least(list_min(ys), 0.0)])) AS bs
  FROM (SELECT {KEY}, list_sort(list(x0)) AS xs, list_distinct(list(y0)) AS ys FROM {WORDS} GROUP BY {KEY}))""")
def two_column_split(t: Tables) -> DataFrame:
    """The columns of each page with every border of its rows."""
    split = J.two_column_split(words(t), S.PAGE_W, S.PAGE_H)
    bounds = F.posexplode(F.array_sort("row_bounds")).alias("pos", "bound")
    return split.select(*J.KEY, "left", "middle", "right", bounds).withColumn("pos", F.col("pos").cast("long"))


@query("j21_logical_cells")
def logical_cells(t: Tables) -> DataFrame:
    return P.logical_cells(words(t)).select(*J.KEY, "word_id", "cell")


def merged_runs(joins: str, shown: str) -> str:
    """Words by y, then x; ``joins`` tells from block ``b`` and word ``w`` whether the word joins the block before it."""
    return f"""
WITH RECURSIVE w AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY y0, x0, word_id) AS rn FROM {UNIT}),
st AS (
  SELECT {KEY}, rn, 1 AS g, word_id, text, x0, y0, x1, y1 FROM w WHERE rn = 1
  UNION ALL
  SELECT doc_id, page, rn, CASE WHEN joins THEN g ELSE g + 1 END, CASE WHEN joins THEN first_id ELSE word_id END,
    CASE WHEN joins THEN trim(before || ' ' || text) ELSE text END, CASE WHEN joins THEN least(bx0, x0) ELSE x0 END,
    CASE WHEN joins THEN least(by0, y0) ELSE y0 END, CASE WHEN joins THEN greatest(bx1, x1) ELSE x1 END, CASE WHEN joins THEN greatest(by1, y1) ELSE y1 END
  FROM (SELECT w.*, b.g, b.word_id AS first_id, b.text AS before, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1, {joins} AS joins
    FROM st b JOIN w ON w.doc_id = b.doc_id AND w.page = b.page AND w.rn = b.rn + 1))
SELECT {KEY}, any_value(word_id) AS word_id, arg_max(text, rn) AS text, round(arg_max({shown}, rn), 9) AS {shown} FROM st GROUP BY {KEY}, g"""


SPACED_ID = "(contains({0}, ' ') AND length(regexp_replace({0}, '[^0-9]', '', 'g')) BETWEEN 10 AND 12)"


@query("j22_merge_numeric", merged_runs(
    "abs((b.y0 + b.y1) - (w.y0 + w.y1)) / 2 <= (b.y1 - b.y0) * 0.5::DOUBLE AND w.x0 - b.x1 <= 0.05 AND "
    f"({SPACED_ID.format('b.text')} OR {SPACED_ID.format('w.text')})", "x1"))
def merge_numeric(t: Tables) -> DataFrame:
    return P.merge_numeric_pieces(unit(t)).select(*J.KEY, "word_id", "text", F.round("x1", 9).alias("x1"))


@query("j23_merge_vertical", merged_runs(
    "w.y0 - b.y1 <= (b.y1 - b.y0) * 0.8::DOUBLE AND abs((b.x0 + b.x1) - (w.x0 + w.x1)) / 2 < (b.x1 - b.x0) * 0.5::DOUBLE", "y1"))
def merge_vertical(t: Tables) -> DataFrame:
    return P.merge_vertical(unit(t)).select(*J.KEY, "word_id", "text", F.round("y1", 9).alias("y1"))


def cells(t: Tables) -> DataFrame:
    """Three cells per text line: words by thirds of the page width."""
    placed = line_rows(t).withColumn("col", F.floor(F.col("x0") / 180).cast("long"))
    return placed.groupBy(*J.KEY, "row", "col").agg(
        J.ordered_text().alias("value"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"),
        F.max("y1").alias("y1"), F.bool_and("bold").alias("bold"), F.min("font_size").alias("font_size"), F.min("confidence").alias("confidence"))


CELLS = f"""(SELECT {KEY}, row, col, string_agg(text, ' ' ORDER BY word_id) AS value, min(x0) AS x0, max(x1) AS x1,
  min(y0) AS y0, max(y1) AS y1, bool_and(bold) AS bold, min(font_size) AS font_size, min(confidence) AS confidence
  FROM (SELECT *, CAST(y0 / {S.LINE_H} AS BIGINT) AS row, CAST(floor(x0 / 180) AS BIGINT) AS col FROM {WORDS}) GROUP BY {KEY}, row, col)"""


@query("j24_merge_multiline", f"""
WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY {KEY}, col ORDER BY row) AS rn FROM {CELLS}),
st AS (
  SELECT {KEY}, col, rn, row, value, y0, y1, y1 AS bottom, 1 AS g FROM c WHERE rn = 1
  UNION ALL
  SELECT c.doc_id, c.page, c.col, c.rn, c.row, c.value, c.y0, c.y1,
    CASE WHEN abs(c.y0 - st.bottom) <= 5 THEN greatest(st.bottom, c.y1) ELSE c.y1 END, st.g + CASE WHEN abs(c.y0 - st.bottom) <= 5 THEN 0 ELSE 1 END
  FROM st JOIN c ON c.doc_id = st.doc_id AND c.page = st.page AND c.col = st.col AND c.rn = st.rn + 1)
SELECT {KEY}, min(row) AS row, col, md5(string_agg(value, ' ' ORDER BY row)) AS value_md5, min(y0) AS y0, max(y1) AS y1 FROM st GROUP BY {KEY}, col, g""")
def merge_multiline(t: Tables) -> DataFrame:
    out = J.merge_multiline(cells(t))
    return out.select(*J.KEY, "row", "col", F.md5("value").alias("value_md5"), "y0", "y1")


LINE_CELLS = f"(SELECT *, CAST(floor(x0 / 180) AS BIGINT) AS col FROM (SELECT *, CAST(floor(y0 / 24) AS BIGINT) AS row FROM {WORDS}))"


#: A page is of mixed languages if it has words with and words without letters beyond ASCII.
FOREIGN = r"[^\x00-\x7F]"


@query("j25_merge_lines", rf"""
WITH RECURSIVE h AS (SELECT {KEY}, avg(y1 - y0) AS lh, bool_or(regexp_matches(text, '{FOREIGN}')) AND NOT bool_and(regexp_matches(text, '{FOREIGN}')) AS mixed
  FROM {WORDS} GROUP BY {KEY}),
w AS (SELECT *, {YC} AS yc, CASE WHEN mixed THEN lh * (0.6::DOUBLE * 1.5::DOUBLE) ELSE lh * 0.6::DOUBLE END AS near,
  row_number() OVER (PARTITION BY {KEY}, row, col ORDER BY word_id) AS rn
  FROM (SELECT *, CAST(floor(y0 / 40) AS BIGINT) AS row, CAST(floor(x0 / 180) AS BIGINT) AS col FROM {WORDS}) JOIN h USING ({KEY})),
st AS (
  SELECT {KEY}, row, col, rn, word_id, text, confidence, x0, x1, y0, y1, [yc] AS openers, 1::BIGINT AS g FROM w WHERE rn = 1
  UNION ALL
  SELECT doc_id, page, row, col, rn, word_id, text, confidence, x0, x1, y0, y1,
    CASE WHEN hit IS NULL THEN list_append(openers, yc) ELSE openers END, COALESCE(hit, len(openers) + 1)
  FROM (SELECT w.*, st.openers, list_min(list_filter(list_transform(st.openers, lambda y, i: CASE WHEN abs(w.yc - y) < w.near THEN i END), lambda k: k IS NOT NULL)) AS hit
    FROM st JOIN w ON w.doc_id = st.doc_id AND w.page = st.page AND w.row = st.row AND w.col = st.col AND w.rn = st.rn + 1))
SELECT {KEY}, row, col, string_agg(text, ' ' ORDER BY word_id) AS value, min(confidence) AS confidence, min(x0) AS x0, max(x1) AS x1,
  min(y0) AS y0, max(y1) AS y1, count(*) AS parts FROM st GROUP BY {KEY}, row, col, g""")
def merge_lines(t: Tables) -> DataFrame:
    placed = words(t).withColumns({"row": F.floor(F.col("y0") / 40).cast("long"), "col": F.floor(F.col("x0") / 180).cast("long")})
    foreign, page = F.col("text").rlike(FOREIGN), W.partitionBy(*J.KEY)
    return J.merge_lines(placed, mixed=F.bool_or(foreign).over(page) & ~F.bool_and(foreign).over(page))


@query("j26_join_continued_lines", rf"""
WITH RECURSIVE c AS (SELECT {KEY}, row, col, value, NOT bold AND row <> 0 AND value <> '' AND length(value) < 80 AND NOT regexp_matches(bare, '[.!?।]$') AS may, bare,
    row_number() OVER (PARTITION BY {KEY}, col ORDER BY row) AS rn FROM (SELECT *, regexp_replace(value, '^\s+|\s+$', '', 'g') AS bare FROM {CELLS})),
n AS (SELECT c.*, COALESCE(c.may AND b.value <> '' AND NOT (regexp_matches(c.bare, '^\p{{Nd}}+$') AND regexp_matches(b.bare, '^\p{{Nd}}+$')), false) AS wants, b.value AS below
  FROM c LEFT JOIN c b ON b.doc_id = c.doc_id AND b.page = c.page AND b.col = c.col AND b.row = c.row + 1),
st AS (
  SELECT {KEY}, col, rn, row, wants AS takes, CASE WHEN wants THEN value || ' ' || below ELSE value END AS value FROM n WHERE rn = 1
  UNION ALL
  SELECT n.doc_id, n.page, n.col, n.rn, n.row, n.wants AND NOT (st.takes AND n.row = st.row + 1),
    CASE WHEN st.takes AND n.row = st.row + 1 THEN '' WHEN n.wants THEN n.value || ' ' || n.below ELSE n.value END
  FROM st JOIN n ON n.doc_id = st.doc_id AND n.page = st.page AND n.col = st.col AND n.rn = st.rn + 1)
SELECT {KEY}, row, col, value FROM st WHERE regexp_matches(value, '\S')""")
def join_continued_lines(t: Tables) -> DataFrame:
    return P.join_continued_lines(cells(t))


@query("j27_header_rows", f"""SELECT {KEY}, row, round(score, 9) AS score, score >= 2 AS is_header FROM (
  SELECT {KEY}, row, CASE WHEN row < 3 THEN 2.0 ELSE 0.0 END::DOUBLE + CASE WHEN f >= 10 THEN 1.5 ELSE 0.0 END::DOUBLE + CASE WHEN f > 12 THEN 1.0 ELSE 0.0 END::DOUBLE + b * 2
    + CASE WHEN h > m * 1.2::DOUBLE THEN 1.0 ELSE 0.0 END::DOUBLE AS score
  FROM (SELECT {KEY}, row, avg(font_size) AS f, avg(CAST(bold AS INTEGER)) AS b, avg(y1 - y0) AS h FROM {LINE_CELLS} GROUP BY {KEY}, row)
  JOIN (SELECT {KEY}, avg(y1 - y0) AS m FROM {WORDS} GROUP BY {KEY}) USING ({KEY}))""")
def header_rows(t: Tables) -> DataFrame:
    placed = words(t).withColumn("row", F.floor(F.col("y0") / 24).cast("long"))
    return J.header_row_scores(placed).withColumns(r9("score"))


@query("j28_first_row_header", f"SELECT {KEY}, row, col, row = 0 AS is_header FROM {CELLS}")
def first_row_header(t: Tables) -> DataFrame:
    return J.first_row_header(cells(t)).select(*J.KEY, "row", "col", "is_header")


@query("j29_spans", f"""SELECT {KEY}, row, word_id,
  CASE WHEN x1 - x0 > avg(x1 - x0) OVER p * 1.5::DOUBLE THEN greatest(1, CAST(round_even((x1 - x0) / avg(x1 - x0) OVER q, 0) AS BIGINT)) ELSE 1 END AS colspan,
  CASE WHEN y1 - y0 > avg(y1 - y0) OVER p * 1.5::DOUBLE THEN greatest(1, CAST(round_even((y1 - y0) / avg(y1 - y0) OVER p, 0) AS BIGINT)) ELSE 1 END AS rowspan
FROM {LINE_CELLS} WINDOW p AS (PARTITION BY {KEY}), q AS (PARTITION BY {KEY}, row)""")
def spans(t: Tables) -> DataFrame:
    placed = words(t).withColumn("row", F.floor(F.col("y0") / 24).cast("long"))
    return J.spans(placed).select(*J.KEY, "row", "word_id", "colspan", "rowspan")


def holed(t: Tables) -> DataFrame:
    """Cells of which every fourth has lost its box."""
    lost = (F.col("row") + F.col("col")) % 4 == 0
    return cells(t).withColumns({c: F.when(~lost, F.col(c)) for c in ("x0", "y0", "x1", "y1")})


@query("j30_match_cells", rf"""
WITH lines AS (SELECT {KEY}, row, min(word_id) AS word_id, string_agg(text, ' ' ORDER BY word_id) AS text, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1
  FROM (SELECT *, CAST(y0 / {S.LINE_H} AS BIGINT) AS row FROM {WORDS}) GROUP BY {KEY}, row),
b AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) AS ws FROM (
  SELECT *, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS t FROM lines) WHERE t <> ''),
c AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(v, '\s+'), lambda w: w <> '')) AS vs FROM (
  SELECT DISTINCT {KEY}, lower(regexp_replace(value, '^\s+|\s+$', '', 'g')) AS v FROM {CELLS} WHERE trim(value, ' ') <> '')),
s AS (SELECT c.doc_id, c.page, c.v, b.word_id, CASE WHEN v = t THEN 1.0::DOUBLE WHEN contains(v, t) OR contains(t, v) THEN 0.8::DOUBLE
    ELSE len(list_intersect(vs, ws))::DOUBLE / (len(vs) + len(ws) - len(list_intersect(vs, ws))) END AS score
  FROM c JOIN b USING ({KEY})),
m AS (SELECT {KEY}, v, arg_max(word_id, (score, -word_id)) AS matched_word FROM s WHERE score > 0.7 GROUP BY {KEY}, v)
SELECT e.doc_id, e.page, e.row, e.col, m.matched_word, l.x0, l.y0, l.x1, l.y1 FROM {CELLS} e
LEFT JOIN m ON m.doc_id = e.doc_id AND m.page = e.page AND m.v = lower(regexp_replace(e.value, '^\s+|\s+$', '', 'g')) AND trim(e.value, ' ') <> ''
LEFT JOIN lines l ON l.doc_id = e.doc_id AND l.page = e.page AND l.word_id = m.matched_word""")
def match_cells(t: Tables) -> DataFrame:
    bare_cells = cells(t).withColumns({c: F.lit(None).cast("double") for c in ("x0", "y0", "x1", "y1")})
    lines = line_rows(t).groupBy(*J.KEY, "row").agg(
        F.min("word_id").alias("word_id"), J.ordered_text().alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"),
        F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    return J.match_cells_to_blocks(bare_cells, lines).select(*J.KEY, "row", "col", "matched_word", "x0", "y0", "x1", "y1")


@query("j31_fill_boxes", f"""
WITH RECURSIVE h AS (SELECT {KEY}, row, col, CASE WHEN (row + col) % 4 <> 0 THEN {{'a': x0, 'b': y0, 'c': x1, 'd': y1}} END AS box FROM {CELLS}),
s AS (SELECT {KEY}, max(row) AS rows, max(col) + 1 AS cols, sum(box.c - box.a) / count(box) AS w, sum(box.d - box.b) / count(box) AS t FROM h GROUP BY {KEY} HAVING count(box) > 0),
g AS (SELECT s.doc_id, s.page, s.cols, s.w, s.t, r, c, r * s.cols + c AS i, h.box FROM (SELECT *, unnest(range(0, cols)) AS c FROM (SELECT *, unnest(range(0, rows + 1)) AS r FROM s)) s
  LEFT JOIN h ON h.doc_id = s.doc_id AND h.page = s.page AND h.row = s.r AND h.col = s.c),
st AS (
  SELECT {KEY}, i, [box] AS boxes FROM g WHERE i = 0
  UNION ALL
  SELECT doc_id, page, i, list_append(boxes, CASE WHEN box IS NOT NULL THEN box
    WHEN lft IS NOT NULL THEN {{'a': lft.c, 'b': lft.b, 'c': lft.c + w, 'd': lft.d}}
    WHEN up IS NOT NULL THEN {{'a': up.a, 'b': up.d, 'c': up.c, 'd': up.d + t}}
    WHEN diag IS NOT NULL THEN {{'a': diag.c, 'b': diag.d, 'c': diag.c + w, 'd': diag.d + t}} END)
  FROM (SELECT g.*, st.boxes, CASE WHEN g.c > 0 THEN st.boxes[g.i] END AS lft, CASE WHEN g.r > 0 THEN st.boxes[g.i - g.cols + 1] END AS up,
      CASE WHEN g.c > 0 AND g.r > 0 THEN st.boxes[g.i - g.cols] END AS diag
    FROM st JOIN g ON g.doc_id = st.doc_id AND g.page = st.page AND g.i = st.i + 1))
SELECT f.doc_id, f.page, g.r AS row, g.c AS col, round(f.box.a, 9) AS x0, round(f.box.b, 9) AS y0, round(f.box.c, 9) AS x1, round(f.box.d, 9) AS y1, g.box IS NULL AS inferred
FROM (SELECT {KEY}, unnest(range(0, len(boxes))) AS i, unnest(boxes) AS box FROM (SELECT {KEY}, arg_max(boxes, i) AS boxes FROM st GROUP BY {KEY})) f
JOIN g ON g.doc_id = f.doc_id AND g.page = f.page AND g.i = f.i WHERE f.box IS NOT NULL""")
def fill_boxes(t: Tables) -> DataFrame:
    return P.fill_boxes(holed(t)).withColumns(r9("x0", "x1", "y0", "y1"))


def ocr_blocks(t: Tables) -> DataFrame:
    """A block list as a recognition service returns it: one table per turn, a row of role and text."""
    cell = t.conversations.select("conv_id", "turn", F.posexplode(F.array("role", "text")).alias("c", "v")).select(
        F.col("conv_id").alias("doc_id"), "turn", "c", F.concat_ws("-", F.lit("c"), "turn", "c").alias("id"), F.split("v", " ").alias("ws"))
    no_ids, no_int = F.lit(None).cast("array<string>"), F.lit(None).cast("int")
    tables = cell.where("c = 0").select("doc_id", F.concat_ws("-", F.lit("t"), "turn").alias("id"), F.lit("TABLE").alias("block_type"),
        no_int.alias("row_index"), no_int.alias("column_index"), F.lit(None).cast("string").alias("text"),
        F.array(F.concat_ws("-", F.lit("c"), "turn", F.lit(0)), F.concat_ws("-", F.lit("c"), "turn", F.lit(1))).alias("children"))
    word_id = lambda i: F.concat_ws("-", F.lit("w"), F.col("turn"), F.col("c"), i)
    cells_ = cell.select("doc_id", "id", F.lit("CELL").alias("block_type"), F.lit(1).alias("row_index"), (F.col("c") + 1).alias("column_index"),
        F.lit(None).cast("string").alias("text"), F.transform("ws", lambda w, i: word_id(i)).alias("children"))
    words_ = cell.select("doc_id", "turn", "c", F.posexplode("ws").alias("i", "text")).select("doc_id", word_id(F.col("i")).alias("id"),
        F.lit("WORD").alias("block_type"), no_int.alias("row_index"), no_int.alias("column_index"), "text", no_ids.alias("children"))
    return tables.unionByName(cells_).unionByName(words_)


@query("j32_block_tree_cells", """SELECT conv_id AS doc_id, 't-' || turn AS table_id, 0 AS row, c AS col, trim(v, ' ') AS value
FROM (SELECT conv_id, turn, unnest([0, 1]) AS c, unnest([role, text]) AS v FROM conversations)""")
def block_tree_cells(t: Tables) -> DataFrame:
    return J.block_tree_cells(ocr_blocks(t))


@query("j33_left_right", f"""SELECT *, blocks >= 4 AND left_blocks >= 2 AND right_blocks >= 2 AS label_value, blocks >= 6 AND aligned_rows >= 3 AS row_grid FROM (
  SELECT {KEY}, CAST(sum(n) AS BIGINT) AS blocks, CAST(sum(l) AS BIGINT) AS left_blocks, CAST(sum(r) AS BIGINT) AS right_blocks, count(*) FILTER (WHERE n >= 2) AS aligned_rows FROM (
    SELECT {KEY}, {rounded(50)} AS yk, count(*) AS n, count(*) FILTER (WHERE x0 < 0.3) AS l, count(*) FILTER (WHERE {XC} > 0.7) AS r FROM {UNIT} GROUP BY ALL) GROUP BY {KEY})""")
def left_right(t: Tables) -> DataFrame:
    return J.left_right_alignment(unit(t))


BANDS = leaders(f"SELECT {KEY}, {XC} AS x, row FROM {numbered(UNIT, rounded(50))}", 0.08, 1)
CANDIDATES = f"""(
  WITH w AS (SELECT {KEY}, {XC} AS x, {rounded(50)} AS r, length(text) - length(regexp_replace(text, '\\p{{Nd}}', '', 'g')) AS digits, length(text) AS size, contains(text, ' ') AS spaced FROM {UNIT}),
  r AS (SELECT {KEY}, r, count(*) AS n, list_sort(list_distinct(list(x))) AS xs,
      CAST(sum(CAST(digits BETWEEN 10 AND 12 AND spaced AS INTEGER) + CAST(digits BETWEEN 4 AND 9 AND size <= 20 AS INTEGER)) AS BIGINT) AS num FROM w GROUP BY {KEY}, r),
  a AS (SELECT *, n >= 2 AND len(xs) >= 2 AND COALESCE(list_bool_or(list_transform(range(2, len(xs) + 1), lambda i: xs[i] - xs[i - 1] >= 0.05)), false) AS wide FROM r),
  f AS (SELECT {KEY}, CAST(sum(n) AS BIGINT) AS blocks, count(*) FILTER (WHERE wide) AS aligned_rows, CAST(COALESCE(sum(num) FILTER (WHERE n >= 2), 0) AS BIGINT) AS numeric_blocks,
    CAST(len(list_distinct(flatten(list(CASE WHEN wide THEN xs ELSE [] END)))) AS BIGINT) AS positions,
    CAST(sum(CASE WHEN wide THEN len(xs) ELSE 0 END) AS BIGINT) AS position_count FROM a GROUP BY {KEY}),
  v AS (SELECT {KEY}, count(*) AS vertical_bands FROM ({BANDS}) WHERE row_support >= 2 GROUP BY {KEY})
  SELECT *, blocks >= 30 AND aligned_rows >= 3 AND position_count >= 10 AND vertical_bands >= 2 AND numeric_blocks >= 2 AS is_candidate
  FROM (SELECT f.*, COALESCE(v.vertical_bands, 0) AS vertical_bands FROM f LEFT JOIN v USING ({KEY})))"""


@query("j34_table_candidate", f"SELECT * FROM {CANDIDATES}")
def table_candidate(t: Tables) -> DataFrame:
    return J.measured_facts(unit(t)).select(*J.CANDIDATE)


@query("j36_key_value_halves", f"""SELECT * FROM (SELECT {KEY}, row, trim(COALESCE(string_agg(text, ' ' ORDER BY {XC}, word_id) FILTER (WHERE {XC} < 0.5), ''), ' ') AS key,
  trim(COALESCE(string_agg(text, ' ' ORDER BY {XC}, word_id) FILTER (WHERE {XC} >= 0.5), ''), ' ') AS value FROM {ORDERED} GROUP BY {KEY}, row) WHERE key <> '' OR value <> ''""")
def key_value_halves(t: Tables) -> DataFrame:
    return J.key_value_halves(J.rows_in_order(unit(t), 0.015))


PLACED = f"""(SELECT {KEY}, row, col, string_agg(text, ' ' ORDER BY x0, word_id) AS value, bool_or(contains(text, ':')) AS colon
  FROM {nearest(numbered(UNIT, rounded(100)), ANCHORS)} GROUP BY {KEY}, row, col)"""


@query("j37_key_value_columns", f"""
WITH f AS (SELECT doc_id, 1 AS page, 'n ' || doc_id AS name, lang AS value FROM documents WHERE doc_id % 2 = 0)
SELECT {KEY}, CASE WHEN p.page = 1 AND p.doc_id % 2 = 0 THEN row + 1 ELSE row END AS row, col, value, col = 0 OR colon AS is_label FROM {PLACED} p
UNION ALL SELECT doc_id, page, 0, 0, name, true FROM f UNION ALL SELECT doc_id, page, 0, 1, value, false FROM f""")
def key_value_columns(t: Tables) -> DataFrame:
    fields = t.documents.where("doc_id % 2 = 0").select(
        "doc_id", F.lit(1).cast("long").alias("page"), F.lit(0).alias("n"), F.concat(F.lit("n "), "doc_id").alias("name"), F.col("lang").alias("value"))
    return P.key_value_columns(unit(t), 0.015, fields=dealt_as_words(t, fields))


LABELLED = ["Name: x", "plain line", "Total : 12:30", ": no label"]


@query("j37_label_value_lines", f"""
WITH l AS (SELECT doc_id, line_no, trim(line, ' ') AS line, trim(regexp_extract(line, '^([^:]*):', 1), ' ') AS lab FROM (
    SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM (SELECT doc_id, string_split(text || chr(10) || list_extract({text_list(LABELLED)}, doc_id % 4 + 1) || chr(10) || 'more', chr(10)) AS ls FROM documents)) WHERE trim(line, ' ') <> ''),
g AS (SELECT *, sum(CASE WHEN lab <> '' OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) - 1 AS row FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rn FROM l))
SELECT doc_id, CAST(row AS BIGINT) AS row, md5(max(CASE WHEN lab <> '' THEN lab WHEN rn = 1 THEN line END)) AS label_md5,
  md5(trim(string_agg(CASE WHEN lab <> '' THEN trim(substr(line, instr(line, ':') + 1), ' ') WHEN rn = 1 THEN '' ELSE line END, ' ' ORDER BY line_no), ' ')) AS value_md5 FROM g GROUP BY doc_id, row""")
def label_value_lines(t: Tables) -> DataFrame:
    extra = F.element_at(F.array(*map(F.lit, LABELLED)), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = t.documents.select("doc_id", F.concat_ws("\n", "text", extra, F.lit("more")).alias("text"))
    return J.label_value_lines(docs).select("doc_id", "row", F.md5("label").alias("label_md5"), F.md5("value").alias("value_md5"))


@query("j38_body_rows", f"""SELECT {KEY}, count(*) AS rows, count(*) FILTER (WHERE row > 0 AND n >= 2) AS body_rows FROM (
  SELECT {KEY}, row, count(*) AS n FROM {numbered(UNIT, rounded(50))} GROUP BY {KEY}, row) GROUP BY {KEY}""")
def body_rows(t: Tables) -> DataFrame:
    return J.body_rows_for_soft_mode(unit(t))


@query("j38_soft_table")
def soft_table(t: Tables) -> DataFrame:
    return P.soft_table(unit(t))


@query("j39_visual_grid")
def visual_grid(t: Tables) -> DataFrame:
    return J.visual_grid(dealt_as_words(t, P.numeric_pieces_and_columns(unit(t), 50, 0.05, 3)))


@query("j39_hybrid_grid")
def hybrid_grid(t: Tables) -> DataFrame:
    return J.visual_grid(dealt_as_words(t, P.numeric_pieces_and_columns(unit(t), 100, 0.06)), 0.08)


def spanning(t: Tables) -> DataFrame:
    """Order lines as table cells with spans."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") - 1).cast("long").alias("row"), (F.col("l_suppkey") % 3).alias("col"),
        F.when(F.col("l_quantity") > 40, 2).otherwise(1).alias("rowspan"), F.when(F.col("l_discount") > 0.08, 2).otherwise(1).alias("colspan"),
        (F.col("l_returnflag") == "R").alias("bold"),
        F.when(F.col("l_linenumber") != 2, ((F.col("l_linenumber") - 1) * 10 + F.col("l_suppkey") % 3) / 100.0).alias("x0"))


SPANNING = """(SELECT l_orderkey AS table_id, CAST(l_linenumber - 1 AS BIGINT) AS row, l_suppkey % 3 AS col, CASE WHEN l_quantity > 40 THEN 2 ELSE 1 END AS rowspan,
  CASE WHEN l_discount > 0.08 THEN 2 ELSE 1 END AS colspan, l_returnflag = 'R' AS bold,
  CASE WHEN l_linenumber <> 2 THEN ((l_linenumber - 1) * 10 + l_suppkey % 3) / 100.0::DOUBLE END AS x0 FROM lineitem)"""
COVERED = f"""(SELECT table_id, r, c, count(*) AS covers FROM (SELECT table_id, r, unnest(range(col, col + colspan)) AS c FROM (
  SELECT *, unnest(range(row, row + rowspan)) AS r FROM {SPANNING})) GROUP BY ALL)"""


@query("j40_span_conflicts", f"SELECT *, conflicts > 0 AS span_conflict FROM (SELECT table_id, count(*) AS positions, count(*) FILTER (WHERE covers > 1) AS conflicts FROM {COVERED} GROUP BY table_id)")
def span_conflicts(t: Tables) -> DataFrame:
    return J.span_conflicts(spanning(t), ["table_id"])


@query("j41_grid_integrity", f"""SELECT *, covered = rows * cols AND conflicts = 0 AS is_valid FROM (SELECT table_id, max(r) + 1 AS rows, max(c) + 1 AS cols, count(*) AS covered,
  count(*) FILTER (WHERE covers > 1) AS conflicts FROM {COVERED} GROUP BY table_id)""")
def grid_integrity(t: Tables) -> DataFrame:
    return J.grid_integrity(spanning(t), ["table_id"])


@query("j42_locked_columns", f"""
WITH b AS (SELECT table_id, row, avg(CAST(bold AS INTEGER)) AS b FROM {SPANNING} WHERE row < 3 GROUP BY table_id, row),
h AS (SELECT table_id, row FROM (SELECT *, row = row_number() OVER w - 1 AND min(CASE WHEN row = 0 OR b >= 0.5 THEN 1 ELSE 0 END) OVER w = 1 AS ok FROM b WINDOW w AS (PARTITION BY table_id ORDER BY row ROWS UNBOUNDED PRECEDING)) WHERE ok),
a AS (SELECT s.table_id, s.col, arg_min(s.x0, s.row) AS x FROM {SPANNING} s JOIN h USING (table_id, row) WHERE s.x0 IS NOT NULL GROUP BY 1, 2),
m AS (SELECT table_id, unnest(range(0, max(col + colspan))) AS col FROM {SPANNING} GROUP BY table_id)
SELECT m.table_id, m.col, COALESCE(a.x, m.col * 0.1::DOUBLE) AS x FROM m LEFT JOIN a USING (table_id, col)""")
def locked_columns(t: Tables) -> DataFrame:
    return J.locked_columns(spanning(t), ["table_id"])


LINE_LIST = "list_filter(list_transform(string_split(text, chr(10)), lambda v: trim(v, ' ')), lambda v: v <> '')"


@query("j43_plain_text_rows", f"SELECT doc_id, generate_subscripts(l, 1) - 1 AS row, unnest(l) AS value FROM (SELECT doc_id, {LINE_LIST} AS l FROM documents)")
def plain_text_rows(t: Tables) -> DataFrame:
    return J.plain_text_rows(t.documents)


@query("j43_index_content", f"""SELECT doc_id, row, CAST(row + 1 AS VARCHAR) AS "index", value AS content FROM (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS row, unnest(l) AS value FROM (SELECT doc_id, {LINE_LIST} AS l FROM documents))""")
def index_content(t: Tables) -> DataFrame:
    return J.index_content(t.documents)


@query("j44_resume_rows")
def resume_rows(t: Tables) -> DataFrame:
    return J.resume_rows(J.plain_text_rows(t.documents))


@query("j44_certificate_rows", f"""SELECT doc_id, row, CASE WHEN cut > 0 THEN trim(substr(value, 1, cut - 1), ' ') ELSE value END AS key,
  CASE WHEN cut > 0 THEN trim(substr(value, cut + 1), ' ') END AS value, cut = 0 AS centred
FROM (SELECT *, CASE WHEN regexp_matches(value, '[:—–]') THEN length(regexp_extract(value, '^[^:—–]*')) + 1 ELSE 0 END AS cut FROM (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS row, unnest(l) AS value FROM (SELECT doc_id, {LINE_LIST} AS l FROM documents)))""")
def certificate_rows(t: Tables) -> DataFrame:
    return J.certificate_rows(J.plain_text_rows(t.documents))


@query("j44_statement_rows")
def statement_rows(t: Tables) -> DataFrame:
    return J.statement_rows(J.rows_in_order(unit(t), 0.015))


@query("j44_generic_rows", f"""SELECT {KEY}, row, word_id, CASE WHEN n = 1 THEN c ELSE last + 1 END AS col, text AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEY}, row, c ORDER BY x0, word_id) AS n FROM (
    SELECT *, CASE WHEN distance <= 0.02 THEN col ELSE last + 1 END AS c FROM {nearest(ORDERED, GLOBAL)} JOIN (SELECT {KEY}, max(col) AS last FROM {GLOBAL} GROUP BY {KEY}) USING ({KEY})))""")
def generic_rows(t: Tables) -> DataFrame:
    w = unit(t)
    return J.generic_rows(J.rows_in_order(w, 0.015), J.global_columns(w, 0.004))


ALIGNED = f"(SELECT *, floor(x0 + 0.5) AS xr, floor(y0 / 3 + 0.5) * 3 AS yr FROM {WORDS} WHERE trim(text, ' ') <> '')"
ALIGNED_COLS = f"(SELECT {KEY}, col, floor(avg(x) + 0.5) AS x FROM {islands(f'(SELECT DISTINCT {KEY}, xr AS x FROM {ALIGNED})', 'x', 8.0, 'col', cmp='>=')} GROUP BY {KEY}, col)"


@query("j45_aligned_table", f"""SELECT {KEY}, row, CASE WHEN distance < 30 THEN col ELSE 0 END AS col, string_agg(trim(text, ' '), ' ' ORDER BY xr, word_id) AS value
FROM {nearest(f'(SELECT * FROM (SELECT *, max(row) OVER (PARTITION BY {KEY}) AS last FROM {numbered(ALIGNED, "yr")}) WHERE last >= 1)', ALIGNED_COLS, 'xr')}
GROUP BY {KEY}, row, CASE WHEN distance < 30 THEN col ELSE 0 END""")
def aligned_table(t: Tables) -> DataFrame:
    return J.aligned_table(words(t), gap=8.0)
