"""Quality, routing and page-set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.functions.exprs import first_rule
from quillmeter.operators import layout as J
from quillmeter.operators import pagesets as M
from quillmeter.operators import profile as I
from quillmeter.operators import qa as L
from quillmeter.plans.cell_queries import FILLED, SHEET, sheet
from quillmeter.plans.layout_queries import CANDIDATES, CELLS, KEY, cells, unit
from quillmeter.plans.profile_queries import BY_NAME, TEXTS, texts, words
from quillmeter.plans.registry import Tables, query
from quillmeter.plans.wordsql import WORDS
from quillmeter.sources import words as S


def labels(*pairs: tuple[str, str]) -> str:
    items = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in pairs)
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ';')"


def unit_cells(t: Tables) -> DataFrame:
    return J.unit_page(cells(t), S.PAGE_W, S.PAGE_H)


XC = f"((x0 / {S.PAGE_W}::DOUBLE + x1 / {S.PAGE_W}::DOUBLE) / 2)"
YC = f"((y0 / {S.PAGE_H}::DOUBLE + y1 / {S.PAGE_H}::DOUBLE) / 2)"
CONF = f"""(SELECT *, 0.30::DOUBLE * row_consistency + 0.30::DOUBLE * column_alignment + 0.25::DOUBLE * grid_continuity + 0.15::DOUBLE * cell_density AS confidence FROM (
  SELECT {KEY}, CASE WHEN nrows < 2 THEN 0.5 ELSE least(1.0, greatest(0.0, 1 - std / (mean + 1e-6::DOUBLE))) END AS row_consistency,
    least(1.0, greatest(0.0, 1 - spread / 0.05::DOUBLE)) AS column_alignment, CAST(nfull AS DOUBLE) / nrows AS grid_continuity, least(1.0, cells / ((lr + 1) * (lc + 1))) AS cell_density
  FROM (SELECT {KEY}, avg(step) AS mean, stddev_pop(step) AS std, count(*) AS nrows, max(row) AS lr, any_value(lc) AS lc, sum(n) AS cells, count(*) FILTER (WHERE cols = lc + 1) AS nfull FROM (
      SELECT *, abs(y - lag(y) OVER (PARTITION BY {KEY} ORDER BY row)) AS step, max(last) OVER (PARTITION BY {KEY}) AS lc FROM (
        SELECT {KEY}, row, avg({YC}) AS y, count(DISTINCT col) AS cols, max(col) AS last, count(*) AS n FROM {CELLS} GROUP BY {KEY}, row)) GROUP BY {KEY})
  JOIN (SELECT {KEY}, avg(s) AS spread FROM (SELECT {KEY}, col, max({XC}) - min({XC}) AS s FROM {CELLS} GROUP BY {KEY}, col) GROUP BY {KEY}) USING ({KEY})))"""


@query("l1_table_confidence", f"SELECT {KEY}, round(row_consistency, 8) AS row_consistency, round(column_alignment, 8) AS column_alignment, round(grid_continuity, 8) AS grid_continuity, round(cell_density, 8) AS cell_density, round(confidence, 8) AS confidence FROM {CONF}")
def table_confidence(t: Tables) -> DataFrame:
    out = L.table_confidence(unit_cells(t))
    return out.select(*J.KEY, *[F.round(c, 8).alias(c) for c in out.columns[2:]])


@query("l2_simple_table_confidence", """SELECT o_orderkey, round(CASE WHEN h + b = 0 OR greatest(hc, bc) = 0 THEN 0.3 ELSE least(1.0, (h + b) / 10) * 0.4
  + CASE WHEN h > 0 AND b > 0 THEN 1 - least(1.0, abs(hc - bc) / greatest(hc, bc, 1)) ELSE 0.8 END * 0.3 + CASE WHEN h > 0 AND b > 0 THEN 1.0 WHEN h + b >= 3 THEN 0.6 ELSE 0.0 END * 0.3 END::DOUBLE, 9) AS confidence
FROM (SELECT o_orderkey, CAST(o_orderkey % 2 AS DOUBLE) AS h, CAST(o_custkey % 12 AS DOUBLE) AS b, CAST(o_orderkey % 5 AS DOUBLE) AS hc, CAST(o_custkey % 4 AS DOUBLE) AS bc FROM orders)""")
def simple_table_confidence(t: Tables) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select("o_orderkey", F.round(L.simple_table_confidence(o % 2, c % 12, o % 5, c % 4), 9).alias("confidence"))


@query("l3_mean_cell_confidence", f"""SELECT {KEY}, round(greatest(0.0, avg(confidence) - CAST(count(*) FILTER (WHERE confidence < 0.7) AS DOUBLE) / count(*) * 0.2::DOUBLE), 9) AS table_confidence FROM {CELLS} GROUP BY {KEY}""")
def mean_cell_confidence(t: Tables) -> DataFrame:
    return L.mean_cell_confidence(cells(t)).withColumn("table_confidence", F.round("table_confidence", 9))


SHAPES = f"(SELECT {KEY}, count(*) AS rows, max(n) AS max_cols FROM (SELECT {KEY}, row, count(*) AS n FROM {SHEET} GROUP BY {KEY}, row) GROUP BY {KEY})"


def shapes(t: Tables) -> DataFrame:
    rows = sheet(t).groupBy(*J.KEY, "row").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy(*J.KEY).agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("max_cols"))


WARNED = f"(SELECT *, {labels(('rows = 0', 'empty'), ('rows > 3 AND max_cols = 1', 'single_column'), ('rows > 500', 'many_rows'))} AS page_warnings FROM {SHAPES})"


@query("l4_layout_warnings", f"SELECT * FROM {WARNED}")
def layout_warnings(t: Tables) -> DataFrame:
    return L.layout_warnings(shapes(t))


RUNS = f"""(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'adobe' ELSE 'docai' END AS engine, doc_id % 2 = 0 AS premium, (doc_id % 100) / 100.0::DOUBLE AS confidence,
  doc_id % 70 AS pages, w AS page_warnings, doc_id % 5 > 0 AS has_gates, doc_id % 7 AS gates_passed, CASE WHEN doc_id % 4 = 0 THEN doc_id % 70 + 1 ELSE doc_id % 70 END AS estimated_pages, doc_id % 11 > 3 AS no_structural_failure
  FROM (SELECT doc_id, count(*) FILTER (WHERE page_warnings <> '') AS w FROM {WARNED} GROUP BY doc_id))"""


def runs(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    per_doc = L.layout_warnings(shapes(t)).groupBy("doc_id").agg(F.count_if(F.col("page_warnings") != "").alias("page_warnings"))
    return per_doc.select(
        "doc_id", F.when(d % 3 == 0, "adobe").otherwise("docai").alias("engine"), (d % 2 == 0).alias("premium"), ((d % 100) / 100.0).alias("confidence"),
        (d % 70).alias("pages"), "page_warnings", (d % 5 > 0).alias("has_gates"), (d % 7).alias("gates_passed"),
        F.when(d % 4 == 0, d % 70 + 1).otherwise(d % 70).alias("estimated_pages"), (d % 11 > 3).alias("no_structural_failure"))


FB = "engine = 'adobe'"
STATUS = f"""(SELECT *, CASE WHEN errors <> '' THEN 'FAIL' WHEN warnings <> '' THEN 'WARN' ELSE 'PASS' END AS qa_status FROM (SELECT *,
  {labels((f'{FB} AND NOT premium', 'fallback_without_premium'), (f'NOT ({FB}) AND premium AND confidence < 0.65 AND NOT (has_gates AND no_structural_failure)', 'premium_without_fallback'), ('page_warnings > 0', 'layout'))} AS warnings,
  {labels((f'{FB} AND pages > 50', 'page_limit'), (f'NOT ({FB} AND pages > 50) AND {FB} AND has_gates AND estimated_pages <> pages', 'page_estimate'))} AS errors,
  CASE WHEN NOT ({FB}) THEN 'not_needed' WHEN NOT has_gates THEN 'no_gates' WHEN gates_passed < 5 THEN 'gates_missing' ELSE 'all_gates' END AS fallback_safety FROM {RUNS}))"""


@query("l4_conversion_status", f"SELECT * FROM {STATUS}")
def conversion_status(t: Tables) -> DataFrame:
    return L.conversion_status(runs(t))


@query("l5_quality_gate", f"SELECT {KEY}, max(row) > 0 AND max(col) > 0 AND count(*) FILTER (WHERE {FILLED}) > 0 AS passes FROM {SHEET} GROUP BY {KEY}")
def quality_gate(t: Tables) -> DataFrame:
    from quillmeter.operators.cells import sheet_shape

    shape = sheet_shape(sheet(t))
    return shape.select(*J.KEY, L.passes_quality_gate(F.col("max_row"), F.col("max_col"), F.col("filled")).alias("passes"))


@query("l6_determinism_hash", f"""SELECT doc_id, substr(md5('doc-' || doc_id || '|' || engine || '|' || printf('%.4f', confidence) || '|' || CASE WHEN premium THEN 'True' ELSE 'False' END), 1, 16) AS hash FROM {RUNS}""")
def determinism_hash(t: Tables) -> DataFrame:
    named = runs(t).withColumn("name", F.concat(F.lit("doc-"), "doc_id"))
    return named.select("doc_id", L.determinism_hash("name", "engine", "confidence", "premium").alias("hash"))


COMPLEX = f"""(SELECT *, CASE WHEN complexity >= 0.7 THEN 'HIGH' WHEN complexity >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM (
  SELECT doc_id, blocks, round(least(1.0::DOUBLE, blocks / 150.0::DOUBLE) * 0.4::DOUBLE + CASE WHEN doc_id % 2 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END * 0.3::DOUBLE + least(1.0::DOUBLE, std / mean * 0.5::DOUBLE) * 0.3::DOUBLE, 9) AS complexity
  FROM (SELECT doc_id, count(*) AS blocks, avg((x1 - x0) * (y1 - y0)) AS mean, COALESCE(stddev_samp((x1 - x0) * (y1 - y0)), 0.0) AS std FROM {WORDS} GROUP BY doc_id)))"""


@query("l7_visual_complexity", f"SELECT * FROM {COMPLEX}")
def visual_complexity(t: Tables) -> DataFrame:
    tables = t.documents.select("doc_id", (F.col("doc_id") % 2 == 0).alias("has_tables"))
    return L.visual_complexity(words(t), tables)


PAIR = r"'^[^:]*[^:\s][^:]*:[^:]*[^:\s][^:]*$'"
EXTRA = "chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'a: 1' || chr(10) || 'b: 2' || chr(10) || 'c : 3' ELSE 'd: e' END"
ELIGIBLE = f"""(SELECT *, kv_blocked_by IS NULL AS kv_eligible, CASE WHEN kv_blocked_by IS NULL THEN CASE WHEN doc_type IN ('invoice', 'bill', 'bank_statement') THEN 0.9 WHEN fields > 0 THEN 0.8 ELSE 0.7 END ELSE 0.0 END::DOUBLE AS kv_confidence
  FROM (SELECT *, CASE WHEN columns > 1 THEN 'columns' WHEN table_confidence >= 0.4 THEN 'table_confidence' WHEN kv_lines < 3 THEN 'few_pairs' WHEN row_grid THEN 'row_grid' END AS kv_blocked_by
  FROM (SELECT doc_id, {BY_NAME} AS doc_type, doc_id % 3 AS columns, (doc_id % 10) / 10.0::DOUBLE AS table_confidence, doc_id % 2 AS fields, doc_id % 5 = 0 AS row_grid,
    len(list_filter(string_split(text || {EXTRA}, chr(10)), lambda x: regexp_matches(x, {PAIR}))) AS kv_lines
    FROM (SELECT *, lower(text) AS low, lower(filename) AS name FROM {TEXTS}))))"""


def eligible(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    extra = F.when(d % 3 == 0, "a: 1\nb: 2\nc : 3").otherwise("d: e")
    facts = texts(t).select(
        "doc_id", I.type_by_name("text", "filename").alias("doc_type"), (d % 3).alias("columns"), ((d % 10) / 10.0).alias("table_confidence"),
        (d % 2).alias("fields"), (d % 5 == 0).alias("row_grid"), L.label_value_lines(F.concat_ws("\n", "text", extra)).alias("kv_lines"))
    return L.key_value_eligibility(facts)


@query("l9_key_value_eligibility", f"SELECT * FROM {ELIGIBLE}")
def key_value_eligibility(t: Tables) -> DataFrame:
    return eligible(t)


BILLS = "('invoice', 'bill', 'bank_statement')"
ROUTES = [
    ("form_parser", "'GEOMETRIC_HYBRID'", "0.95"), ("columns >= 2 AND vt > 0 AND has_cells", "'TABLE_STRICT'", "least(1.0, vt * 0.3 + 0.6)"),
    ("columns >= 2 AND vt > 0", "'TABLE_VISUAL'", "0.8"), ("columns >= 2 AND digital AND visual", "'TABLE_VISUAL'", "least(1.0, vc + 0.2)"),
    ("columns >= 2", "'TABLE_VISUAL'", "0.7"), ("vt > 0 AND NOT has_cells", "'TABLE_VISUAL'", "0.8"),
    (f"vt > 0 AND dt IN {BILLS}", "'TABLE_STRICT'", "least(1.0, vt * 0.3 + 0.5)"), ("vt > 0", "'TABLE_STRICT'", "least(1.0, vt * 0.3 + 0.4)"),
    ("digital AND visual AND vc >= 0.8", "'TABLE_VISUAL'", "vc"), ("pages = 1 AND label_value", "'KEY_VALUE'", "0.95"), ("kv_eligible", "'KEY_VALUE'", "kv_confidence"),
]


@query("l8_route", f"""SELECT doc_id, CASE {' '.join(f'WHEN {c} THEN {m}' for c, m, _ in ROUTES)} ELSE 'PLAIN_TEXT' END AS mode,
  round(CASE {' '.join(f'WHEN {c} THEN {v}' for c, _, v in ROUTES)} ELSE 0.5 END::DOUBLE, 9) AS route_confidence
FROM (SELECT *, doc_id % 13 = 0 AS form_parser, CASE WHEN doc_id % 7 > 4 THEN doc_id % 7 - 4 ELSE 0 END AS vt, doc_id % 2 = 0 AS has_cells, CASE WHEN doc_id % 2 = 1 THEN 'digital_pdf' ELSE doc_type END AS dt,
  doc_id % 2 = 1 AS digital, doc_id % 5 < 2 AS visual, (doc_id % 10) / 10.0::DOUBLE AS vc, doc_id % 4 AS pages, doc_id % 6 = 1 AS label_value FROM {ELIGIBLE})""")
def route(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    docs = eligible(t).withColumns({
        "form_parser": d % 13 == 0, "valid_tables": F.when(d % 7 > 4, d % 7 - 4).otherwise(0), "has_cells": d % 2 == 0,
        "doc_type": F.when(d % 2 == 1, "digital_pdf").otherwise(F.col("doc_type")), "visual": d % 5 < 2, "visual_confidence": (d % 10) / 10.0,
        "pages": d % 4, "label_value": d % 6 == 1})
    return L.route(docs).select("doc_id", "mode", F.round("route_confidence", 9).alias("route_confidence"))


@query("l8_route_measured")
def route_measured(t: Tables) -> DataFrame:
    """The same rules on facts measured from the words: columns, alignment, visual table and text."""
    facts = L.visual_table_confidence(J.measured_facts(unit(t))).groupBy("doc_id").agg(
        F.max("columns").alias("columns"), F.count(F.lit(1)).alias("pages"), F.bool_or("label_value").alias("label_value"),
        F.bool_or("row_grid").alias("row_grid"), F.bool_or("is_candidate").alias("visual"), F.max("visual_confidence").alias("visual_confidence"))
    text = texts(t).select("doc_id", I.document_type("text", F.lit(False)).alias("doc_type"), L.label_value_lines("text").alias("kv_lines"))
    docs = text.join(facts, "doc_id").withColumns(
        {"form_parser": F.lit(False), "valid_tables": F.lit(0), "has_cells": F.lit(False), "table_confidence": F.lit(0.0), "fields": F.lit(0)})
    return L.route(L.key_value_eligibility(docs)).select("doc_id", "columns", "doc_type", "mode", F.round("route_confidence", 9).alias("route_confidence"))


@query("l10_mean_word_confidence", f"SELECT doc_id, avg(CAST(round(confidence * 100) AS BIGINT)) FILTER (WHERE confidence > 0) AS mean_confidence FROM {WORDS} GROUP BY doc_id")
def mean_word_confidence(t: Tables) -> DataFrame:
    """In whole per cent, so that the mean is one exact division and does not depend on the order of addition."""
    return L.mean_word_confidence(words(t).withColumn("confidence", F.round(F.col("confidence") * 100).cast("long")))


@query("l11_run_summary", f"SELECT qa_status AS status, count(*) AS runs FROM {STATUS} GROUP BY qa_status")
def run_summary(t: Tables) -> DataFrame:
    return L.run_summary(L.conversion_status(runs(t)).withColumnRenamed("qa_status", "status"))


FAILING = f"""(SELECT *, {labels(('rows > 0 AND columns = 1 AND blocks > 5 AND x_span > 0.3', 'single_column_collapse'), ('rows >= 5 AND columns = 1 AND blocks > 10 AND x_span > 0.4', 'multi_column_collapse'),
    ('merged_cells >= 3', 'complex_merges'), ('blocks > 100 AND font_sizes >= 4', 'visual_complexity'), ("doc_type IN ('bank_statement', 'govt_form', 'utility_bill')", 'complex_type'))} AS failures
  FROM (SELECT doc_id, count(*) AS blocks, max((x0 + x1) / 2) / {S.PAGE_W}::DOUBLE - min((x0 + x1) / 2) / {S.PAGE_W}::DOUBLE AS x_span, count(DISTINCT font_size) AS font_sizes,
    doc_id % 9 AS rows, 1 + doc_id % 2 AS columns, doc_id % 5 AS merged_cells, CASE WHEN doc_id % 8 = 0 THEN 'bank_statement' ELSE 'letter' END AS doc_type FROM {WORDS} GROUP BY doc_id))"""


def failing(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    docs = L.page_spans(words(t), S.PAGE_W).drop("bold_words").withColumns({
        "rows": d % 9, "columns": 1 + d % 2, "merged_cells": d % 5, "doc_type": F.when(d % 8 == 0, "bank_statement").otherwise("letter")})
    return L.structural_failures(docs)


@query("l12_structural_failures", f"SELECT doc_id, failures FROM {FAILING}")
def structural_failures(t: Tables) -> DataFrame:
    return failing(t).select("doc_id", "failures")


G1, G2 = "wants", "(wants AND confidence < 0.3)"
BROKEN = "(failures <> '' OR (columns = 1 AND rows - 1 > 5 AND blocks > 10 AND x_span > 0.4))"
G3 = f"({G2} AND {BROKEN})"
G5 = f"({G3} AND pages <= 50)"


@query("l13_fallback_gates", f"""SELECT doc_id, {labels((G1, 'premium_toggle_on'), (G2, 'very_low_confidence'), (G3, 'structural_failures'), (G3, 'page_count_ok'), (G5, 'within_cost_caps'))} AS gates_passed,
  {labels(('NOT wants', 'premium_toggle_off'), (f'wants AND NOT {G2}', 'confidence_too_high'), (f'{G2} AND NOT {G3}', 'no_structural_failures'), (f'{G3} AND pages > 20', 'excessive_pages'), (f'{G3} AND NOT {G5}', 'page_limit_exceeded'))} AS gates_failed,
  {G5} AS allowed, CASE WHEN {G5} THEN pages ELSE 0 END AS estimated_pages, CASE WHEN {G5} THEN least(pages, 10) * 15 + greatest(pages - 10, 0) * 5 ELSE 0 END AS estimated_credits
FROM (SELECT *, doc_id % 4 > 0 AS wants, (doc_id % 10) / 20.0 AS confidence, doc_id % 60 AS pages FROM {FAILING})""")
def fallback_gates(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    docs = failing(t).withColumns({"wants_premium": d % 4 > 0, "confidence": (d % 10) / 20.0, "pages": d % 60, "max_row": F.col("rows") - 1, "max_col": F.col("columns") - 1})
    return L.fallback_gates(docs).select("doc_id", "gates_passed", "gates_failed", "allowed", "estimated_pages", "estimated_credits")


@query("l14_simple_fallback", f"""SELECT doc_id, doc_id % 3 > 0 AND (doc_id % 100) / 100.0 < 0.65 AND complexity >= 0.6 AS use_fallback FROM {COMPLEX}""")
def simple_fallback(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    plan = F.when(d % 3 > 0, "premium").otherwise("free")
    return visual_complexity(t).select("doc_id", L.simple_fallback(plan, (d % 100) / 100.0, F.col("complexity")).alias("use_fallback"))


@query("l15_visual_table_confidence", f"""SELECT *, round(CASE WHEN is_candidate THEN least(1.0, aligned_rows / 10.0::DOUBLE * 0.4::DOUBLE
  + vertical_bands / 5.0::DOUBLE * 0.3::DOUBLE + numeric_blocks / 10.0::DOUBLE * 0.3::DOUBLE) ELSE 0.0 END, 9) AS visual_confidence FROM {CANDIDATES}""")
def visual_table_confidence(t: Tables) -> DataFrame:
    return L.visual_table_confidence(J.measured_facts(unit(t)).select(*J.CANDIDATE)).withColumn("visual_confidence", F.round("visual_confidence", 9))


def pages(t: Tables) -> DataFrame:
    return t.conversations.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), "role")


PAGES = "(SELECT conv_id AS doc_id, turn + 1 AS page_no, role FROM conversations)"
DOCS = "(SELECT DISTINCT conv_id AS doc_id FROM conversations)"


def docs(t: Tables) -> DataFrame:
    return t.conversations.select(F.col("conv_id").alias("doc_id")).distinct()


@query("m1_merge_documents", f"""SELECT doc_id % 10 AS target, doc_id, page_no, role, row_number() OVER (PARTITION BY doc_id % 10 ORDER BY doc_id DESC, page_no) AS new_page FROM {PAGES}""")
def merge_documents(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return M.merge_documents(pages(t), docs(t).select((d % 10).alias("target"), "doc_id", (-d).alias("seq")))


@query("m2_split_by_ranges", f"""SELECT doc_id, page_no, role, part, page_no - a + 1 AS new_page FROM {PAGES} JOIN (VALUES (0, 1, 2), (1, 3, 5), (2, 2, 4)) r(part, a, b) ON page_no BETWEEN a AND b""")
def split_by_ranges(t: Tables) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(a).cast("long").alias("first"), F.lit(b).cast("long").alias("last")) for p, a, b in ((0, 1, 2), (1, 3, 5), (2, 2, 4))])
    return M.split_by_ranges(pages(t), docs(t).select("doc_id", F.inline(parts)))


@query("m3_split_every", f"SELECT *, (page_no - 1) // 2 AS part, (page_no - 1) % 2 + 1 AS new_page FROM {PAGES}")
def split_every(t: Tables) -> DataFrame:
    return M.split_every(pages(t), 2)


def orders(t: Tables) -> DataFrame:
    n = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("doc_id", F.sequence(F.when(F.col("doc_id") % 6 == 0, F.col("n") + 1).otherwise(F.col("n")), F.lit(1).cast("long")).alias("page_order"))


COUNTED = f"(SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM {PAGES})"


@query("m4_reorder", f"SELECT doc_id, page_no, role, n - page_no + 1 AS new_page FROM {COUNTED} WHERE doc_id % 6 <> 0")
def reorder(t: Tables) -> DataFrame:
    return M.reorder(pages(t), orders(t))


@query("m4_rejected_orders", f"SELECT doc_id, count(*) AS pages, count(*) + 1 AS listed FROM {PAGES} WHERE doc_id % 6 = 0 GROUP BY doc_id")
def rejected_orders(t: Tables) -> DataFrame:
    return M.rejected_orders(pages(t), orders(t))


@query("m5_extract", f"SELECT doc_id, page_no, role, i AS new_page FROM {PAGES} JOIN (VALUES (3, 1), (1, 2), (4, 3)) v(p, i) ON p = page_no")
def extract(t: Tables) -> DataFrame:
    return M.extract(pages(t), docs(t).select("doc_id", F.array(*[F.lit(p).cast("long") for p in (3, 1, 4)]).alias("page_list")))


@query("m6_delete", f"SELECT doc_id, page_no, role, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS new_page FROM {PAGES} WHERE doc_id % 2 = 0 OR page_no NOT IN (2, 4)")
def delete(t: Tables) -> DataFrame:
    lists = docs(t).where("doc_id % 2 <> 0").select("doc_id", F.array(*[F.lit(p).cast("long") for p in (4, 2, 99)]).alias("page_list"))
    return M.delete(pages(t), lists)


@query("m7_insert_blank", f"""
WITH s AS (SELECT doc_id, least(COALESCE(CASE WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 4 = 1 THEN 1 WHEN doc_id % 4 = 2 THEN 99 END, count(*)), count(*)) AS after FROM {PAGES} WHERE doc_id % 5 > 0 GROUP BY doc_id)
SELECT p.doc_id, page_no, role, page_no + CASE WHEN page_no > after THEN 1 ELSE 0 END AS new_page FROM {PAGES} p LEFT JOIN s USING (doc_id)
UNION ALL SELECT doc_id, NULL, NULL, after + 1 FROM s""")
def insert_blank(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 4
    spots = docs(t).where("doc_id % 5 > 0").select("doc_id", first_rule([(k == 0, F.lit(0).cast("long")), (k == 1, F.lit(1).cast("long")), (k == 2, F.lit(99).cast("long"))]).alias("after"))
    return M.insert_blank(pages(t), spots)


@query("m8_rotate", f"SELECT doc_id, page_no, role, CASE WHEN page_no = 1 THEN 0 WHEN page_no = 2 THEN 180 ELSE 90 END AS rotation FROM {PAGES}")
def rotate(t: Tables) -> DataFrame:
    turns = F.array(*[F.struct(F.lit(p).cast("long").alias("page_no"), F.lit(a).alias("angle")) for p, a in ((1, 180), (1, 90), (2, 90), (9999, 45))])
    return M.rotate(pages(t).withColumn("rotation", F.lit(90)), docs(t).select("doc_id", F.inline(turns)))
