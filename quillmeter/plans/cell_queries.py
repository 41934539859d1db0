"""Cell-table queries over sheets derived from the words of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.operators import cells as K
from quillmeter.operators import layout as J
from quillmeter.operators.profile import type_by_hits
from quillmeter.functions import doclex as D
from quillmeter.plans.layout_queries import CELLS, KEY, cells
from quillmeter.plans.profile_queries import dealt_as_words, texts
from quillmeter.plans.registry import Tables, query
from quillmeter.plans.sqltext import any_of


def sheet(t: Tables) -> DataFrame:
    """The derived cells with the irregularities of real sheets: by row number there are empty rows, labels,
    delimiters, amounts, lone cells, repeated rows and line breaks."""
    k, v = F.col("row") % 10, F.col("value")
    value = (
        F.when(k == 1, "  ").when(k == 3, F.concat(F.lit("Label: "), v)).when(k == 4, F.concat(F.lit("a | b; c | "), v))
        .when(k == 5, F.concat(F.lit("₹ "), F.col("row") * 1000, F.lit(".50"))).when((k == 6) & (F.col("col") > 0), "")
        .when(k.isin(7, 8), "same text").when(k == 9, F.concat(F.lit("Line one\n"), v)).otherwise(v))
    return cells(t).select(*J.KEY, "row", "col", value.alias("value"), F.when((k == 2) & (F.col("col") == 1), 14.0).otherwise(F.col("font_size")).alias("font_size"),
                           "bold", ((k == 7) & (F.col("col") == 0)).alias("merged"), (F.col("row") == 0).alias("is_header"))


SHEET = f"""(SELECT {KEY}, row, col, CASE row % 10 WHEN 1 THEN '  ' WHEN 3 THEN 'Label: ' || value WHEN 4 THEN 'a | b; c | ' || value WHEN 5 THEN '₹ ' || (row * 1000) || '.50'
  WHEN 6 THEN CASE WHEN col > 0 THEN '' ELSE value END WHEN 7 THEN 'same text' WHEN 8 THEN 'same text' WHEN 9 THEN 'Line one' || chr(10) || value ELSE value END AS value,
  CASE WHEN row % 10 = 2 AND col = 1 THEN 14.0::DOUBLE ELSE font_size END AS font_size, bold, row % 10 = 7 AND col = 0 AS merged, row = 0 AS is_header FROM {CELLS})"""


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


FILLED = f"{strip('value')} <> ''"
ROWS = f"(SELECT {KEY}, row, list({{'c': col, 'v': value}} ORDER BY col) AS vals, list_filter(list_transform(list(value ORDER BY col), lambda v: {strip('v')}), lambda v: v <> '') AS t FROM {SHEET} GROUP BY {KEY}, row)"
DENSE_ROW = f"dense_rank() OVER (PARTITION BY {KEY} ORDER BY row) - 1 AS row"


def rows(t: Tables) -> DataFrame:
    return K.rows_of(sheet(t))


@query("k1_drop_empty_rows", f"SELECT {KEY}, {DENSE_ROW}, col, value FROM (SELECT *, bool_or({FILLED}) OVER (PARTITION BY {KEY}, row) AS h FROM {SHEET}) WHERE h")
def drop_empty_rows(t: Tables) -> DataFrame:
    return K.drop_empty_rows(sheet(t)).select(*J.KEY, "row", "col", "value")


@query("k2_drop_sparse_columns", f"""SELECT {KEY}, row, CASE WHEN best = 0 THEN col ELSE dense_rank() OVER (PARTITION BY {KEY} ORDER BY col) - 1 END AS col, value
FROM (SELECT *, max(n) OVER (PARTITION BY {KEY}) AS best FROM (SELECT *, count(*) FILTER (WHERE {FILLED}) OVER (PARTITION BY {KEY}, col) AS n FROM {SHEET})) WHERE best = 0 OR n >= least(2, best)""")
def drop_sparse_columns(t: Tables) -> DataFrame:
    return K.drop_sparse_columns(sheet(t)).select(*J.KEY, "row", "col", "value")


@query("k3_drop_repeated_rows", f"""SELECT {KEY}, row, u.c AS col, u.v AS value FROM (SELECT {KEY}, row_number() OVER (PARTITION BY {KEY} ORDER BY row) - 1 AS row, unnest(vals) AS u FROM (
  SELECT *, lag(sig) OVER (PARTITION BY {KEY} ORDER BY row) AS before FROM (SELECT *, list_transform(vals, lambda x: {strip('x.v')}) AS sig FROM {ROWS} WHERE len(t) > 0)) WHERE before IS NULL OR before <> sig)""")
def drop_repeated_rows(t: Tables) -> DataFrame:
    return K.drop_repeated_rows(sheet(t))


def _clean_parts(v: str, mark: str) -> str:
    return f"list_filter(list_transform(string_split({v}, {mark}), lambda s: {strip('s')}), lambda s: s <> '')"


def _by_parts(source: str) -> str:
    """Rows (vals, place, p): one row for each part in p, alone in its column, or the row as it is."""
    return f"""SELECT {KEY}, row, u.c AS col, CASE WHEN part IS NULL THEN u.v WHEN u.c = place THEN part ELSE '' END AS value FROM (
  SELECT {KEY}, row_number() OVER (PARTITION BY {KEY} ORDER BY row0, i) - 1 AS row, place, part, unnest(vals) AS u FROM (
    SELECT {KEY}, s.row AS row0, place, vals, i, p[i] AS part FROM ({source}) s, unnest(range(1, COALESCE(len(p), 1) + 1)) r(i)))"""


PERIODS = "(length({0}) - length(replace({0}, '.', '')))"
SENTENCES = f"list_transform({_clean_parts('v', "'.'")}, lambda s: s || '.')"


@query("k4_split_collapsed_rows", _by_parts(f"""SELECT *, CASE WHEN needs THEN CASE WHEN contains(v, chr(10)) AND len({_clean_parts('v', 'chr(10)')}) > 0 THEN {_clean_parts('v', 'chr(10)')}
    WHEN {PERIODS.format('v')} > 2 AND NOT contains(v, chr(10)) AND len({SENTENCES}) > 1 THEN {SENTENCES} END END AS p
  FROM (SELECT *, -best.o AS place, best.v AS v FROM (SELECT *, list_sort(list_transform(vals, lambda x: {{'n': length(x.v), 'o': -x.c, 'v': x.v}}), 'DESC')[1] AS best,
    len(list_filter(vals, lambda x: {PERIODS.format('x.v')} > 2 OR contains(x.v, chr(10)) OR contains(x.v, '  '))) > 0 AS needs FROM {ROWS}))"""))
def split_collapsed_rows(t: Tables) -> DataFrame:
    return K.cells_of(K.split_collapsed_rows(rows(t)))


def _two(v: str) -> str:
    return f"(len(string_split({v}, ':')) = 2 AND {strip(f'string_split({v}, chr(58))[1]')} <> '' AND {strip(f'string_split({v}, chr(58))[2]')} <> '')"


@query("k5_split_label_value", f"""
WITH h AS (SELECT {KEY}, row, vals, list_filter(vals, lambda x: {_two('x.v')})[1] AS hit FROM {ROWS}),
c AS (SELECT {KEY}, row, hit, unnest(vals) AS u FROM h)
SELECT {KEY}, row, u.c AS col, CASE WHEN u.c = hit.c THEN {strip("string_split(hit.v, ':')[1]")} WHEN u.c = hit.c + 1 THEN {strip("string_split(hit.v, ':')[2]")} ELSE u.v END AS value FROM c
UNION ALL SELECT {KEY}, row, hit.c + 1, {strip("string_split(hit.v, ':')[2]")} FROM h WHERE hit IS NOT NULL AND len(list_filter(vals, lambda x: x.c = hit.c + 1)) = 0""")
def split_label_value(t: Tables) -> DataFrame:
    return K.cells_of(K.split_label_value(rows(t)))


@query("k6_split_delimited_rows", _by_parts(f"""SELECT *, CASE WHEN len(q) > 1 THEN q END AS p FROM (
  SELECT *, mark.c AS place, CASE WHEN contains(mark.v, '|') THEN {_clean_parts('mark.v', "'|'")} ELSE {_clean_parts('mark.v', "';'")} END AS q
  FROM (SELECT *, list_filter(vals, lambda x: contains(x.v, '|') OR contains(x.v, ';'))[1] AS mark FROM {ROWS}))"""))
def split_delimited_rows(t: Tables) -> DataFrame:
    return K.cells_of(K.split_delimited_rows(rows(t)))


@query("k7_single_column_layout", f"""SELECT *, COALESCE(single_rows / NULLIF(single_rows + multi_rows, 0) >= 0.7, false) AS is_single_column FROM (
  SELECT {KEY}, count(*) FILTER (WHERE len(t) = 1 AND vals[1].c = 0 AND {strip('vals[1].v')} <> '') AS single_rows, count(*) FILTER (WHERE len(t) > 1) AS multi_rows FROM {ROWS} GROUP BY {KEY})""")
def single_column_layout(t: Tables) -> DataFrame:
    return K.single_column_layout(rows(t))


IS_LABEL = rf"contains(t[1], ':') OR len(list_filter(string_split_regex(t[1], '\s+'), lambda w: w <> '')) <= 3 OR {any_of('lower(t[1])', K.FORM_LABEL_WORDS)}"


@query("k8_pair_form_rows", f"""
WITH RECURSIVE r AS (SELECT {KEY}, t[1] AS txt, NOT ({IS_LABEL}) AS joins, row_number() OVER (PARTITION BY {KEY} ORDER BY row) AS rn FROM {ROWS} WHERE len(t) > 0),
st AS (SELECT {KEY}, rn, txt, false AS swallowed FROM r WHERE rn = 1
  UNION ALL SELECT r.doc_id, r.page, r.rn, r.txt, r.joins AND NOT s.swallowed FROM st s JOIN r ON r.doc_id = s.doc_id AND r.page = s.page AND r.rn = s.rn + 1)
SELECT {KEY}, row_number() OVER (PARTITION BY {KEY} ORDER BY rn) - 1 AS row, txt AS label, value FROM (
  SELECT *, CASE WHEN lead(swallowed) OVER (PARTITION BY {KEY} ORDER BY rn) THEN lead(txt) OVER (PARTITION BY {KEY} ORDER BY rn) ELSE '' END AS value FROM st) WHERE NOT swallowed""")
def pair_form_rows(t: Tables) -> DataFrame:
    return K.pair_form_rows(rows(t))


@query("k9_pair_bill_rows")
def pair_bill_rows(t: Tables) -> DataFrame:
    return K.pair_bill_rows(rows(t))


@query("k10_resume_layout", f"""SELECT {KEY}, row_number() OVER (PARTITION BY {KEY} ORDER BY row, i) - 1 AS row, p.label, p.value FROM (
  SELECT {KEY}, row, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT {KEY}, row,
    list_transform(list_filter(t, lambda v: regexp_matches(v, '^([•\\-*·]|[1-5]\\.)')), lambda b: {{'label': b, 'value': ''}}) || [{{'label': t[1], 'value': array_to_string(t[2:], ' ')}}] AS l FROM {ROWS} WHERE len(t) > 0))""")
def resume_layout(t: Tables) -> DataFrame:
    return K.resume_layout(rows(t))


@query("k10_certificate_layout", f"""SELECT {KEY}, row_number() OVER (PARTITION BY {KEY} ORDER BY row, i) - 1 AS row, label, value FROM (
  SELECT {KEY}, row, t[1] AS label, unnest(l) AS value, generate_subscripts(l, 1) AS i FROM (SELECT *, CASE WHEN len(t) > 1 THEN t[2:] ELSE [''] END AS l FROM {ROWS} WHERE len(t) > 0))""")
def certificate_layout(t: Tables) -> DataFrame:
    return K.certificate_layout(rows(t))


@query("k10_letter_layout", f"""SELECT {KEY}, row_number() OVER (PARTITION BY {KEY} ORDER BY p) - 1 AS row, md5(string_agg(line, ' ' ORDER BY row)) AS label_md5, '' AS value FROM (
  SELECT *, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY} ORDER BY row ROWS UNBOUNDED PRECEDING) AS p FROM (SELECT {KEY}, row, array_to_string(t, ' ') AS line FROM {ROWS})) WHERE line <> '' GROUP BY {KEY}, p""")
def letter_layout(t: Tables) -> DataFrame:
    return K.letter_layout(rows(t)).select(*J.KEY, "row", F.md5("label").alias("label_md5"), "value")


@query("k11_generic_fixes")
def generic_fixes(t: Tables) -> DataFrame:
    return K.cells_of(K.generic_fixes(rows(t)))


@query("k11_fixes_by_type")
def fixes_by_type(t: Tables) -> DataFrame:
    kinds = texts(t).select("doc_id", type_by_hits("text", D.SHEET_WORDS).alias("doc_type"))
    return K.fixes_by_type(sheet(t), dealt_as_words(t, kinds))


@query("k12_split_value")
def split_value(t: Tables) -> DataFrame:
    code = F.concat_ws(" ", F.date_format("ts", "dd-MM-yyyy"), F.date_format("ts", "HH:mm"), "event_type", "user_id", F.col("value").cast("string"), F.lit("MP09GG6879"))
    rows_ = t.events.select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(code, F.lit(" 'quoted text'"))).otherwise(code).alias("text"))
    return rows_.select("event_id", F.posexplode(K.split_value("text")).alias("pos", "part"))


@query("k13_limit_columns", f"""SELECT {KEY}, row, least(col, 1) AS col, trim(COALESCE(string_agg(value, ' ' ORDER BY col) FILTER (WHERE {FILLED}), ''), ' ') AS value FROM {SHEET} s GROUP BY {KEY}, row, least(s.col, 1)""")
def limit_columns(t: Tables) -> DataFrame:
    return K.limit_columns(sheet(t), 2)


def _number(v: str) -> str:
    for m in [*K.CURRENCIES, ",", " "]:
        v = f"replace({v}, '{m}', '')"
    return f"TRY_CAST({v} AS DOUBLE)"


ALIGN = "CASE WHEN merged THEN 'center' WHEN col = 2 THEN 'right' ELSE 'left' END"


@query("k14_semantic_columns", f"""
WITH f AS (SELECT *, {ALIGN} AS align, {strip('value')} AS v FROM {SHEET} WHERE {FILLED}),
r AS (SELECT {KEY}, row, max(CASE WHEN (row < 3 AND (bold OR {any_of('lower(v)', K.HEADER_WORDS)} OR length(v) < 30)) OR {any_of('v', K.CURRENCIES)} OR {_number('v')} IS NOT NULL OR align IN ('left', 'right') THEN col END) AS signal,
  max(col) AS last, count(DISTINCT col) AS n, bool_or(align = 'left') AS l, bool_or(align = 'right') AS r FROM f GROUP BY {KEY}, row)
SELECT {KEY}, CASE WHEN doc_id % 2 = 0 AND bool_or(l) AND bool_or(r) AND count(*) FILTER (WHERE n <= 2) / count(*) >= 0.7 THEN 2 ELSE COALESCE(max(signal), max(last)) + 1 END AS columns FROM r GROUP BY {KEY}""")
def semantic_columns(t: Tables) -> DataFrame:
    align = F.when(F.col("merged"), "center").when(F.col("col") == 2, "right").otherwise("left")
    kind = F.when(F.col("doc_id") % 2 == 0, "invoice").otherwise("letter")
    return K.semantic_columns(sheet(t).withColumn("align", align), None, kind)


def _at(sep: str) -> str:
    i = f"instr(value, '{sep}')"
    return f"CASE WHEN {i} > 0 AND {strip(f'substr(value, 1, {i} - 1)')} <> '' AND {strip(f'substr(value, {i} + {len(sep)})')} <> '' THEN {{'key': {strip(f'substr(value, 1, {i} - 1)')}, 'value': {strip(f'substr(value, {i} + {len(sep)})')}}} END"


@query("k15_key_value_split")
def key_value_split(t: Tables) -> DataFrame:
    cells_ = sheet(t).where(K.filled())
    return cells_.select(*J.KEY, "row", "col", K.key_value_split("value").alias("p")).select(*J.KEY, "row", "col", "p.*")


@query("k16_needs_pairing", f"""SELECT *, rows >= 3 AND (rows_with_second / rows < 0.7 OR 1 - rows_with_second / rows > 0.3) AS apply_pairing FROM (
  SELECT {KEY}, count(*) AS rows, count(*) FILTER (WHERE second) AS rows_with_second FROM (SELECT {KEY}, row, bool_or(col >= 1) AS second FROM {SHEET} WHERE {FILLED} GROUP BY {KEY}, row) GROUP BY {KEY})""")
def needs_pairing(t: Tables) -> DataFrame:
    return K.needs_pairing(sheet(t).where(K.filled()))


@query("k17_one_font_per_row", f"SELECT {KEY}, dense_rank() OVER (PARTITION BY {KEY} ORDER BY row, s) - 1 AS row, col, font_size FROM (SELECT *, min(col) OVER (PARTITION BY {KEY}, row, font_size) AS s FROM {SHEET})")
def one_font_per_row(t: Tables) -> DataFrame:
    return K.one_font_per_row(sheet(t)).select(*J.KEY, "row", "col", "font_size")


@query("k18_lines_to_rows", f"""
WITH l AS (SELECT {KEY}, row, col, i, {strip('line')} AS line FROM (SELECT {KEY}, row, col, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS i FROM (SELECT *, string_split(value, chr(10)) AS s FROM {SHEET})))
SELECT {KEY}, row + i AS row, CASE WHEN NOT {any_of('lower(line)', K.LINE_LABEL_WORDS)} AND length(line) > 10 AND NOT (upper(line[1]) = line[1] AND lower(line[1]) <> line[1]) THEN 1 ELSE 0 END AS col,
  md5(string_agg(line, ' ' ORDER BY row, col, i)) AS value_md5 FROM l AS l(doc_id, page, row, col, i, line) WHERE line <> '' GROUP BY ALL""".replace("row + i AS row, CASE", "l.row + l.i AS row, CASE").replace("ORDER BY row, col, i", "ORDER BY l.row, l.col, l.i"))
def lines_to_rows(t: Tables) -> DataFrame:
    return K.lines_to_rows(sheet(t)).select(*J.KEY, "row", "col", F.md5("value").alias("value_md5"))


@query("k19_numbers", f"SELECT {KEY}, row, col, {_number('value')} AS number FROM {SHEET}")
def numbers(t: Tables) -> DataFrame:
    return sheet(t).select(*J.KEY, "row", "col", K.as_number("value").alias("number"))


@query("k20_sheet_shape", f"SELECT *, filled = 0 AS is_empty FROM (SELECT {KEY}, max(row) AS max_row, max(col) AS max_col, count(*) FILTER (WHERE {FILLED}) AS filled FROM {SHEET} GROUP BY {KEY})")
def sheet_shape(t: Tables) -> DataFrame:
    return K.sheet_shape(sheet(t))


@query("k20_cell_at", f"SELECT {KEY}, row, col, value FROM {SHEET} WHERE row = 2 AND col = 1")
def cell_at(t: Tables) -> DataFrame:
    return K.cell_at(sheet(t), 2, 1).select(*J.KEY, "row", "col", "value")


def _runs(line: str, along: str, longer: int, kind: str) -> str:
    w = f"(PARTITION BY {KEY}, {line} ORDER BY {along})"
    return f"""SELECT {KEY}, '{kind}' AS kind, {line} AS line, min({along}) AS start, max({along}) AS "end", any_value(v) AS value FROM (
  SELECT *, sum(o) OVER (PARTITION BY {KEY}, {line} ORDER BY {along} ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN lag(v) OVER {w} = v AND lag({along}) OVER {w} = {along} - 1 THEN 0 ELSE 1 END AS o FROM (SELECT *, {strip('value')} AS v FROM {SHEET})))
  GROUP BY {KEY}, {line}, g HAVING length(any_value(v)) > {longer} AND max({along}) > min({along})"""


RANGES = f"({_runs('row', 'col', 5, 'horizontal')} UNION ALL {_runs('col', 'row', 3, 'vertical')})"


@query("k21_merge_ranges", f"SELECT * FROM {RANGES}")
def merge_ranges(t: Tables) -> DataFrame:
    return K.merge_ranges(sheet(t))


@query("k22_spread_merged_text", f"""SELECT {KEY}, kind, line, at_ AS "at", substr(value, CAST((at_ - start) * s + 1 AS BIGINT), CAST(s AS BIGINT)) AS value
FROM (SELECT *, ceil(length(value) / ("end" - start + 1)) AS s, unnest(range(start, "end" + 1)) AS at_ FROM {RANGES})""")
def spread_merged_text(t: Tables) -> DataFrame:
    return K.spread_merged_text(K.merge_ranges(sheet(t)))


@query("k23_field_template", f"""
WITH p AS (SELECT {KEY}, row, {strip('vals[1].v')} AS field, array_to_string(list_filter(list_transform(vals[2:], lambda x: {strip('x.v')}), lambda v: v <> ''), ' ') AS value FROM {ROWS})
SELECT * FROM p WHERE field <> '' AND value <> ''
UNION ALL SELECT {KEY}, i, ['Name','ID Number','Date of Birth','Address','Photo'][i + 1], CASE WHEN i = 4 THEN '(Please add photo manually)' ELSE '' END
FROM (SELECT {KEY} FROM p GROUP BY {KEY} HAVING NOT bool_or(field <> '' AND value <> '')), range(5) r(i)""")
def field_template(t: Tables) -> DataFrame:
    return K.field_template(rows(t))


@query("k24_first_rows", f"SELECT {KEY}, row, col, value FROM {SHEET} WHERE row < 10")
def first_rows(t: Tables) -> DataFrame:
    return K.first_rows(sheet(t), 10).select(*J.KEY, "row", "col", "value")


@query("k25_join_neighbours", f"""SELECT {KEY}, row, min(col) AS col, trim(string_agg(value, ' ' ORDER BY col), ' ') AS value, count(*) AS colspan FROM (
  SELECT *, (row_number() OVER (PARTITION BY {KEY}, row, g ORDER BY col) - 1) // 2 AS p FROM (
    SELECT *, sum(o) OVER (PARTITION BY {KEY}, row ORDER BY col ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT *, CASE WHEN f AND lag(f) OVER w AND lag(col) OVER w = col - 1 THEN 0 ELSE 1 END AS o FROM (SELECT *, {FILLED} AS f FROM {SHEET}) WINDOW w AS (PARTITION BY {KEY}, row ORDER BY col)))) GROUP BY {KEY}, row, g, p""")
def join_neighbours(t: Tables) -> DataFrame:
    return K.join_neighbours(sheet(t))


@query("k26_split_cells")
def split_cells(t: Tables) -> DataFrame:
    return K.split_cells(rows(t))


V0 = strip("vals[1].v")
PAIR_LABEL = f"""(alone AND ({any_of('low', K.PAIR_LABEL_WORDS + K.PAIR_NEXT_WORDS + K.PAIR_HINDI_WORDS)} OR (length(v) < 50 AND (contains(v, ':') OR
  (contains(v, ' ') AND NOT (upper(v) = v AND lower(v) <> v AND length(v) > 1) AND NOT regexp_matches(replace(v, ' ', ''), '^\\p{{Nd}}+$'))))))"""
PAIR_VALUE = f"""(alone AND NOT ({any_of('low', K.PAIR_NEXT_WORDS + K.PAIR_HINDI_WORDS)} OR regexp_matches(low, '{"|".join(K.PAIR_LABEL_PATTERNS)}') OR (length(v) < 30 AND contains(v, ':'))))"""


@query("k27_pair_label_rows", f"""
WITH RECURSIVE a AS (SELECT {KEY}, vals, {V0} AS v, lower({V0}) AS low, row_number() OVER (PARTITION BY {KEY} ORDER BY row) AS rn,
  vals[1].c = 0 AND len(list_filter(vals, lambda x: x.c >= 1 AND {strip('x.v')} <> '')) = 0 AS alone FROM {ROWS}),
r AS (SELECT {KEY}, vals, v, rn, {PAIR_VALUE} AND COALESCE(lag({PAIR_LABEL}) OVER (PARTITION BY {KEY} ORDER BY rn), false) AS joins FROM a),
st AS (SELECT {KEY}, rn, vals, v, false AS swallowed FROM r WHERE rn = 1
  UNION ALL SELECT r.doc_id, r.page, r.rn, r.vals, r.v, r.joins AND NOT s.swallowed FROM st s JOIN r ON r.doc_id = s.doc_id AND r.page = s.page AND r.rn = s.rn + 1)
SELECT {KEY}, row, u.c AS col, u.v AS value FROM (SELECT {KEY}, row_number() OVER (PARTITION BY {KEY} ORDER BY rn) - 1 AS row, unnest(vals) AS u FROM (
  SELECT {KEY}, rn, swallowed, CASE WHEN lead(swallowed) OVER (PARTITION BY {KEY} ORDER BY rn) THEN [{{'c': 0, 'v': v}}, {{'c': 1, 'v': lead(v) OVER (PARTITION BY {KEY} ORDER BY rn)}}] ELSE vals END AS vals FROM st) WHERE NOT swallowed)""")
def pair_label_rows(t: Tables) -> DataFrame:
    return K.pair_label_rows(rows(t))


@query("k28_normalised_style", rf"""SELECT {KEY}, row, col, CASE WHEN merged THEN 'center' WHEN TRY_CAST({strip("replace(replace(replace(value, ',', ''), '₹', ''), '$', '')")} AS DOUBLE) IS NOT NULL THEN 'right' ELSE 'left' END AS align,
  CASE WHEN row >= 1 THEN floor(avg(CASE WHEN row >= 1 THEN font_size END) OVER (PARTITION BY {KEY})) ELSE font_size END AS font_size FROM {SHEET}""")
def normalised_style(t: Tables) -> DataFrame:
    return K.normalise_style(sheet(t)).select(*J.KEY, "row", "col", "align", "font_size")


@query("k29_headers_only", f"""SELECT {KEY}, row, col, CASE WHEN {FILLED} THEN value ELSE 'Column ' || (col + 1) END AS value FROM {SHEET} WHERE is_header
UNION ALL SELECT {KEY}, 0, 0, 'Template/Incomplete Table' FROM {SHEET} GROUP BY {KEY} HAVING NOT bool_or(is_header)""")
def headers_only(t: Tables) -> DataFrame:
    return K.headers_only(sheet(t))


@query("k29_simple_rowwise", f"SELECT {KEY}, {DENSE_ROW}, col, value FROM {SHEET} WHERE {FILLED}")
def simple_rowwise(t: Tables) -> DataFrame:
    return K.simple_rowwise(sheet(t))


@query("k30_trimmed_sheet", f"""
WITH a AS (SELECT {KEY}, {DENSE_ROW}, col, value FROM (SELECT *, bool_or({FILLED}) OVER (PARTITION BY {KEY}, row) AS h FROM {SHEET}) WHERE h)
SELECT {KEY}, row, CASE WHEN best = 0 THEN col ELSE dense_rank() OVER (PARTITION BY {KEY} ORDER BY col) - 1 END AS col, value
FROM (SELECT *, max(n) OVER (PARTITION BY {KEY}) AS best FROM (SELECT *, count(*) FILTER (WHERE {FILLED}) OVER (PARTITION BY {KEY}, col) AS n FROM a)) WHERE best = 0 OR n >= least(1, best)""")
def trimmed_sheet(t: Tables) -> DataFrame:
    return K.drop_sparse_columns(K.drop_empty_rows(sheet(t)), 1).select(*J.KEY, "row", "col", "value")


