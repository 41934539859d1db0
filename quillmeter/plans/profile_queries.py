"""Profiling and classification queries over documents and the words derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.functions import doclex as D
from quillmeter.operators import profile as I
from quillmeter.plans.registry import Tables, query
from quillmeter.plans.sqltext import all_of, any_of, case, count_of, lit, text_list
from quillmeter.plans.wordsql import WORDS
from quillmeter.sources import words as S
from quillmeter.sources.words import partitions_for, words_from_text

# Phrases added to the given texts, which hold few business words, so that every class occurs.
PHRASES = [
    "", "Invoice total and tax, amount due: 12", "bank statement with balance", "resume: education and skills, objective",
    "certificate awarded on completion", "id card of the government, date of birth, photo, signature", "dear sir, regards",
    "memo for the meeting", "bill payment receipt and bill amount", "application form of the ministry", "please fill in the template",
    "university course grade", "आवेदन फॉर्म प्रमाणपत्र दस्तावेज", "opening balance, closing balance", "1234 5678 9012",
]
NAMES = ["scan.pdf", "bill-7.pdf", "receipt.pdf", "my invoice.pdf", "application.pdf", "resume.pdf", "fee receipt.pdf", "notes.pdf"]


def _pick(values: list[str], by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def texts(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", F.concat(_pick(PHRASES, F.col("doc_id")), F.lit("\n"), "text").alias("text"),
        _pick(NAMES, F.col("doc_id")).alias("filename"), "n_chars")


TEXTS = f"""(SELECT doc_id, list_extract({text_list(PHRASES)}, doc_id % {len(PHRASES)} + 1) || chr(10) || text AS text,
  list_extract({text_list(NAMES)}, doc_id % {len(NAMES)} + 1) AS filename, n_chars FROM documents)"""


def words(t: Tables) -> DataFrame:
    """One plan per query, so that its parts share the exchange of the texts and their count."""
    if "word_table" not in vars(t):
        t.word_parts = partitions_for(t.documents)
        t.word_table = words_from_text(t.documents, parts=t.word_parts)
    return t.word_table


def dealt_as_words(t: Tables, rows: DataFrame) -> DataFrame:
    """Rows of documents in the partitions of their words, which they then meet without another exchange of these."""
    words(t)
    return rows.repartition(t.word_parts, "doc_id")


@query("words_table", f"SELECT * FROM {WORDS}")
def words_table(t: Tables) -> DataFrame:
    return words(t)


def _n(c: str, cls: str) -> str:
    return f"(length({c}) - length(regexp_replace({c}, '{cls}', '', 'g')))"


INK = "length(replace(replace({c}, ' ', ''), chr(10), ''))"
DEVA = r"[\x{0900}-\x{097F}]"


def _ratio(c: str, cls: str, total: str) -> str:
    return f"(CAST({_n(c, cls)} AS DOUBLE) / {total})"


def _language(c: str) -> str:
    low = r"regexp_replace({c}, '[\x{{0900}}-\x{{10FFFF}}]', '', 'g')".format(c=c)
    total = INK.format(c=c)
    deva, latin = _ratio(c, DEVA, total), _ratio(low, r"\p{L}", total)
    return case([(f"{total} = 0", "'other'"), (f"{deva} > 0.3 AND {latin} > 0.2", "'mixed'"), (f"{deva} > 0.3", "'hindi'"),
                 (f"{latin} > 0.5", "'english'")], "'other'")


@query("i1_language_signal", f"SELECT doc_id, {_language('text')} AS language FROM {TEXTS}")
def language_signal(t: Tables) -> DataFrame:
    return texts(t).select("doc_id", I.language_signal("text").alias("language"))


RANGES = case([("text IS NULL OR text = ''", "'unknown'"), (f"regexp_matches(text, '{DEVA}')", "'devanagari'"),
               (r"regexp_matches(text, '[\x{0600}-\x{06FF}]')", "'arabic'"), (r"regexp_matches(text, '[\x{4E00}-\x{9FFF}]')", "'cjk'"),
               (r"regexp_matches(text, '[\x{0E00}-\x{0E7F}]')", "'thai'"),
               (r"""regexp_matches(text, '^[a-zA-Z0-9\s.,;:!?()\[\]{}''"-]+$')""", "'latin'")], "'mixed'")


@query("i2_script_range", f"SELECT script, count(*) AS words FROM (SELECT {RANGES} AS script FROM {WORDS}) GROUP BY script")
def script_range(t: Tables) -> DataFrame:
    return words(t).select(I.script_range("text").alias("script")).groupBy("script").agg(F.count(F.lit(1)).alias("words"))


@query("i3_normalised_text", f"""SELECT doc_id, md5(replace(replace(nfc_normalize(text || 'e' || chr(769) || chr(8205)), chr(8205), ''), chr(8204), '')) AS text_md5 FROM {TEXTS}""")
def normalised_text(t: Tables) -> DataFrame:
    raw = F.concat("text", F.lit("é‍"))
    return texts(t).select("doc_id", F.md5(I.normalise_text(raw)).alias("text_md5"))


PAGE_STATS = rf"""(SELECT doc_id, page, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS items, CAST(sum({_n('text', r'\p{Nd}')}) AS BIGINT) AS digits,
  count(DISTINCT round(y0)) AS rows, count(DISTINCT round(x0)) AS columns FROM {WORDS} GROUP BY doc_id, page)"""


def page_stats(t: Tables) -> DataFrame:
    return I.page_text_stats(words(t))


@query("i4_numeric_density", rf"""SELECT doc_id, round({_ratio('text', r'\p{Nd}', 'NULLIF(' + INK.format(c='text') + ', 0)')}, 9) AS density FROM {TEXTS}""")
def numeric_density(t: Tables) -> DataFrame:
    return texts(t).select("doc_id", F.round(I.numeric_density("text"), 9).alias("density"))


@query("i5_document_nature", f"""SELECT doc_id, CASE WHEN c > 200 AND images = 0 THEN 'digital' WHEN c < 50 AND images > 0 THEN 'scanned' ELSE 'hybrid' END AS nature
FROM (SELECT doc_id, {INK.format(c='text')} AS c, doc_id % 3 AS images FROM {TEXTS})""")
def document_nature(t: Tables) -> DataFrame:
    return texts(t).select("doc_id", I.document_nature(I.ink_length("text"), F.col("doc_id") % 3).alias("nature"))


@query("i6_scanned_pages", f"""SELECT *, chars / {S.PAGE_W * S.PAGE_H}::DOUBLE < 0.001 AND items < 5 AS is_scanned FROM (
  SELECT *, round(chars / {S.PAGE_W * S.PAGE_H}::DOUBLE, 9) AS density FROM {PAGE_STATS})""")
def scanned_pages(t: Tables) -> DataFrame:
    return I.scanned_pages(page_stats(t), S.PAGE_W * S.PAGE_H)


@query("i7_convertibility", f"""
SELECT *, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS level FROM (
SELECT *, CAST(greatest(0, 100 - CASE WHEN scanned / pages > 0.7 THEN 60 WHEN scanned / pages > 0.3 THEN 30 ELSE 0 END
  - CASE WHEN chars / pages < 50 THEN 40 WHEN chars / pages < 200 THEN 20 ELSE 0 END - CASE WHEN complex_tables > 0 THEN 25 ELSE 0 END) AS BIGINT) AS score
FROM (SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE chars <= 100) AS scanned, CAST(sum(chars) AS BIGINT) AS chars,
  count(*) FILTER (WHERE rows >= 2 AND columns >= 2 AND (columns > 5 OR rows > 20)) AS complex_tables FROM {PAGE_STATS} GROUP BY doc_id))""")
def convertibility(t: Tables) -> DataFrame:
    return I.convertibility(page_stats(t))


def _best_sql(scores: list[tuple[str, str]], field: str) -> str:
    items = ", ".join(f"{{'score': CAST({s} AS DOUBLE), 'pref': {-i}, 'name': {lit(n)}}}" for i, (n, s) in enumerate(scores))
    return f"list_max([{items}]).{field}"


W = D.CATEGORY_WORDS


def _share(name: str, extra: str | None = None) -> str:
    hits = count_of("low", W[name])
    part = f"CAST({hits} AS DOUBLE) / {len(W[name])}" if extra is None else f"CAST({hits} + {extra} AS DOUBLE) / ({len(W[name])} + pages)"
    return f"least(({part}) * 2, 1.0::DOUBLE)"


CATEGORY = [("invoice", _share("invoice", "dense")), ("bank_statement", _share("bank_statement", "dense")),
            ("govt_form", f"CASE WHEN language IN ('hindi', 'mixed') THEN {_share('govt_form')} ELSE 0.0::DOUBLE END"),
            ("academic", _share("academic")), ("resume", _share("resume")), ("graphic", "CASE WHEN images / pages > 3 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END")]


@query("i8_heuristic_category", f"""SELECT doc_id, round({_best_sql(CATEGORY, 'score')}, 9) AS score,
  CASE WHEN {_best_sql(CATEGORY, 'score')} < 0.3 THEN 'unknown' ELSE {_best_sql(CATEGORY, 'name')} END AS category
FROM (SELECT doc_id, lower(text) AS low, {_language('text')} AS language, 1 + n_chars // 3000 AS pages, doc_id % 2 AS dense, doc_id % 5 AS images FROM {TEXTS})""")
def heuristic_category(t: Tables) -> DataFrame:
    pages, dense = F.lit(1) + F.expr("n_chars div 3000"), F.col("doc_id") % 2
    best = I.heuristic_category("text", pages, dense, dense, I.language_signal("text"), F.col("doc_id") % 5)
    return texts(t).select("doc_id", best.alias("b")).select("doc_id", F.round("b.score", 9).alias("score"), F.col("b.name").alias("category"))


TYPES = [(n, f"{count_of('low', w)} + CASE WHEN tables THEN {D.TABLE_BOOST.get(n, 0)} ELSE 0 END") for n, w in D.TYPE_WORDS.items()]


@query("i9_document_type", f"""SELECT doc_id, CASE WHEN length(low) = 0 THEN 'unknown' WHEN {_best_sql(TYPES, 'score')} > 0 THEN {_best_sql(TYPES, 'name')}
  WHEN length(low) > 100 AND NOT tables THEN 'digital_pdf' ELSE 'unknown' END AS doc_type
FROM (SELECT doc_id, lower(text) AS low, doc_id % 4 = 0 AS tables FROM {TEXTS})""")
def document_type(t: Tables) -> DataFrame:
    return texts(t).select("doc_id", I.document_type("text", F.col("doc_id") % 4 == 0).alias("doc_type"))


WHOLE = [(n, count_of("low", [f" {x} " for x in w])) for n, w in D.TYPE_WORDS.items()]


@query("i9_document_type_whole_word", rf"""SELECT doc_id, CASE WHEN {_best_sql(WHOLE, 'score')} > 0 THEN {_best_sql(WHOLE, 'name')} WHEN n > 100 THEN 'digital_pdf' ELSE 'unknown' END AS doc_type
FROM (SELECT doc_id, length(text) AS n, ' ' || regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]+', ' ', 'g') || ' ' AS low FROM {TEXTS})""")
def document_type_whole_word(t: Tables) -> DataFrame:
    return texts(t).select("doc_id", I.document_type("text", F.lit(False), whole_word=True).alias("doc_type"))


def _by_hits(lexicon: dict[str, list[str]]) -> str:
    s = [(n, count_of("low", w)) for n, w in lexicon.items()]
    return f"CASE WHEN {_best_sql(s, 'score')} >= 2 THEN {_best_sql(s, 'name')} ELSE 'unknown' END"


@query("i10_type_by_hits", f"""SELECT doc_id, {_by_hits(D.SHEET_WORDS)} AS sheet_type, {_by_hits(D.WORD_BLOCK_WORDS)} AS block_type
FROM (SELECT doc_id, lower(text) AS low FROM {TEXTS})""")
def type_by_hits(t: Tables) -> DataFrame:
    return texts(t).select("doc_id", I.type_by_hits("text").alias("sheet_type"), I.type_by_hits("text", D.WORD_BLOCK_WORDS).alias("block_type"))


BY_NAME = case([(f"contains(name, {lit(w)})", lit(x)) for w, x in D.NAME_TYPES] + [(any_of("low", ws), lit(x)) for ws, x in D.FIRST_WORD_TYPES]
               + [(f"{count_of('low', D.FINANCE_WORDS)} >= 2", "'bill'")], "'other'")


@query("i11_type_by_name", f"SELECT doc_id, {BY_NAME} AS doc_type FROM (SELECT doc_id, lower(text) AS low, lower(filename) AS name FROM {TEXTS})")
def type_by_name(t: Tables) -> DataFrame:
    return texts(t).select("doc_id", I.type_by_name("text", "filename").alias("doc_type"))


PEAKS = f"""(SELECT doc_id, max(n) FILTER (WHERE axis = 'x') AS peak_x, max(n) FILTER (WHERE axis = 'y') AS peak_y, CAST(sum(n) FILTER (WHERE axis = 'x') AS BIGINT) AS items
  FROM (SELECT doc_id, axis, spot, count(*) AS n FROM (SELECT doc_id, 'x' AS axis, round_even(x0, -1) AS spot FROM {WORDS}
    UNION ALL SELECT doc_id, 'y', round_even(y0, -1) FROM {WORDS}) GROUP BY doc_id, axis, spot) GROUP BY doc_id)"""


@query("i12_id_card", f"""
SELECT doc_id, pages, page_signal, keyword_signal, layout_signal, CAST(CASE WHEN card THEN least(100, pts + 10) ELSE pts END AS BIGINT) AS confidence,
  CASE WHEN card THEN 'ID_CARD' ELSE 'NORMAL_PDF' END AS document_type
FROM (SELECT *, page_signal AND (keyword_signal OR layout_signal) AS card,
    CASE WHEN page_signal THEN 40 ELSE 0 END + CASE WHEN keyword_signal THEN 30 ELSE 0 END + CASE WHEN layout_signal THEN 30 ELSE 0 END AS pts
  FROM (SELECT doc_id, pages, pages <= 2 AND density < 500 AND doc_id % 3 <> 0 AS page_signal, {count_of('low', D.ID_CARD_WORDS)} >= 2 AS keyword_signal,
      NOT COALESCE(items > 5 AND (peak_x > 3 OR peak_y > 3), false) AND pages <= 2 AND density < 1000 AS layout_signal
    FROM (SELECT x.doc_id, 1 + n_chars // 3000 AS pages, lower(text) AS low, length(trim(text, ' ')) / greatest(1, 1 + n_chars // 3000) AS density, items, peak_x, peak_y
      FROM {TEXTS} x LEFT JOIN {PEAKS} p USING (doc_id))))""")
def id_card(t: Tables) -> DataFrame:
    docs = texts(t).withColumns({"pages": F.lit(1) + F.expr("n_chars div 3000"), "tables": (F.col("doc_id") % 3 == 0).cast("int")})
    rows = I.id_card_facts(docs, "text").join(I.alignment_peaks(words(t)), "doc_id", "left")
    return I.id_card_signals(rows, "pages", "tables", "items", "peak_x", "peak_y").select(
        "doc_id", "pages", "page_signal", "keyword_signal", "layout_signal", "confidence", "document_type")


@query("i13_blank_or_template", rf"""SELECT doc_id, n < 10 OR n / length(text) < 0.1 OR {count_of('lower(text)', D.PLACEHOLDER_WORDS)} >= 2 OR (doc_id % 6 > 0 AND doc_id % 7 = 0) AS is_blank
FROM (SELECT doc_id, text, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS n FROM {TEXTS})""")
def blank_or_template(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return texts(t).select("doc_id", I.blank_or_template("text", d % 6, d % 7).alias("is_blank"))


LINES = f"(SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {TEXTS}))"


def lines(t: Tables) -> DataFrame:
    return texts(t).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


BARE = "replace(replace(replace(line, ' ', ''), '-', ''), '.', '')"


@query("i14_long_numbers", rf"""SELECT doc_id, line_no, {_n('line', r'\p{Nd}')} BETWEEN 10 AND 12 AND contains(line, ' ') AS spaced_id,
  length({BARE}) >= 10 AND COALESCE({_ratio(BARE, r'\p{Nd}', f'NULLIF(length({BARE}), 0)')} >= 0.8, false) AS numeric_sequence FROM {LINES}""")
def long_numbers(t: Tables) -> DataFrame:
    return lines(t).select("doc_id", "line_no", I.long_number_with_spaces("line").alias("spaced_id"),
                           F.coalesce(I.numeric_sequence("line"), F.lit(False)).alias("numeric_sequence"))


VISUAL = f"""(SELECT x.doc_id, pages, items, pages * 324000 * (x.doc_id % 5) / 10.0::DOUBLE AS image_area, text_area, pages * 324000.0::DOUBLE AS total_area, x.doc_id % 9 AS boxes, peak_x
  FROM (SELECT doc_id, count(DISTINCT page) AS pages, round(sum((x1 - x0) * (y1 - y0)), 3) AS text_area FROM {WORDS} GROUP BY doc_id) x JOIN {PEAKS} USING (doc_id))"""


@query("i15_visual_document", f"""SELECT *, visual_reason IS NOT NULL AS is_visual FROM (SELECT *, CASE WHEN items = 0 THEN 'no_text' WHEN image_area / total_area > 0.3 THEN 'images'
  WHEN text_area / total_area < 0.1 THEN 'little_text' WHEN boxes > pages * 5 THEN 'boxes' WHEN items > 100 AND peak_x > items * 0.3::DOUBLE THEN 'aligned_layout' END AS visual_reason FROM {VISUAL})""")
def visual_document(t: Tables) -> DataFrame:
    w = words(t)
    per_page = w.groupBy("doc_id", "page").agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("a"))
    areas = per_page.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.round(F.sum("a"), 3).alias("text_area"))
    d = F.col("doc_id")
    facts = areas.join(I.alignment_peaks(w), "doc_id").withColumns(
        {"image_area": F.col("pages") * 324000 * (d % 5) / F.lit(10.0), "total_area": F.col("pages") * F.lit(324000.0), "boxes": d % 9}).drop("peak_y")
    return I.visual_document(facts)


@query("i16_mixed_language", f"SELECT doc_id, COALESCE({_ratio('text', DEVA, 'NULLIF(length(text), 0)')} > 0.05, false) AS is_mixed FROM {TEXTS}")
def mixed_language(t: Tables) -> DataFrame:
    return texts(t).select("doc_id", I.mixed_language("text").alias("is_mixed"))


V = "lower(trim(line, ' '))"
FIELD = case([("line IS NULL OR line = ''", "'text'"), (any_of(V, D.CHECKBOX_MARKS), "'checkbox'"), (any_of(V, D.RADIO_MARKS), "'radio'"),
              ("contains(line, chr(10)) OR length(line) > 100", "'multiline'")], "'text'")


@query("i17_form_fields", f"""SELECT doc_id, line_no, kind, state, md5(CASE kind WHEN 'checkbox' THEN name || ': ' || CASE WHEN state = 'checked' THEN '✓' ELSE '☐' END
  WHEN 'radio' THEN name || ': ' || CASE WHEN state = 'selected' THEN '●' ELSE '○' END || ' ' || line WHEN 'multiline' THEN name || ':' || chr(10) || line ELSE name || ': ' || line END) AS label_md5
FROM (SELECT *, CASE kind WHEN 'checkbox' THEN CASE WHEN {V} IN {tuple(D.CHECKED)!r} THEN 'checked' ELSE 'unchecked' END
  WHEN 'radio' THEN CASE WHEN {V} IN {tuple(D.SELECTED)!r} THEN 'selected' ELSE 'unselected' END END AS state
FROM (SELECT doc_id, line_no, line, 'field ' || line_no AS name, {FIELD} AS kind FROM {LINES}))""")
def form_fields(t: Tables) -> DataFrame:
    rows = lines(t).withColumn("name", F.concat(F.lit("field "), "line_no")).withColumn("kind", I.field_type("line"))
    rows = rows.withColumn("state", I.field_state("line", F.col("kind")))
    label = I.field_label("name", "line", F.col("kind"), F.col("state"))
    return rows.select("doc_id", "line_no", "kind", "state", F.md5(label).alias("label_md5"))


@query("i18_recommended_tool", f"""SELECT doc_id, CASE WHEN a THEN 'excel' ELSE 'word' END AS suggested_tool,
  CASE WHEN a THEN 'docai' WHEN b THEN 'libreoffice' WHEN c THEN 'docai' ELSE 'libreoffice' END AS engine, a OR (NOT b AND c) AS requires_premium,
  CAST(CASE WHEN a OR b THEN 2 WHEN c THEN 5 ELSE 0 END AS DOUBLE) AS credits_per_page
FROM (SELECT doc_id, contains(text, '|') OR doc_id % 17 = 0 AS a, n_chars > 500 AS b, n_chars < 200 AS c FROM {TEXTS})""")
def recommended_tool(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    rows = I.recommend_tool(texts(t), F.col("text").contains("|"), F.col("doc_id") % 17 == 0, n > 500, n < 200)
    return rows.drop("text", "filename", "n_chars")


def _bag(c: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex({c}, '\s+'), lambda w: w <> ''))"


@query("i19_text_similarity", rf"""
SELECT conv_id, turn, round(CASE WHEN COALESCE(length(a), 0) = 0 OR COALESCE(length(b), 0) = 0 THEN 0.0 WHEN x = y THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN 0.8
  ELSE COALESCE(CAST(len(list_intersect({_bag('x')}, {_bag('y')})) AS DOUBLE) / NULLIF(len(list_distinct({_bag('x')} || {_bag('y')})), 0), 0.0) END, 9) AS similarity
FROM (SELECT l.conv_id, l.turn, l.text AS a, r.text AS b, lower(regexp_replace(l.text, '^\s+|\s+$', '', 'g')) AS x, lower(regexp_replace(r.text, '^\s+|\s+$', '', 'g')) AS y
  FROM conversations l JOIN conversations r ON r.conv_id = l.conv_id AND r.turn = l.turn + 1)""")
def text_similarity(t: Tables) -> DataFrame:
    c = t.conversations
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(I.text_similarity("text", "b"), 9).alias("similarity"))


SCRIPT = case([("length(text) = 0", "'unknown'"), (f"{_ratio('text', DEVA, 'length(text)')} > 0.3", "'devanagari'"),
               (f"{_ratio('text', '[A-Za-z]', 'length(text)')} > 0.3", "'latin'"), (rf"{_ratio('text', r'\p{Nd}', 'length(text)')} > 0.5", "'numeric'")], "'mixed'")


@query("i20_script_class", f"SELECT doc_id, script, count(*) AS words FROM (SELECT doc_id, {SCRIPT} AS script FROM {WORDS}) GROUP BY doc_id, script")
def script_class(t: Tables) -> DataFrame:
    return words(t).select("doc_id", I.script_class("text").alias("script")).groupBy("doc_id", "script").agg(F.count(F.lit(1)).alias("words"))


@query("i21_processing_notes", f"""SELECT *, array_to_string(list_filter([CASE WHEN needs_ocr THEN 'ocr_required' END, CASE WHEN table_pages > 0 THEN 'tables' END,
  CASE WHEN images > 0 THEN 'images' END], lambda x: x IS NOT NULL), ';') AS notes
FROM (SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE columns > 60) AS table_pages, CAST(sum(doc_id % 3) AS BIGINT) AS images, bool_or(chars < 100) AS needs_ocr FROM {PAGE_STATS} GROUP BY doc_id)""")
def processing_notes(t: Tables) -> DataFrame:
    facts = page_stats(t).select("doc_id", (F.col("columns") > 60).alias("has_tables"), (F.col("doc_id") % 3).alias("images"), (F.col("chars") < 100).alias("needs_ocr"))
    return I.processing_notes(facts)


FORM = case([(f"{any_of('name', ['application', 'form'])} AND {any_of('low', D.APPLICATION_WORDS)}", "'application_form'"), (any_of("low", D.APPLICATION_TEXTS), "'application_form'"),
             (f"{any_of('low', D.GOVERNMENT_WORDS)} AND {any_of('low', ['form', 'application'])}", "'government_form'")], "'standard'")


@query("i22_form_type", f"""SELECT doc_id, form_type, form_type = 'standard' AND ({any_of('name', D.TWO_COLUMN_NAMES)} OR {any_of('low', D.TWO_COLUMN_TEXTS)}
  OR {all_of('low', [['objective'], ['education']])}) AS two_columns FROM (SELECT *, {FORM} AS form_type FROM (SELECT doc_id, lower(text) AS low, lower(filename) AS name FROM {TEXTS}))""")
def form_type(t: Tables) -> DataFrame:
    return texts(t).select("doc_id", I.form_type("text", "filename").alias("form_type"), I.needs_two_columns("text", "filename").alias("two_columns"))


@query("i23_layout_category", f"""SELECT doc_id, doc_type, tables AND doc_type IN ('invoice', 'bank_statement', 'bill', 'office_document', 'unknown') AS table_allowed,
  CASE WHEN tables AND conf >= 0.65 THEN 'true_table' WHEN doc_type IN ('bill', 'invoice', 'bank_statement') OR fields THEN 'key_value'
    WHEN doc_id % 5 > 0 AND (fields OR tables) THEN 'mixed_layout' ELSE 'plain_text' END AS category
FROM (SELECT doc_id, {BY_NAME} AS doc_type, doc_id % 3 = 0 AS tables, (doc_id % 100) / 100.0 AS conf, doc_id % 4 = 0 AS fields
  FROM (SELECT doc_id, lower(text) AS low, lower(filename) AS name FROM {TEXTS}))""")
def layout_category(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    rows = texts(t).select("doc_id", I.type_by_name("text", "filename").alias("doc_type"))
    return rows.withColumns({
        "table_allowed": I.allows_table_processing(F.col("doc_type"), d % 3 == 0),
        "category": I.layout_category(F.col("doc_type"), d % 3 == 0, (d % 100) / F.lit(100.0), d % 4 == 0, d % 5 > 0)})


@query("i24_visual_pages", f"""
WITH r AS (SELECT doc_id, page, floor(y0 / 10 + 0.5) * 10 AS yb, list(floor(x0 / 20 + 0.5) * 20) AS xs, count(*) AS n, sum((x1 - x0) * font_size * 1.2::DOUBLE) AS a,
    bool_or(y0 < {S.PAGE_H * 0.2} AND font_size > 20 AND abs(x0 - {S.PAGE_W / 2}) < {S.PAGE_W * 0.3}) AS logo FROM {WORDS} GROUP BY 1, 2, 3),
p AS (SELECT doc_id, page, sum(n) AS items, count(*) AS rws, least(sum(a) / {S.PAGE_W * S.PAGE_H}::DOUBLE, 1.0::DOUBLE) AS density, bool_or(logo) AS logo, arg_min(xs, yb) AS t, arg_max(xs, yb) AS b FROM r GROUP BY 1, 2),
s AS (SELECT *, items >= 4 AND rws >= 2 AND len(t) >= 2 AND len(b) >= 2 AND len(list_filter(t, lambda x: len(list_filter(b, lambda z: abs(x - z) < 30)) > 0)) >= least(len(t), len(b)) * 0.5 AS boxed FROM p),
f AS (SELECT *, CAST(CASE WHEN doc_id % 10 > 4 THEN 30 ELSE 0 END + CASE WHEN density < 0.15 THEN 25 ELSE 0 END + CASE WHEN page % 2 = 0 THEN 20 ELSE 0 END
  + CASE WHEN boxed THEN 15 ELSE 0 END + CASE WHEN logo THEN 10 ELSE 0 END AS BIGINT) AS score FROM s)
SELECT doc_id, page, round(density, 9) AS text_density, boxed, logo, score, score >= 50 AS is_visual FROM f""")
def visual_pages(t: Tables) -> DataFrame:
    w = words(t)
    facts = w.select("doc_id", "page").distinct().select(
        "doc_id", "page", ((F.col("doc_id") % 10) / F.lit(10.0)).alias("image_density"), (F.col("page") % 2 == 0).alias("rectangles"))
    return I.visual_page_score(w, facts, S.PAGE_W, S.PAGE_H)


@query("i25_id_card_layout", f"""
SELECT r.doc_id, rows, pairs, words, rows >= 2 AND (words >= 3 OR (words >= 2 AND pairs)) AS is_id_card
FROM (SELECT doc_id, count(*) AS rows, bool_or(n = 2) AS pairs FROM (SELECT doc_id, len(list_filter(string_split(line, ' '), lambda w: w <> '')) AS n FROM {LINES}) GROUP BY doc_id) r
JOIN (SELECT doc_id, {count_of('lower(text)', D.ID_LAYOUT_WORDS)} AS words FROM {TEXTS}) x USING (doc_id)""")
def id_card_layout(t: Tables) -> DataFrame:
    rows = lines(t).select("doc_id", F.size(F.filter(F.split("line", " "), lambda w: w != "")).alias("filled"))
    return I.id_card_layout(rows, texts(t))
