"""Document profiling and classification (survey group I). Whole texts are read by default; the
sampling limits of an interactive tool are optional parameters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.functions import doclex as D
from quillmeter.functions.exprs import any_contains, col, count_contains, first_rule, labels_where, let, long_count

DEVANAGARI = r"[\x{0900}-\x{097F}]"


def matches(text: str | Column, char_class: str) -> Column:
    """Characters of a class: what is missing after its runs are removed (one match per run)."""
    return F.length(col(text)) - F.length(F.regexp_replace(col(text), f"{char_class}+", ""))


def ink_length(text: str | Column) -> Column:
    """Characters other than blanks and newlines."""
    return F.length(F.translate(col(text), " \n", ""))


def language_signal(text: str | Column) -> Column:
    """Hindi / english / mixed / other by shares of Devanagari and other letters."""
    total = ink_length(text)
    deva = matches(text, DEVANAGARI) / total
    latin = matches(F.regexp_replace(col(text), r"[\x{0900}-\x{10FFFF}]", ""), r"\p{L}") / total
    return F.when(total == 0, "other").otherwise(
        first_rule(
            [((deva > 0.3) & (latin > 0.2), "mixed"), (deva > 0.3, "hindi"), (latin > 0.5, "english")], "other"
        )
    )


def script_range(text: str | Column) -> Column:
    """Class of the first Unicode range found."""
    t = col(text)
    ranges = [("devanagari", DEVANAGARI), ("arabic", r"[\x{0600}-\x{06FF}]"), ("cjk", r"[\x{4E00}-\x{9FFF}]"),
              ("thai", r"[\x{0E00}-\x{0E7F}]"), ("latin", r"""^[a-zA-Z0-9\s.,;:!?()\[\]{}'"-]+$""")]
    rules = [(t.isNull() | (t == ""), "unknown")] + [(t.rlike(p), n) for n, p in ranges]
    return first_rule(rules, "mixed")


def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def normalise_text(text: str | Column) -> Column:
    """Canonical composition (no built-in exists; Arrow batches), zero-width joiners dropped."""
    return F.translate(F.pandas_udf(_nfc, "string")(col(text)), "\u200d\u200c", "")


def numeric_density(text: str | Column) -> Column:
    """I4: digits per non-blank character."""
    total = ink_length(text)
    return F.when(total > 0, matches(text, r"\p{Nd}") / total).otherwise(0.0)


def document_nature(text_chars: Column, images: Column) -> Column:
    """I5."""
    return first_rule(
        [((text_chars > 200) & (images == 0), "digital"), ((text_chars < 50) & (images > 0), "scanned")], "hybrid"
    )


def page_text_stats(words: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """Per page: characters, words, digits, distinct rows and columns. A page is bounded, so the two
    distinct counts are small sets in one aggregation."""
    ink = F.length("text")
    return words.groupBy(doc, page).agg(
        F.sum(ink).alias("chars"),
        F.count(F.lit(1)).alias("items"),
        F.sum(matches("text", r"\p{Nd}")).alias("digits"),
        F.size(F.collect_set(F.round("y0"))).cast("long").alias("rows"),
        F.size(F.collect_set(F.round("x0"))).cast("long").alias("columns"),
    )


def scanned_pages(stats: DataFrame, page_area: float) -> DataFrame:
    """Almost no text per area and very few objects."""
    density = F.col("chars") / F.lit(page_area)
    return stats.withColumns(
        {"density": F.round(density, 9), "is_scanned": (density < 0.001) & (F.col("items") < 5)}
    )


def convertibility(stats: DataFrame, doc: str = "doc_id", page: str = "page", max_pages: int | None = None) -> DataFrame:
    """Score 0-100 and level from scanned share, text per page and complex tables."""
    rows = stats if max_pages is None else stats.where(F.col(page) <= max_pages)
    table = (F.col("rows") >= 2) & (F.col("columns") >= 2)
    facts = rows.groupBy(doc).agg(
        F.count(F.lit(1)).alias("pages"),
        long_count(F.col("chars") <= 100).alias("scanned"),
        F.sum("chars").alias("chars"),
        long_count(table & ((F.col("columns") > 5) | (F.col("rows") > 20))).alias("complex_tables"),
    )
    share, per_page = F.col("scanned") / F.col("pages"), F.col("chars") / F.col("pages")
    loss = (
        first_rule([(share > 0.7, 60), (share > 0.3, 30)], 0)
        + first_rule([(per_page < 50, 40), (per_page < 200, 20)], 0)
        + F.when(F.col("complex_tables") > 0, 25).otherwise(0)
    )
    score = F.greatest(F.lit(0), F.lit(100) - loss).cast("long")
    return facts.withColumn("score", score).withColumn(
        "level", first_rule([(F.col("score") >= 70, "high"), (F.col("score") >= 40, "medium")], "low")
    )


def _best(scores: Sequence[tuple[str, Column]]) -> Column:
    """Class of highest score; the class listed first wins ties. A struct maximum, no join."""
    return F.array_max(
        F.array(*[F.struct(s.cast("double").alias("score"), F.lit(-i).alias("pref"), F.lit(n).alias("name"))
                  for i, (n, s) in enumerate(scores)])
    )


def heuristic_category(
    text: str | Column, pages: Column, dense_02: Column, dense_03: Column, language: Column, images: Column
) -> Column:
    """I8: struct(score, name) of the best normalised keyword score; below 0.3 the name is unknown.

    ``dense_02`` / ``dense_03``: number of pages with numeric density above 0.2 / 0.3.
    """
    w = D.CATEGORY_WORDS

    def share(low: Column, name: str, extra: Column | None = None) -> Column:
        hits = count_contains(low, w[name])
        size = F.lit(len(w[name]))
        part = hits / size if extra is None else (hits + extra) / (size + pages)
        return F.least(part * 2, F.lit(1.0))

    def decide(low: Column) -> Column:
        return _best(
            [
                ("invoice", share(low, "invoice", dense_02)),
                ("bank_statement", share(low, "bank_statement", dense_03)),
                ("govt_form", F.when(language.isin("hindi", "mixed"), share(low, "govt_form")).otherwise(0.0)),
                ("academic", share(low, "academic")),
                ("resume", share(low, "resume")),
                ("graphic", F.when(images / pages > 3, 0.7).otherwise(0.0)),
            ]
        )

    return let(
        let(F.lower(col(text)), decide),
        lambda b: F.struct(
            b["score"].alias("score"), F.when(b["score"] < 0.3, "unknown").otherwise(b["name"]).alias("name")
        ),
    )


def spaced(text: Column) -> Column:
    """Words between single blanks, so that ' word ' is a whole-word test."""
    return F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " "), F.lit(" "))


def document_type(
    text: str | Column, has_tables: Column, lexicon: Mapping[str, Sequence[str]] = D.TYPE_WORDS, whole_word: bool = False
) -> Column:
    """Class with most keywords; tables favour structured classes; text without any is digital_pdf."""
    low = spaced(F.lower(col(text))) if whole_word else F.lower(col(text))
    found = {n: [f" {x} " for x in w] if whole_word else list(w) for n, w in lexicon.items()}

    def decide(t: Column) -> Column:
        return _best(
            [(n, count_contains(t, w) + F.when(has_tables, D.TABLE_BOOST.get(n, 0)).otherwise(0)) for n, w in found.items()]
        )

    return let(
        let(low, decide),
        lambda best: first_rule(
            [(F.coalesce(F.length(col(text)), F.lit(0)) == 0, "unknown"), (best["score"] > 0, best["name"]),
             ((F.length(col(text)) > 100) & ~has_tables, "digital_pdf")],
            "unknown",
        ),
    )


def type_by_hits(text: str | Column, lexicon: Mapping[str, Sequence[str]] = D.SHEET_WORDS, min_hits: int = 2) -> Column:
    """Best class if it has at least ``min_hits`` keywords (sheet or word-block lexicon)."""
    best = let(F.lower(col(text)), lambda low: _best([(n, count_contains(low, w)) for n, w in lexicon.items()]))
    return let(best, lambda b: F.when(b["score"] >= min_hits, b["name"]).otherwise("unknown"))


def type_by_name(text: str | Column, filename: str | Column) -> Column:
    """File name, then first class with a keyword, then two finance words."""
    name, low = F.lower(col(filename)), F.lower(col(text))
    return first_rule(
        [(name.contains(w), t) for w, t in D.NAME_TYPES]
        + [(any_contains(low, ws), t) for ws, t in D.FIRST_WORD_TYPES]
        + [(count_contains(low, D.FINANCE_WORDS) >= 2, "bill")],
        "other",
    )


def alignment_peaks(words: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Most frequent x and y position (to the nearest ten) of each document, counted map-side first."""
    spots = words.select(
        doc,
        F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.bround(F.col("x0"), -1).alias("at")),
                          F.struct(F.lit("y").alias("axis"), F.bround(F.col("y0"), -1).alias("at")))).alias("s"),
    )
    counts = spots.groupBy(doc, "s.axis", "s.at").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(doc).agg(
        F.sum(F.when(F.col("axis") == "x", F.col("n"))).alias("items"),
        F.max(F.when(F.col("axis") == "x", F.col("n"))).alias("peak_x"),
        F.max(F.when(F.col("axis") == "y", F.col("n"))).alias("peak_y"),
    )


def id_card_facts(docs: DataFrame, text: str) -> DataFrame:
    """What the signals need of a text, two numbers in its place, so that joins carry no texts."""
    facts = {"chars": F.length(F.trim(text)), "card_words": count_contains(F.lower(text), D.ID_CARD_WORDS)}
    return docs.withColumns(facts).drop(text)


def id_card_signals(docs: DataFrame, pages: str, tables: str, items: str, peak_x: str, peak_y: str) -> DataFrame:
    """Page, keyword and layout signals, confidence and decision, of rows with `id_card_facts`."""
    density = F.col("chars") / F.greatest(F.lit(1), F.col(pages))
    few = F.col(pages) <= 2
    grid = (F.col(items) > 5) & ((F.col(peak_x) > 3) | (F.col(peak_y) > 3))
    flagged = docs.withColumns(
        {
            "page_signal": few & (density < 500) & (F.col(tables) == 0),
            "keyword_signal": F.col("card_words") >= 2,
            "layout_signal": ~F.coalesce(grid, F.lit(False)) & few & (density < 1000),
        }
    )
    page, word, layout = F.col("page_signal"), F.col("keyword_signal"), F.col("layout_signal")
    card = page & (word | layout)
    points = F.when(page, 40).otherwise(0) + F.when(word, 30).otherwise(0) + F.when(layout, 30).otherwise(0)
    return flagged.withColumns(
        {
            "confidence": F.when(card, F.least(F.lit(100), points + 10)).otherwise(points).cast("long"),
            "document_type": F.when(card, "ID_CARD").otherwise("NORMAL_PDF"),
        }
    )


def blank_or_template(text: str | Column, fields: Column | None = None, filled: Column | None = None) -> Column:
    """Hardly any text, mostly blanks, several placeholder words, or form fields all empty."""
    t = F.coalesce(col(text), F.lit(""))
    bare = F.length(F.regexp_replace(t, r"^\s+|\s+$", ""))
    test = (bare < 10) | (bare / F.length(t) < 0.1) | (count_contains(F.lower(t), D.PLACEHOLDER_WORDS) >= 2)
    return test if fields is None else test | ((fields > 0) & (filled == 0))


def long_number_with_spaces(text: str | Column) -> Column:
    """10 to 12 digits written with blanks."""
    return matches(text, r"\p{Nd}").between(10, 12) & col(text).contains(" ")


def numeric_sequence(text: str | Column, min_length: int = 10) -> Column:
    """At least ``min_length`` characters after removing separators, 80 % of them digits."""
    bare = F.translate(col(text), " -.", "")
    return (F.length(bare) >= min_length) & (matches(bare, r"\p{Nd}") / F.length(bare) >= 0.8)


def visual_document(facts: DataFrame) -> DataFrame:
    """Facts per document: items, total_area, image_area, text_area, boxes, pages, peak_x."""
    reason = first_rule(
        [
            (F.col("items") == 0, "no_text"),
            (F.col("image_area") / F.col("total_area") > 0.3, "images"),
            (F.col("text_area") / F.col("total_area") < 0.1, "little_text"),
            (F.col("boxes") > F.col("pages") * 5, "boxes"),
            ((F.col("items") > 100) & (F.col("peak_x") > F.col("items") * 0.3), "aligned_layout"),
        ]
    )
    return facts.withColumn("visual_reason", reason).withColumn("is_visual", reason.isNotNull())


def mixed_language(text: str | Column, sample_chars: int | None = None) -> Column:
    """I16: more than 5 % Devanagari (optionally of the first characters only)."""
    t = col(text) if sample_chars is None else F.substring(col(text), 1, sample_chars)
    return F.when(F.length(t) > 0, matches(t, DEVANAGARI) / F.length(t) > 0.05).otherwise(False)


def field_type(value: str | Column) -> Column:
    """I17."""
    v = F.lower(F.trim(col(value)))
    return first_rule(
        [
            (col(value).isNull() | (col(value) == ""), "text"),
            (any_contains(v, D.CHECKBOX_MARKS), "checkbox"),
            (any_contains(v, D.RADIO_MARKS), "radio"),
            (col(value).contains("\n") | (F.length(col(value)) > 100), "multiline"),
        ],
        "text",
    )


def field_state(value: str | Column, kind: Column) -> Column:
    """State of check boxes and radio buttons."""
    v = F.lower(F.trim(col(value)))
    return first_rule(
        [
            (kind == "checkbox", F.when(v.isin(*D.CHECKED), "checked").otherwise("unchecked")),
            (kind == "radio", F.when(v.isin(*D.SELECTED), "selected").otherwise("unselected")),
        ]
    )


def field_label(name: str | Column, value: str | Column, kind: Column, state: Column) -> Column:
    """I17: 'name: value' text with a mark for check boxes and radio buttons."""
    n, v = col(name), col(value)
    return first_rule(
        [
            (kind == "checkbox", F.concat(n, F.lit(": "), F.when(state == "checked", "✓").otherwise("☐"))),
            (kind == "radio", F.concat(n, F.lit(": "), F.when(state == "selected", "●").otherwise("○"), F.lit(" "), v)),
            (kind == "multiline", F.concat(n, F.lit(":\n"), v)),
        ],
        F.concat(n, F.lit(": "), v),
    )


def recommend_tool(docs: DataFrame, tables: Column, id_card: Column, has_text: Column, scanned: Column) -> DataFrame:
    """Tool, engine, premium need and credits per page."""
    kinds = [(tables | id_card, 0), (has_text, 1), (scanned, 2)]

    def pick(*values: object) -> Column:
        return first_rule([(c, values[i]) for c, i in kinds], values[3])

    return docs.withColumns(
        {
            "suggested_tool": pick("excel", "word", "word", "word"),
            "engine": pick("docai", "libreoffice", "docai", "libreoffice"),
            "requires_premium": pick(True, False, True, False),
            "credits_per_page": pick(2.0, 2.0, 5.0, 0.0),
        }
    )


def text_similarity(a: str | Column, b: str | Column) -> Column:
    """Equal 1, contained 0.8, else shared words over all words."""
    x, y = (F.lower(F.regexp_replace(col(c), r"^\s+|\s+$", "")) for c in (a, b))
    wx, wy = (F.filter(F.split(t, r"\s+"), lambda w: w != "") for t in (x, y))
    union = F.size(F.array_union(wx, wy))
    return first_rule(
        [
            (F.coalesce(F.length(col(a)), F.lit(0)) == 0, 0.0),
            (F.coalesce(F.length(col(b)), F.lit(0)) == 0, 0.0),
            (x == y, 1.0),
            (x.contains(y) | y.contains(x), 0.8),
        ],
        F.when(union > 0, F.size(F.array_intersect(wx, wy)) / union).otherwise(0.0),
    )


def script_class(text: str | Column) -> Column:
    """Devanagari / latin / numeric / mixed by share of all characters."""
    n = F.length(col(text))
    return first_rule(
        [
            (n.isNull() | (n == 0), "unknown"),
            (matches(text, DEVANAGARI) / n > 0.3, "devanagari"),
            (matches(text, "[A-Za-z]") / n > 0.3, "latin"),
            (matches(text, r"\p{Nd}") / n > 0.5, "numeric"),
        ],
        "mixed",
    )


def processing_notes(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Pages, table pages, images and the notes they give. pages(doc, has_tables, images, needs_ocr)."""
    facts = pages.groupBy(doc).agg(
        F.count(F.lit(1)).alias("pages"), long_count(F.col("has_tables")).alias("table_pages"),
        F.sum("images").alias("images"), F.bool_or("needs_ocr").alias("needs_ocr"),
    )
    return facts.withColumn(
        "notes",
        labels_where([(F.col("needs_ocr"), "ocr_required"), (F.col("table_pages") > 0, "tables"), (F.col("images") > 0, "images")]),
    )


def form_type(text: str | Column, filename: str | Column) -> Column:
    """I22."""
    low, name = F.lower(col(text)), F.lower(col(filename))
    return first_rule(
        [
            (any_contains(name, ["application", "form"]) & any_contains(low, D.APPLICATION_WORDS), "application_form"),
            (any_contains(low, D.APPLICATION_TEXTS), "application_form"),
            (any_contains(low, D.GOVERNMENT_WORDS) & any_contains(low, ["form", "application"]), "government_form"),
        ],
        "standard",
    )


def needs_two_columns(text: str | Column, filename: str | Column) -> Column:
    """Forms keep their structure; listed names and texts take two columns."""
    low, name = F.lower(col(text)), F.lower(col(filename))
    listed = (
        any_contains(name, D.TWO_COLUMN_NAMES) | any_contains(low, D.TWO_COLUMN_TEXTS)
        | (low.contains("objective") & low.contains("education"))
    )
    return (form_type(text, filename) == "standard") & listed


def allows_table_processing(doc_type: Column, structured: Column) -> Column:
    """``structured``: some table has at least 3 rows and 2 columns."""
    return structured & doc_type.isin("invoice", "bank_statement", "bill", "office_document", "unknown")


def layout_category(doc_type: Column, has_tables: Column, confidence: Column, fields: Column, blocks: Column) -> Column:
    """true_table / key_value / mixed_layout / plain_text."""
    return first_rule(
        [
            (has_tables & (confidence >= 0.65), "true_table"),
            (doc_type.isin("bill", "invoice", "bank_statement") | fields, "key_value"),
            (blocks & (fields | has_tables), "mixed_layout"),
        ],
        "plain_text",
    )


def visual_page_score(
    words: DataFrame, page_facts: DataFrame, width: float, height: float, doc: str = "doc_id", page: str = "page"
) -> DataFrame:
    """Points for images (30), little text (25), rectangles (20), boxed text (15) and a logo (10).

    page_facts(doc, page, image_density, rectangles) are measured outside; y0 counts from the top.
    """
    key = [doc, page]
    size = F.col("font_size")
    rows = words.groupBy(*key, (F.floor(F.col("y0") / 10 + 0.5) * 10).alias("__y")).agg(
        F.collect_list((F.floor(F.col("x0") / 20 + 0.5) * 20).cast("double")).alias("__xs"),
        F.count(F.lit(1)).alias("__n"),
        F.sum((F.col("x1") - F.col("x0")) * size).alias("__area"),  # whole points add up exactly, in any order
        F.bool_or((F.col("y0") < height * 0.2) & (size > 20) & (F.abs(F.col("x0") - width / 2) < width * 0.3)).alias("__logo"),
    )
    per_page = rows.groupBy(*key).agg(
        F.sum("__n").alias("__items"), F.count(F.lit(1)).alias("__rows"),
        F.least(F.sum("__area") * 1.2 / F.lit(width * height), F.lit(1.0)).alias("text_density"),
        F.bool_or("__logo").alias("logo"),
        F.min_by("__xs", "__y").alias("__top"), F.max_by("__xs", "__y").alias("__bottom"),
    )
    aligned = F.size(F.filter("__top", lambda a: F.exists("__bottom", lambda b: F.abs(a - b) < 30)))
    boxed = (
        (F.col("__items") >= 4) & (F.col("__rows") >= 2) & (F.size("__top") >= 2) & (F.size("__bottom") >= 2)
        & (aligned >= F.least(F.size("__top"), F.size("__bottom")) * 0.5)
    )
    scored = per_page.join(page_facts, key, "left").withColumn("boxed", boxed).withColumn(
        "score",
        (
            F.when(F.col("image_density") > 0.4, 30).otherwise(0) + F.when(F.col("text_density") < 0.15, 25).otherwise(0)
            + F.when(F.col("rectangles"), 20).otherwise(0) + F.when(F.col("boxed"), 15).otherwise(0)
            + F.when(F.col("logo"), 10).otherwise(0)
        ).cast("long"),
    )
    return scored.select(
        *key, F.round("text_density", 9).alias("text_density"), "boxed", "logo", "score", (F.col("score") >= 50).alias("is_visual")
    )


def id_card_layout(rows: DataFrame, text: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Three card words, or two with some row of exactly two filled cells.

    rows(doc, filled) counts filled cells per table row; text(doc, text) is the page text.
    """
    shape = rows.groupBy(doc).agg(F.count(F.lit(1)).alias("rows"), F.bool_or(F.col("filled") == 2).alias("pairs"))
    found = text.select(doc, count_contains(F.lower("text"), D.ID_LAYOUT_WORDS).alias("words"))
    return shape.join(found, doc).withColumn(
        "is_id_card",
        (F.col("rows") >= 2) & ((F.col("words") >= 3) | ((F.col("words") >= 2) & F.col("pairs"))),
    )
