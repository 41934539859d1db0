"""Quality scores, quality gates and routing (survey group L)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillmeter.functions.exprs import col, first_rule, labels_where, let, long_count
from quillmeter.operators.layout import KEY

FALLBACK_ENGINE = "adobe"
MAX_FALLBACK_PAGES, MANY_PAGES = 50, 20
COMPLEX_TYPES = ("bank_statement", "govt_form", "utility_bill")
BILL_TYPES = ("invoice", "bill", "bank_statement")


def _unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def table_confidence(cells: DataFrame) -> DataFrame:
    """L1: 0.30 row spacing + 0.30 column alignment + 0.25 full rows + 0.15 density, positions as page
    fractions. A page is bounded; rows and columns are aggregated once each."""
    xc, yc = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    rows = cells.groupBy(*KEY, "row").agg(
        F.avg(yc).alias("y"), F.size(F.collect_set("col")).alias("cols"), F.max("col").alias("last"), F.count(F.lit(1)).alias("n")
    )
    step = F.abs(F.col("y") - F.lag("y").over(W.partitionBy(*KEY).orderBy("row")))
    page = rows.withColumn("step", step).groupBy(*KEY).agg(
        F.avg("step").alias("mean"), F.stddev_pop("step").alias("std"), F.count(F.lit(1)).alias("nrows"), F.max("row").alias("lr"),
        F.max("last").alias("lc"), F.sum("n").alias("cells"), F.collect_list("cols").alias("widths"),
    )
    spread = cells.groupBy(*KEY, "col").agg((F.max(xc) - F.min(xc)).alias("s")).groupBy(*KEY).agg(F.avg("s").alias("spread"))
    full = F.size(F.filter("widths", lambda w: w == F.col("lc") + 1)) / F.col("nrows")
    parts = page.join(spread, KEY).select(
        *KEY,
        F.when(F.col("nrows") < 2, 0.5).otherwise(_unit(1 - F.col("std") / (F.col("mean") + 1e-6))).alias("row_consistency"),
        _unit(1 - F.col("spread") / 0.05).alias("column_alignment"),
        full.alias("grid_continuity"),
        F.least(F.lit(1.0), F.col("cells") / ((F.col("lr") + 1) * (F.col("lc") + 1))).alias("cell_density"),
    )
    return parts.withColumn(
        "confidence",
        0.30 * F.col("row_consistency") + 0.30 * F.col("column_alignment") + 0.25 * F.col("grid_continuity") + 0.15 * F.col("cell_density"),
    )


def simple_table_confidence(header_rows: Column, body_rows: Column, header_cols: Column, body_cols: Column) -> Column:
    """L2: 0.4 rows + 0.3 columns + 0.3 continuity; a table without rows or columns scores 0.3."""
    rows = header_rows + body_rows
    both = (header_rows > 0) & (body_rows > 0)
    widest = F.greatest(header_cols, body_cols)
    cols = F.when(both, 1 - F.least(F.lit(1.0), F.abs(header_cols - body_cols) / F.greatest(widest, F.lit(1)))).otherwise(0.8)
    chain = first_rule([(both, 1.0), (rows >= 3, 0.6)], 0.0)
    return F.when((rows == 0) | (widest == 0), 0.3).otherwise(F.least(F.lit(1.0), rows / 10.0) * 0.4 + cols * 0.3 + chain * 0.3)


def mean_cell_confidence(cells: DataFrame, confidence: str = "confidence") -> DataFrame:
    """L3: mean confidence less 0.2 times the share below 0.7 (1 when no cell has one)."""
    c = F.when(F.col(confidence) > 0, F.col(confidence))
    low = F.count_if(c < 0.7) / F.nullif(F.count(c), F.lit(0))
    return cells.groupBy(*KEY).agg(F.coalesce(F.greatest(F.lit(0.0), F.avg(c) - low * 0.2), F.lit(1.0)).alias("table_confidence"))


def layout_warnings(shapes: DataFrame) -> DataFrame:
    """L4: warnings per page from its rows and widest row: empty, collapsed into one column, very long."""
    rows, wide = F.col("rows"), F.col("max_cols")
    return shapes.withColumn(
        "page_warnings",
        labels_where([(rows == 0, "empty"), ((rows > 3) & (wide == 1), "single_column"), (rows > 500, "many_rows")]),
    )


def conversion_status(runs: DataFrame) -> DataFrame:
    """L4: PASS / WARN / FAIL with reasons. runs: engine, premium, confidence, pages, page_warnings (count),
    has_gates, gates_passed, estimated_pages, no_structural_failure."""
    fallback = F.col("engine") == FALLBACK_ENGINE
    unasked = fallback & ~F.col("premium")
    weak = ~fallback & F.col("premium") & (F.col("confidence") < 0.65) & ~(F.col("has_gates") & F.col("no_structural_failure"))
    too_long = fallback & (F.col("pages") > MAX_FALLBACK_PAGES)
    mismatch = fallback & F.col("has_gates") & (F.col("estimated_pages") != F.col("pages"))
    warnings = labels_where([(unasked, "fallback_without_premium"), (weak, "premium_without_fallback"), (F.col("page_warnings") > 0, "layout")])
    errors = labels_where([(too_long, "page_limit"), (~too_long & mismatch, "page_estimate")])
    safety = first_rule(
        [(~fallback, "not_needed"), (~F.col("has_gates"), "no_gates"), (F.col("gates_passed") < 5, "gates_missing")], "all_gates"
    )
    return runs.withColumns({"warnings": warnings, "errors": errors, "fallback_safety": safety}).withColumn(
        "qa_status", first_rule([(F.col("errors") != "", "FAIL"), (F.col("warnings") != "", "WARN")], "PASS")
    )


def passes_quality_gate(max_row: Column, max_col: Column, filled: Column) -> Column:
    """More than one row, more than one column, some text."""
    return (max_row > 0) & (max_col > 0) & (filled > 0)


def determinism_hash(name: str | Column, engine: str | Column, confidence: str | Column, premium: str | Column) -> Column:
    """L6."""
    flag = F.when(col(premium), "True").otherwise("False")
    return F.substring(F.md5(F.concat_ws("|", col(name), col(engine), F.format_string("%.4f", col(confidence)), flag)), 1, 16)


def visual_complexity(words: DataFrame, has_tables: DataFrame, sample: int | None = None, doc: str = "doc_id") -> DataFrame:
    """0.4 number of blocks + 0.3 tables + 0.3 spread of block areas; level from 0.5 and 0.7.
    has_tables(doc_id, has_tables). ``sample`` limits the spread to the first blocks (by word_id)."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    if sample is not None:
        place = F.row_number().over(W.partitionBy(doc).orderBy("word_id"))
        words = words.withColumn("__n", place)
        area = F.when(F.col("__n") <= sample, area)
    facts = words.groupBy(doc).agg(
        F.count(F.lit(1)).alias("blocks"), F.avg(area).alias("__mean"), F.coalesce(F.stddev_samp(area), F.lit(0.0)).alias("__std")
    ).join(has_tables, doc, "left")
    score = (
        F.least(F.lit(1.0), F.col("blocks") / 150.0) * 0.4 + F.when(F.col("has_tables"), 0.5).otherwise(0.0) * 0.3
        + F.when(F.col("__mean") > 0, F.least(F.lit(1.0), F.col("__std") / F.col("__mean") * 0.5)).otherwise(0.0) * 0.3
    )
    return facts.select(doc, "blocks", F.round(score, 9).alias("complexity")).withColumn(
        "level", first_rule([(F.col("complexity") >= 0.7, "HIGH"), (F.col("complexity") >= 0.5, "MEDIUM")], "LOW")
    )


def label_value_lines(text: str | Column, max_lines: int | None = None) -> Column:
    """Number of lines of the form 'label: value' (optionally among the first lines only)."""
    lines = F.split(col(text), "\n")
    lines = lines if max_lines is None else F.slice(lines, 1, max_lines)

    def is_pair(line: Column) -> Column:
        return let(F.split(line, ":"), lambda p: (F.size(p) == 2) & p[0].rlike(r"\S") & F.get(p, F.lit(1)).rlike(r"\S"))

    return F.size(F.filter(lines, is_pair)).cast("long")


def key_value_eligibility(docs: DataFrame) -> DataFrame:
    """Docs with columns, table_confidence, kv_lines, row_grid, doc_type, fields. First blocking reason or
    the confidence of the key/value mode."""
    blocked = first_rule(
        [
            (F.col("columns") > 1, "columns"), (F.col("table_confidence") >= 0.4, "table_confidence"),
            (F.col("kv_lines") < 3, "few_pairs"), (F.col("row_grid"), "row_grid"),
        ]
    )
    confidence = first_rule([(F.col("doc_type").isin(*BILL_TYPES), 0.9), (F.col("fields") > 0, 0.8)], 0.7)
    return docs.withColumn("kv_blocked_by", blocked).withColumns(
        {"kv_eligible": F.col("kv_blocked_by").isNull(), "kv_confidence": F.when(F.col("kv_blocked_by").isNull(), confidence).otherwise(0.0)}
    )


def route(docs: DataFrame) -> DataFrame:
    """Execution mode and confidence by ordered rules.

    docs carry form_parser, columns, valid_tables, has_cells, doc_type, visual, visual_confidence, pages,
    label_value (left/right pattern), and the columns of ``key_value_eligibility``.
    """
    tables, kind = F.col("valid_tables"), F.col("doc_type")
    digital = kind == "digital_pdf"
    visual = digital & F.col("visual")
    many = F.col("columns") >= 2
    real = (tables > 0) & F.col("has_cells")

    def capped(base: float) -> Column:
        return F.least(F.lit(1.0), tables * 0.3 + base)

    rules = [
        (F.col("form_parser"), "GEOMETRIC_HYBRID", F.lit(0.95)),
        (many & real, "TABLE_STRICT", capped(0.6)),
        (many & (tables > 0), "TABLE_VISUAL", F.lit(0.8)),
        (many & visual, "TABLE_VISUAL", F.least(F.lit(1.0), F.col("visual_confidence") + 0.2)),
        (many, "TABLE_VISUAL", F.lit(0.7)),
        ((tables > 0) & ~F.col("has_cells"), "TABLE_VISUAL", F.lit(0.8)),
        (real & kind.isin(*BILL_TYPES[:2], "bank_statement"), "TABLE_STRICT", capped(0.5)),
        (real, "TABLE_STRICT", capped(0.4)),
        (visual & (F.col("visual_confidence") >= 0.8), "TABLE_VISUAL", F.col("visual_confidence")),
        ((F.col("pages") == 1) & (tables == 0) & F.col("label_value"), "KEY_VALUE", F.lit(0.95)),
        (F.col("kv_eligible"), "KEY_VALUE", F.col("kv_confidence")),
    ]
    return docs.withColumns(
        {
            "mode": first_rule([(c, m) for c, m, _ in rules], "PLAIN_TEXT"),
            "route_confidence": first_rule([(c, v) for c, _, v in rules], 0.5),
        }
    )


def mean_word_confidence(words: DataFrame, confidence: str = "confidence", doc: str = "doc_id") -> DataFrame:
    """Mean over positive confidences."""
    return words.groupBy(doc).agg(F.avg(F.when(F.col(confidence) > 0, F.col(confidence))).alias("mean_confidence"))


def run_summary(runs: DataFrame, status: str = "status") -> DataFrame:
    """Runs by status."""
    return runs.groupBy(status).agg(F.count(F.lit(1)).alias("runs"))


def structural_failures(docs: DataFrame) -> DataFrame:
    """Docs with rows, columns, merged_cells, blocks, x_span, font_sizes, doc_type."""
    one = F.col("columns") == 1
    return docs.withColumn(
        "failures",
        labels_where(
            [
                ((F.col("rows") > 0) & one & (F.col("blocks") > 5) & (F.col("x_span") > 0.3), "single_column_collapse"),
                ((F.col("rows") >= 5) & one & (F.col("blocks") > 10) & (F.col("x_span") > 0.4), "multi_column_collapse"),
                (F.col("merged_cells") >= 3, "complex_merges"),
                ((F.col("blocks") > 100) & (F.col("font_sizes") >= 4), "visual_complexity"),
                (F.col("doc_type").isin(*COMPLEX_TYPES), "complex_type"),
            ]
        ),
    )


def fallback_gates(docs: DataFrame) -> DataFrame:
    """Gates in order with the lists of passed and failed ones and the cost estimate.

    docs with wants_premium, confidence, failures, pages, max_row, max_col, blocks, x_span. A page collapsed
    into one column counts as a failure too.
    """
    collapsed = (F.col("max_col") == 0) & (F.col("max_row") > 5) & (F.col("blocks") > 10) & (F.col("x_span") > 0.4)
    broken = (F.col("failures") != "") | collapsed
    g1 = F.col("wants_premium")
    g2 = g1 & (F.col("confidence") < 0.3)
    g3 = g2 & broken
    g5 = g3 & (F.col("pages") <= MAX_FALLBACK_PAGES)
    many = g3 & (F.col("pages") > MANY_PAGES)
    cost = F.least("pages", F.lit(10)) * 15 + F.greatest(F.col("pages") - 10, F.lit(0)) * 5
    return docs.withColumns(
        {
            "gates_passed": labels_where(
                [(g1, "premium_toggle_on"), (g2, "very_low_confidence"), (g3, "structural_failures"), (g3, "page_count_ok"), (g5, "within_cost_caps")]
            ),
            "gates_failed": labels_where(
                [(~g1, "premium_toggle_off"), (g1 & ~g2, "confidence_too_high"), (g2 & ~g3, "no_structural_failures"),
                 (many, "excessive_pages"), (g3 & ~g5, "page_limit_exceeded")]
            ),
            "allowed": g5,
            "estimated_pages": F.when(g5, F.col("pages")).otherwise(0).cast("long"),
            "estimated_credits": F.when(g5, cost).otherwise(0).cast("long"),
        }
    )


def simple_fallback(plan: Column, confidence: Column, complexity: Column) -> Column:
    """Premium plan, confidence below 0.65 and complexity of at least 0.6."""
    return (plan == "premium") & (confidence < 0.65) & (complexity >= 0.6)


def visual_table_confidence(facts: DataFrame) -> DataFrame:
    """0.4 aligned rows / 10 + 0.3 bands / 5 + 0.3 numeric blocks / 10, zero for no candidates."""
    score = F.least(
        F.lit(1.0), F.col("aligned_rows") / 10.0 * 0.4 + F.col("vertical_bands") / 5.0 * 0.3 + F.col("numeric_blocks") / 10.0 * 0.3
    )
    return facts.withColumn("visual_confidence", F.when(F.col("is_candidate"), score).otherwise(0.0))


def page_spans(words: DataFrame, width: float = 1.0) -> DataFrame:
    """Facts for L12 and L13 per document: blocks, spread of centres as a share of ``width``, font sizes.
    Centres are taken before they are divided, so that a spread next to a limit does not depend on the unit of words."""
    xc = (F.col("x0") + F.col("x1")) / 2
    return words.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("blocks"), (F.max(xc) / F.lit(width) - F.min(xc) / F.lit(width)).alias("x_span"),
        F.size(F.collect_set("font_size")).cast("long").alias("font_sizes"), long_count(F.col("bold")).alias("bold_words"),
    )
