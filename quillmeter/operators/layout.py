"""Rows, columns and cells from positioned words (survey group J): the parts Spark can declare.

Input ``words``: doc_id, page, word_id, text, x0, y0, x1, y1, font_size, bold, confidence; y grows
downwards. Every window and aggregation works on (doc_id, page), which is a bounded group, and the
words already arrive hash-partitioned by document, so the chain runs on one exchange.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillmeter.functions.exprs import col, first_rule, let, long_count
from quillmeter.operators import pagefolds
from quillmeter.operators.pagefolds import match_blocks, page_facts
from quillmeter.operators.profile import long_number_with_spaces, matches
from quillmeter.operators.textjoin import bare

KEY = ["doc_id", "page"]


def x_center() -> Column:
    return (F.col("x0") + F.col("x1")) / 2


def y_center() -> Column:
    return (F.col("y0") + F.col("y1")) / 2


def unit_page(words: DataFrame, width: float, height: float) -> DataFrame:
    """Positions as fractions of the page."""
    return words.withColumns(
        {
            "x0": F.col("x0") / width, "x1": F.col("x1") / width,
            "y0": F.col("y0") / height, "y1": F.col("y1") / height,
        }
    )


def ordered_text(order: str | Column = "word_id", text: str | Column = "text", sep: str = " ") -> Column:
    """Aggregate: texts of a bounded group joined in order."""
    pairs = F.array_sort(F.collect_list(F.struct(col(order).alias("o"), col(text).alias("t"))))
    return F.array_join(F.transform(pairs, lambda p: p["t"]), sep)


def valid_blocks(words: DataFrame) -> DataFrame:
    """Words with text and a box of positive size."""
    return words.where(
        (F.trim("text") != "") & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    )


def line_height(words: DataFrame) -> DataFrame:
    """Average height per page."""
    return words.where(F.col("y1") > F.col("y0")).groupBy(*KEY).agg(
        F.coalesce(F.avg(F.col("y1") - F.col("y0")), F.lit(0.02)).alias("line_height")
    )


def islands(
    df: DataFrame, pos: Column, tol: float | Column, label: str, part: list[str] | None = None,
    order: list[str] | None = None, strict: bool = False, absolute: bool = False,
) -> DataFrame:
    """Number runs of positions: a gap above ``tol`` to the previous position starts a new run.
    ``strict`` also breaks at a gap equal to ``tol``; ``absolute`` is for orders other than by position."""
    part = part or KEY
    w = W.partitionBy(*part).orderBy(*(order or ["__pos"]))
    step = F.col("__pos") - F.lag("__pos").over(w)
    step = F.abs(step) if absolute else step
    limit = F.lit(tol) if isinstance(tol, (int, float)) else tol
    opens = F.coalesce(step >= limit if strict else step > limit, F.lit(False)).cast("int")
    return (
        df.withColumn("__pos", pos)
        .withColumn("__open", opens)
        .withColumn(label, F.sum("__open").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long"))
        .drop("__pos", "__open")
    )


def row_bands(words: DataFrame, tol: float) -> DataFrame:
    """Bands of sorted centres; adds the row and the mean centre of its band."""
    banded = islands(words.withColumn("yc", y_center()), F.col("yc"), tol, "row", order=["__pos", "word_id"])
    return banded.withColumn("row_center", F.avg("yc").over(W.partitionBy(*KEY, "row"))).drop("yc")


def rows_in_order(words: DataFrame, tol: float) -> DataFrame:
    """Reading order; a new row where the centre moves by more than ``tol``."""
    return islands(words, y_center(), tol, "row", order=["word_id"], absolute=True)


def rounded_y(parts_per_page: int) -> Column:
    """Centre rounded to 1/n of the page (n = 50 or 100)."""
    return (F.rint(y_center() * parts_per_page) + 0.0) / parts_per_page


def with_row_number(words: DataFrame, key: Column) -> DataFrame:
    """Rows numbered from zero by an ascending key."""
    w = W.partitionBy(*KEY).orderBy("__rk")
    return words.withColumn("__rk", key).withColumn("row", (F.dense_rank().over(w) - 1).cast("long")).drop("__rk")


def columns_by_left_edge(words: DataFrame, tol: float = 10.0) -> DataFrame:
    """Runs of distinct left edges; a column ends ``tol`` before the next one begins."""
    edges = words.groupBy(*KEY, "x0").agg(F.max("x1").alias("x1"))
    runs = islands(edges, F.col("x0"), tol, "col").groupBy(*KEY, "col").agg(
        F.avg("x0").alias("x0"), F.max("x1").alias("__x1")
    )
    w = W.partitionBy(*KEY).orderBy("col")
    page_end = F.max("__x1").over(W.partitionBy(*KEY))
    return runs.withColumn("x1", F.coalesce(F.lead("x0").over(w) - tol, page_end)).drop("__x1")


def weighted_columns(
    rows: DataFrame, hints: DataFrame | None = None, chars: float = 3.0, least: float = 15.0, share: float = 0.1
) -> DataFrame:
    """Frequency-weighted columns of words that carry a ``row``.

    Words of one column are closer than three characters (two next to ruled lines). Columns seen in
    fewer than a tenth of the rows are noise unless a ruled line marks them. hints(doc_id, page, x).
    """
    per_row = rows.groupBy(*KEY, "row").agg(F.min_by("font_size", "word_id").alias("f"))
    fonts = per_row.groupBy(*KEY).agg(F.avg("f").alias("__font"), F.count(F.lit(1)).alias("__rows"))
    if hints is not None:
        lines = hints.groupBy(*KEY).agg(F.sort_array(F.collect_set("x")).alias("__hints"))
        fonts = fonts.join(lines, KEY, "left")
    else:
        fonts = fonts.withColumn("__hints", F.lit(None).cast("array<double>"))
    marks = F.coalesce("__hints", F.array().cast("array<double>"))
    fonts = fonts.withColumn("__hints", marks).withColumn(
        "__tol",
        F.when(F.size("__hints") > 0, F.greatest(F.col("__font") * 0.6 * 2, F.lit(10.0)))
        .otherwise(F.greatest(F.col("__font") * 0.6 * chars, F.lit(least))),
    )
    spots = rows.groupBy(*KEY, F.floor(F.col("x0") + 0.5).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*KEY).orderBy("x")
    gap = F.col("x") - F.lag("x").over(w)
    near_line = F.exists("__hints", lambda h: F.abs(F.col("x") - h) < 5) & (F.col("__gap") > F.col("__tol") / 2)
    runs = (
        spots.join(fonts, KEY)
        .withColumn("__gap", gap)
        .withColumn("__open", F.coalesce((F.col("__gap") >= F.col("__tol")) | near_line, F.lit(False)).cast("int"))
        .withColumn("run", F.sum("__open").over(w.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*KEY, "run")
        .agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"), F.sum("n").alias("weight"),
             F.first("__rows").alias("__rows"), F.first("__hints").alias("__hints"))
    )
    snapped = F.get(F.filter("__hints", lambda h: F.abs(F.col("x") - h) < 10), F.lit(0))
    found = runs.select(
        *KEY, F.coalesce(snapped, F.col("x")).alias("x"), "weight", snapped.isNotNull().alias("ruled"),
        (F.col("weight") >= F.col("__rows") * share).alias("__often"),
    )
    if hints is not None:
        known = found.groupBy(*KEY).agg(F.collect_list("x").alias("__known"))
        extra = hints.select(*KEY, "x").distinct().join(known, KEY, "left").where(
            ~F.exists(F.coalesce("__known", F.array().cast("array<double>")), lambda b: F.abs(b - F.col("x")) < 10)
        )
        found = found.unionByName(
            extra.select(*KEY, "x", F.lit(0).cast("long").alias("weight"), F.lit(True).alias("ruled"), F.lit(True).alias("__often"))
        )
    keep = F.col("__often") | F.col("ruled")
    some = F.bool_or("__keep").over(W.partitionBy(*KEY))
    kept = found.withColumn("__keep", keep).withColumn("__some", some).where(F.col("__keep") | ~F.col("__some"))
    return kept.select(
        *KEY, (F.row_number().over(W.partitionBy(*KEY).orderBy("x", "weight")) - 1).cast("long").alias("col"), "x", "weight", "ruled"
    )


def nearest_band(cells: DataFrame, bands: DataFrame, tol: float) -> DataFrame:
    """``row`` of each cell is the row band (doc_id, page, row, y) nearest to its centre, the upper one of two
    equally near; cells farther than ``tol`` from any band drop out. Cells and bands are merged in the order of y, so a
    cell looks at the bands before and behind it only."""
    columns = [c for c in cells.columns if c != "row"]
    keyed = cells.select(*KEY, y_center().alias("__y"), F.struct(*columns).alias("__cell"), F.lit(None).cast("struct<y:double,row:bigint>").alias("__band"))
    empty = F.lit(None).cast(keyed.schema["__cell"].dataType)
    marks = bands.select(*KEY, F.col("y").alias("__y"), empty.alias("__cell"), F.struct(F.col("y").cast("double").alias("y"), F.col("row").cast("bigint").alias("row")).alias("__band"))
    order = W.partitionBy(*KEY).orderBy("__y", F.col("__band").isNull())
    before = F.last("__band", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    behind = F.first("__band", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    placed = keyed.unionByName(marks).withColumns({"__a": before, "__b": behind}).where("__cell IS NOT NULL")
    da, db = F.abs(F.col("__a.y") - F.col("__y")), F.abs(F.col("__b.y") - F.col("__y"))
    first = F.col("__b").isNull() | (da <= db)
    near = placed.withColumns({"row": F.when(first, F.col("__a.row")).otherwise(F.col("__b.row")), "__d": F.when(first, da).otherwise(db)})
    return near.where(F.col("__d") <= tol).select("__cell.*", "row")


def consensus_columns(rows: DataFrame, tol: float = 0.04, share: float = 0.6) -> DataFrame:
    """Column runs of centres seen within ``tol`` in at least floor(share x rows) rows; if none
    qualifies the leftmost stays."""
    spots = rows.select(*KEY, "row", x_center().alias("x")).distinct()
    # One position counts once per row it occurs in, as in a list of all rows' positions. Runs lie more than ``tol``
    # apart and hold their centre, so only a run's own positions can be near it.
    page, run = W.partitionBy(*KEY), W.partitionBy(*KEY, "run")
    runs = islands(spots, F.col("x"), tol, "run", order=["__pos", "row"]).withColumn("cx", F.avg("x").over(run))
    near = F.collect_set(F.when(F.abs(F.col("x") - F.col("cx")) <= tol, F.col("row")))
    found = runs.groupBy(*KEY, "run", "cx").agg(F.size(near).cast("long").alias("row_support"), F.collect_set("row").alias("__in"))
    all_rows = F.size(F.array_distinct(F.flatten(F.collect_list("__in").over(page))))
    chosen = found.withColumn("__ok", F.col("row_support") >= F.floor(all_rows * share)).withColumns(
        {"__some": F.bool_or("__ok").over(page), "__first": F.min("cx").over(page)}
    ).where(F.col("__ok") | (~F.col("__some") & (F.col("cx") == F.col("__first"))))
    return chosen.select(
        *KEY, (F.row_number().over(page.orderBy("cx")) - 1).cast("long").alias("col"), F.col("cx").alias("x"), "row_support"
    )


def _cluster_medians(spots: DataFrame, tol: float) -> DataFrame:
    """Runs of distinct positions x with the upper median of each run."""
    runs = islands(spots, F.col("x"), tol, "col").groupBy(*KEY, "col").agg(F.sort_array(F.collect_list("x")).alias("__xs"))
    return runs.select(*KEY, "col", F.get("__xs", F.floor(F.size("__xs") / 2).cast("int")).alias("x"))


def header_anchors(rows: DataFrame, header_rows: DataFrame, tol: float = 0.02) -> DataFrame:
    """Anchors from left, right and centre of header words; pages without headers use row 0.
    header_rows(doc_id, page, row)."""
    spots = rows.select(*KEY, "row", F.array("x0", "x1", x_center()).alias("__xs"), F.lit(False).alias("__h"))
    marks = header_rows.select(*KEY, F.col("row").cast(spots.schema["row"].dataType).alias("row"), F.lit(None).cast("array<double>").alias("__xs"), F.lit(True).alias("__h"))
    # A join by page or row would exchange all words again (Spark asks of both sides to be dealt by every key of it).
    header = F.max("__h").over(W.partitionBy(*KEY, "row")) | ((F.col("row") == 0) & ~F.max("__h").over(W.partitionBy(*KEY)))
    heads = spots.unionByName(marks).withColumn("__in", header).where("__in AND NOT __h")
    return _cluster_medians(heads.select(*KEY, F.explode("__xs").alias("x")).distinct(), tol)


def global_columns(words: DataFrame, tol: float = 0.02) -> DataFrame:
    """Runs of distinct centres with their median."""
    return _cluster_medians(words.select(*KEY, x_center().alias("x")).distinct(), tol)


def _anchor_arrays(columns: DataFrame, x: str) -> DataFrame:
    return columns.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), F.col("col").alias("c")))).alias("__anchors"))


def assign_nearest(words: DataFrame, columns: DataFrame, pos: Column | None = None, x: str = "x") -> DataFrame:
    """Nearest column of the page, the left one on ties. Adds col, anchor_x, distance (null on pages
    without columns).

    Words and anchors are merged in position order: each word meets the last anchor at or before it, which
    carries its right neighbour. One sort per page instead of one comparison per word and anchor.
    """
    return _assign_nearest(words, columns, pos, x).drop("__last")


def _assign_nearest(words: DataFrame, columns: DataFrame, pos: Column | None = None, x: str = "x") -> DataFrame:
    """``assign_nearest`` with the last column of the page, null on pages without columns, as __last."""
    at = x_center() if pos is None else pos
    page = W.partitionBy(*KEY)
    right = page.orderBy("__at")
    anchor = F.struct(F.col("__at").alias("x"), F.col("col").alias("c"))
    marks = columns.select(*KEY, "col", F.col(x).alias("__at")).withColumn("__a", anchor)
    marks = marks.select(*KEY, "__at", F.struct("__a", F.lead("__a").over(right).alias("n")).alias("__mark"), F.lit(0).alias("__kind"))
    merged = words.withColumns({"__at": at, "__kind": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    seen = page.orderBy("__at", "__kind").rowsBetween(W.unboundedPreceding, 0)
    near = merged.withColumns(
        {"__prev": F.last("__mark", ignorenulls=True).over(seen), "__first": F.min("__mark.__a").over(page), "__last": F.max("__mark.__a.c").over(page)}
    ).where(F.col("__kind") == 1)
    here = F.coalesce(F.col("__prev.__a"), F.col("__first"))
    after = F.col("__prev.n")
    use_after = F.coalesce(after["x"] - F.col("__at") < F.col("__at") - here["x"], F.lit(False))
    return (
        near.withColumn("__best", F.when(use_after, after).otherwise(here))
        .withColumns({"col": F.col("__best.c"), "anchor_x": F.col("__best.x"), "distance": F.abs(F.col("__at") - F.col("__best.x"))})
        .select(*words.columns, "col", "anchor_x", "distance", "__last")
    )


def assign_interval(words: DataFrame, columns: DataFrame) -> DataFrame:
    """First column whose interval holds the left edge or overlaps the word, else the nearest."""
    arrays = columns.groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct(F.col("col").alias("c"), F.col("x0").alias("a"), F.col("x1").alias("b")))).alias("__cols")
    )
    x0, x1 = F.col("x0"), F.col("x1")
    inside = F.filter("__cols", lambda k: ((k["a"] <= x0) & (x0 <= k["b"])) | ((x0 < k["b"]) & (x1 > k["a"])))
    nearest = F.array_min(F.transform("__cols", lambda k: F.struct(F.abs(x0 - k["a"]).alias("d"), k["c"].alias("c"))))
    chosen = F.coalesce(F.get(inside, F.lit(0))["c"], nearest["c"])
    return words.join(arrays, KEY, "left").withColumn("col", chosen).drop("__cols")


def assign_or_new(words: DataFrame, columns: DataFrame, tol: float) -> DataFrame:
    """Nearest column, or one past the last when none is within ``tol``."""
    return _assign_or_new(words, columns, tol).drop("__last")


def _assign_or_new(words: DataFrame, columns: DataFrame, tol: float) -> DataFrame:
    near = _assign_nearest(words, columns)
    return near.withColumn("col", F.when(F.col("distance") <= tol, F.col("col")).otherwise(F.col("__last") + 1))


def snap_to_anchors(words: DataFrame, columns: DataFrame, confidence: Column, tol: float = 0.02) -> DataFrame:
    """Snap within ``tol``, or half of it when the table confidence is below 0.7."""
    near = assign_nearest(words, columns)
    ok = F.coalesce(F.col("distance") <= F.when(confidence < 0.7, tol * 0.5).otherwise(tol), F.lit(False))
    return near.withColumns(
        {"snapped": ok, "col": F.when(ok, F.col("col")), "snapped_x": F.when(ok, F.col("anchor_x")).otherwise(x_center())}
    ).drop("anchor_x", "distance")


def _spread(sorted_positions: Column, threshold: Column) -> Column:
    """Greedy thinning of sorted positions: keep one when it is farther than the threshold from the last kept."""
    return F.aggregate(
        sorted_positions,
        F.array().cast("array<double>"),
        lambda kept, p: F.when(
            (F.size(kept) == 0) | (F.abs(p - F.element_at(kept, -1)) > threshold), F.array_append(kept, p)
        ).otherwise(kept),
    )


def grid_boundaries(
    words: DataFrame, lines: DataFrame, rectangles: DataFrame, width: float
) -> DataFrame:
    """Column and row boundaries from ruled lines, else rectangles, else text; with confidence.

    lines(doc_id, page, x0, y0, x1, y1, is_horizontal, is_vertical), rectangles(doc_id, page, x0, y0, x1, y1).
    """
    def edges(a: str, b: str) -> Column:
        return F.array((F.col(a) + F.col(b)) / 2, F.col(a), F.col(b))

    def flat(c: Column) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))

    ruled = lines.groupBy(*KEY).agg(
        flat(F.when(F.col("is_vertical"), edges("x0", "x1"))).alias("lx"),
        flat(F.when(F.col("is_horizontal"), edges("y0", "y1"))).alias("ly"),
        long_count(F.col("is_vertical")).alias("nv"), long_count(F.col("is_horizontal")).alias("nh"),
    )
    boxes = rectangles.groupBy(*KEY).agg(flat(F.array("x0", "x1")).alias("rx"), flat(F.array("y0", "y1")).alias("ry"))
    text = words.groupBy(*KEY).agg(
        flat(F.array("x0", "x1")).alias("tx"), flat(F.array("y0", "y1")).alias("ty"),
        F.avg(F.col("y1") - F.col("y0")).alias("th"),
        F.collect_list(F.struct("x0", "y0")).alias("corners"),
    )
    none = F.array().cast("array<double>")
    facts = text.unionByName(ruled, allowMissingColumns=True).unionByName(boxes, allowMissingColumns=True)
    names = [c for c in facts.columns if c not in KEY]
    page = facts.groupBy(*KEY).agg(*[F.first(c, ignorenulls=True).alias(c) for c in names]).where("tx IS NOT NULL").select(
        *KEY, "tx", "ty", "th", "corners",
        *[F.coalesce(c, none).alias(c) for c in ("lx", "ly", "rx", "ry")],
        (F.coalesce("nv", F.lit(0)) + F.coalesce("nh", F.lit(0))).alias("lines"),
    )
    use_boxes = (F.size("lx") == 0) & (F.size("rx") > 0)
    thin = let(
        _spread(F.col("tx"), F.lit(max(20.0, width * 0.02))),
        lambda t: F.concat(
            F.when(t[0] > 50, F.array(F.lit(0.0))).otherwise(none), t,
            F.when(F.element_at(t, -1) < width - 50, F.array(F.lit(width))).otherwise(none),
        ),
    )
    xs = first_rule([(F.size("lx") > 0, F.col("lx")), (use_boxes, F.col("rx"))], thin)
    marked_y = F.array_sort(F.array_distinct(F.concat(F.col("ly"), F.when(use_boxes, F.col("ry")).otherwise(none))))
    thin_y = F.array_sort(_spread(F.reverse("ty"), F.greatest(F.lit(5.0), F.col("th") * 0.3)))
    grid = page.withColumn("columns", xs).withColumn("rows", let(marked_y, lambda m: F.when(F.size(m) > 0, m).otherwise(thin_y)))
    aligned = F.size(
        F.filter(
            "corners",
            lambda c: F.exists("columns", lambda x: F.abs(x - c["x0"]) < 50) & F.exists("rows", lambda y: F.abs(y - c["y0"]) < 20),
        )
    ) / F.size("corners")
    return grid.select(
        *KEY, "columns", "rows",
        (F.least(F.col("lines") / 10.0, F.lit(1.0)) * 0.6 + aligned * 0.4).alias("confidence"),
    )


def _slots(words: DataFrame, grid: DataFrame, bounds: str, edge: str, centre: Column, name: str) -> DataFrame:
    """Number of the boundary nearest to the edge, the first of two equally near; one further when that boundary is at or
    before the edge and the centre is nearer to the next one. Words on pages without boundaries get null.

    The ascending boundaries and the words of a page are merged in position order, so a word meets the boundaries
    before and behind it only. A mark before all others stands for a page's first boundary.
    """
    mark = lambda b, i: F.struct(b.alias("b"), i.alias("i"), F.get(bounds, i + 1).alias("n"))
    first = F.array(F.struct(F.lit(float("-inf")).alias("b"), F.lit(-1).alias("i"), F.get(bounds, F.lit(0)).alias("n")))
    marks = grid.select(*KEY, F.explode(F.concat(first, F.transform(bounds, mark))).alias("__m"))
    merged = words.withColumns({"__at": F.col(edge), "__kind": F.lit(1)}).unionByName(
        marks.select(*KEY, F.col("__m.b").alias("__at"), "__m", F.lit(0).alias("__kind")), allowMissingColumns=True)
    seen = W.partitionBy(*KEY).orderBy("__at", "__kind").rowsBetween(W.unboundedPreceding, 0)
    near = merged.withColumn("__p", F.last("__m", ignorenulls=True).over(seen)).where("__kind = 1")
    here, after = F.col("__p.b"), F.col("__p.n")
    further = (after - F.col("__at") < F.col("__at") - here) | (F.abs(centre - after) < F.abs(centre - here))
    slot = F.col("__p.i") + F.coalesce(further, F.lit(False)).cast("int")
    return near.withColumn(name, F.when(slot >= 0, slot).cast("long")).select(*words.columns, name)


def snap_text_to_grid(words: DataFrame, grid: DataFrame) -> DataFrame:
    """Words into grid cells; a cell equal to its left or upper neighbour is a merged copy and is
    emptied; empty rows and columns vanish. Each word goes to its nearest cell only."""
    lean = words.select(*KEY, "word_id", "text", "x0", "x1", "y0", "y1")
    placed = _slots(_slots(lean, grid, "rows", "y0", y_center(), "r"), grid, "columns", "x0", x_center(), "c").where("r IS NOT NULL AND c IS NOT NULL")
    cells = placed.groupBy(*KEY, "r", "c").agg(ordered_text().alias("value"))
    left, up = W.partitionBy(*KEY, "r").orderBy("c"), W.partitionBy(*KEY, "c").orderBy("r")
    same_left = (F.lag("c").over(left) == F.col("c") - 1) & (F.lag("value").over(left) == F.col("value"))
    same_up = (F.lag("r").over(up) == F.col("r") - 1) & (F.lag("value").over(up) == F.col("value"))
    kept = cells.withColumn("__l", F.coalesce(same_left, F.lit(False))).withColumn(
        "__u", F.coalesce(same_up, F.lit(False))
    ).where(~F.col("__l") & ~F.col("__u"))
    return kept.select(
        *KEY,
        (F.dense_rank().over(W.partitionBy(*KEY).orderBy("r")) - 1).cast("long").alias("row"),
        (F.dense_rank().over(W.partitionBy(*KEY).orderBy("c")) - 1).cast("long").alias("col"), "value",
    )


def repeated_edges(words: DataFrame, share: float = 0.5) -> DataFrame:
    """J19 (document scope): header / footer texts in the outer tenth of the pages, seen at least
    ``share`` x pages times in documents of two pages or more."""
    pages = words.groupBy(*KEY).agg(F.min("y0").alias("lo"), F.max("y1").alias("hi"))
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    edge = (F.col("hi") - F.col("lo")) * 0.1
    zone = F.when(F.col("y0") <= F.col("lo") + edge, "header").when(F.col("y1") >= F.col("hi") - edge, "footer")
    seen = words.join(pages, KEY).withColumn("zone", zone).where(F.col("zone").isNotNull()).groupBy(
        "doc_id", "zone", F.trim("text").alias("text")
    ).agg(F.count(F.lit(1)).alias("times"))
    return seen.join(counts, "doc_id").where((F.col("pages") >= 2) & (F.col("times") >= F.col("pages") * share))


def suppress_repeated_on_page(words: DataFrame, height: float, times: int = 2) -> DataFrame:
    """J19 (page scope): drop words of the outer tenths whose text occurs more than ``times`` there."""
    zone = F.when(F.col("y0") < height * 0.1, "header").when(F.col("y0") > height * 0.9, "footer").otherwise("body")
    w = W.partitionBy(*KEY, "__zone", "__k")
    counted = words.withColumns({"__zone": zone, "__k": F.lower(F.trim("text"))}).withColumn("__n", F.count(F.lit(1)).over(w))
    return counted.where((F.col("__zone") == "body") | (F.col("__n") <= times)).drop("__zone", "__k", "__n")


def two_column_split(words: DataFrame, width: float, height: float) -> DataFrame:
    """Left edge, median and right edge as columns; distinct tops with page edges as rows."""
    pad = min(width * 0.05, 20.0)
    page = words.groupBy(*KEY).agg(F.sort_array(F.collect_list("x0")).alias("xs"), F.collect_set("y0").alias("ys"))
    ys = F.sort_array(
        F.array_distinct(F.concat("ys", F.array(F.greatest(F.array_max("ys"), F.lit(height)), F.least(F.array_min("ys"), F.lit(0.0)))))
    )
    return page.select(
        *KEY,
        F.greatest(F.lit(0.0), F.array_min("xs") - pad).alias("left"),
        F.get("xs", F.floor(F.size("xs") / 2).cast("int")).alias("middle"),
        F.least(F.lit(width), F.array_max("xs") + pad).alias("right"),
        ys.alias("row_bounds"),
    )


def group_numbers(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Number of the group of each item of a bounded, ordered array; ``step(state, item)`` gives state and number."""
    def one(s: Column, item: Column) -> Column:
        state, number = step(s["state"], item)
        return F.struct(state.alias("state"), F.array_append(s["numbers"], number.cast("int")).alias("numbers"))

    return F.aggregate(items, F.struct(start.alias("state"), F.array().cast("array<int>").alias("numbers")), one)["numbers"]


def merge_lines(cells: DataFrame, threshold: float = 0.6, mixed: Column | None = None) -> DataFrame:
    """Within (row, col), the first word and all words closer than 0.6 line heights to it become one cell; of the
    words left over again the first opens a cell, and so on. On pages of ``mixed`` languages the distance is 1.5 as
    large. A word so belongs to the first of all openers that is close enough, in the order of words.
    """
    is_mixed = F.lit(False) if mixed is None else F.coalesce(mixed, F.lit(False))
    return pagefolds.merge_lines(cells.withColumn("__mixed", is_mixed), threshold)


def merge_multiline(cells: DataFrame, gap: float = 5.0) -> DataFrame:
    """Cells of a column joined down the page while the gap to the lower edge of what is joined is at most ``gap``.
    cells(doc_id, page, row, col, value, y0, y1)."""
    grouped = cells.groupBy(*KEY, "col").agg(F.array_sort(F.collect_list(F.struct("row", "value", "y0", "y1"))).alias("cs"))
    edge = lambda bottom, g: F.struct(bottom.alias("bottom"), g.cast("int").alias("g"))

    def step(s: Column, c: Column) -> tuple[Column, Column]:
        joins = F.coalesce(F.abs(c["y0"] - s["bottom"]) <= gap, F.lit(False))
        g = F.when(joins, s["g"]).otherwise(s["g"] + 1)
        return edge(F.when(joins, F.greatest(s["bottom"], c["y1"])).otherwise(c["y1"]), g), g

    numbered = grouped.withColumn("g", group_numbers(F.col("cs"), edge(F.lit(None).cast("double"), F.lit(0)), step))
    each = numbered.select(*KEY, "col", F.explode(F.arrays_zip("cs", "g")).alias("e")).select(*KEY, "col", "e.g", "e.cs.*")
    return each.groupBy(*KEY, "col", "g").agg(
        F.min("row").alias("row"), ordered_text("row", "value").alias("value"), F.min("y0").alias("y0"), F.max("y1").alias("y1")
    ).select(*KEY, "row", "col", "value", "y0", "y1")


def header_row_scores(rows: DataFrame, min_font: float = 10.0) -> DataFrame:
    """Score of each row by position, font, bold share and height; header from 2 points."""
    per_row = rows.groupBy(*KEY, "row").agg(
        F.avg("font_size").alias("font"), F.avg(F.col("bold").cast("double")).alias("bold"),
        F.avg(F.col("y1") - F.col("y0")).alias("h"), F.sum(F.col("y1") - F.col("y0")).alias("hs"), F.count(F.lit(1)).alias("n"),
    )
    page = W.partitionBy(*KEY)
    mean = F.sum("hs").over(page) / F.sum("n").over(page)

    def pts(cond: Column, v: float) -> Column:
        return F.when(cond, v).otherwise(0.0)

    score = (
        pts(F.col("row") < 3, 2.0) + pts(F.col("font") >= min_font, 1.5) + pts(F.col("font") > 12.0, 1.0)
        + F.col("bold") * 2.0 + pts(F.col("h") > F.col("__m") * 1.2, 1.0)
    )
    return per_row.withColumn("__m", mean).select(*KEY, "row", score.alias("score")).withColumn(
        "is_header", F.col("score") >= 2.0
    )


def first_row_header(cells: DataFrame) -> DataFrame:
    """The first row is the header."""
    return cells.withColumn("is_header", F.col("row") == 0)


def spans(rows: DataFrame, most_columns: int | None = None, most_rows: int | None = None) -> DataFrame:
    """Cells more than 1.5 times as wide (tall) as the page average span several columns (rows):
    width over the row's average, height over the page's, rounded; limits only if given."""
    page, row = W.partitionBy(*KEY), W.partitionBy(*KEY, "row")
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    measured = rows.withColumns(
        {"__w": width, "__h": height, "__pw": F.avg(width).over(page), "__ph": F.avg(height).over(page)}
    ).withColumn("__rw", F.avg("__w").over(row))

    def span(size: str, mean: str, unit: str, most: int | None) -> Column:
        n = F.greatest(F.lit(1), F.bround(F.col(size) / F.col(unit)).cast("int"))
        n = n if most is None else F.least(F.lit(most), n)
        return F.when(F.col(size) > F.col(mean) * 1.5, n).otherwise(1).cast("long")

    return measured.withColumns(
        {"colspan": span("__w", "__pw", "__rw", most_columns), "rowspan": span("__h", "__ph", "__ph", most_rows)}
    ).drop("__w", "__h", "__pw", "__ph", "__rw")


def match_cells_to_blocks(cells: DataFrame, blocks: DataFrame, floor: float = 0.7) -> DataFrame:
    """Cells without a box take the box of the most similar block of the page (above ``floor``; of equally similar
    ones the first): equal 1, one contained in the other 0.8, else shared words over all words. Cells and blocks that are dealt
    alike meet in one pass over their pages, without a join."""
    need = F.col("x0").isNull() & (F.trim("value") != "")
    known = blocks.where(F.col("word_id").isNotNull()).select(*KEY, "x0", "y0", "x1", "y1", bare("text").alias("__t"), F.col("word_id").cast("long").alias("__o"))
    looking = cells.withColumns({"__t": F.when(need, bare("value")), "__o": F.lit(None).cast("long")})
    return match_blocks(looking.unionByName(known, allowMissingColumns=True), cells.schema, floor)


def block_tree_cells(blocks: DataFrame) -> DataFrame:
    """TABLE -> CELL -> WORD id lists resolved into cells with text in id order.

    blocks(doc_id, id, block_type, row_index, column_index, text, children).
    """
    kind = F.col("block_type")
    tables = blocks.where(kind == "TABLE").select("doc_id", F.col("id").alias("table_id"), F.explode("children").alias("id"))
    cells = blocks.where(kind == "CELL").select("doc_id", "id", "row_index", "column_index", "children")
    words = blocks.where(kind == "WORD").select("doc_id", F.col("id").alias("word"), "text")
    inside = tables.join(cells, ["doc_id", "id"]).select(
        "doc_id", "table_id", (F.coalesce("row_index", F.lit(1)) - 1).alias("row"),
        (F.coalesce("column_index", F.lit(1)) - 1).alias("col"), F.posexplode_outer("children").alias("pos", "word"),
    )
    return (
        inside.join(words, ["doc_id", "word"], "left")
        .groupBy("doc_id", "table_id", "row", "col")
        .agg(F.trim(ordered_text("pos")).alias("value"))
    )


def left_right_alignment(words: DataFrame) -> DataFrame:
    """Labels on the left and values on the right; at least three rounded rows of two words."""
    rows = words.withColumn("__row", rounded_y(50)).groupBy(*KEY, "__row").agg(
        F.count(F.lit(1)).alias("n"), long_count(F.col("x0") < 0.3).alias("l"), long_count(x_center() > 0.7).alias("r")
    )
    page = rows.groupBy(*KEY).agg(
        F.sum("n").alias("blocks"), F.sum("l").alias("left_blocks"), F.sum("r").alias("right_blocks"),
        long_count(F.col("n") >= 2).alias("aligned_rows"),
    )
    return page.withColumns({"label_value": _label_value(), "row_grid": _row_grid("aligned_rows")})


def _label_value() -> Column:
    return (F.col("blocks") >= 4) & (F.col("left_blocks") >= 2) & (F.col("right_blocks") >= 2)


def _row_grid(rows: str) -> Column:
    return (F.col("blocks") >= 6) & (F.col(rows) >= 3)


def numeric_blocks() -> Column:
    """How many numeric blocks a word is: a long number with blanks, or a short one with four to nine digits."""
    short_id = matches("text", r"\p{Nd}").between(4, 9) & (F.length("text") <= 20)
    return long_number_with_spaces("text").cast("int") + short_id.cast("int")


def measured_facts(words: DataFrame) -> DataFrame:
    """J14, J33 and J34 from one pass over the words."""
    facts = page_facts(words.withColumn("numeric", F.coalesce(numeric_blocks(), F.lit(0))))
    return facts.withColumns({"label_value": _label_value(), "row_grid": _row_grid("grid_rows"), "is_candidate": _is_candidate()})


def table_candidate_facts(words: DataFrame) -> DataFrame:
    """J34, first part: per page blocks, rows with separated words, and numeric blocks in rows of two or more."""
    rows = words.withColumn("__row", rounded_y(50)).groupBy(*KEY, "__row").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(x_center())).alias("xs"), F.sum(numeric_blocks()).alias("num")
    )
    gaps = F.zip_with(F.slice("xs", F.lit(2), F.greatest(F.size("xs") - 1, F.lit(0))), "xs", lambda b, a: b - a)
    wide = (F.col("n") >= 2) & (F.size("xs") >= 2) & F.exists(gaps, lambda g: F.coalesce(g >= 0.05, F.lit(False)))
    return rows.withColumn("__wide", wide).groupBy(*KEY).agg(
        F.sum("n").alias("blocks"), long_count(F.col("__wide")).alias("aligned_rows"),
        F.sum(F.when(F.col("n") >= 2, F.col("num")).otherwise(0)).cast("long").alias("numeric_blocks"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("__wide"), F.col("xs")))))).cast("long").alias("positions"),
        F.sum(F.when(F.col("__wide"), F.size("xs")).otherwise(0)).cast("long").alias("position_count"),
    )


def visual_table_candidate(facts: DataFrame, bands: DataFrame) -> DataFrame:
    """At least 30 blocks, 3 aligned rows, 10 positions, 2 bands in two rows each, 2 numeric blocks.
    bands(doc_id, page, row_support) are leader clusters of the aligned rows (tolerance 0.08)."""
    repeated = bands.groupBy(*KEY).agg(long_count(F.col("row_support") >= 2).alias("vertical_bands"))
    f = facts.join(repeated, KEY, "left").withColumn("vertical_bands", F.coalesce("vertical_bands", F.lit(0)).cast("long"))
    return f.withColumn("is_candidate", _is_candidate())


def _is_candidate() -> Column:
    return (
        (F.col("blocks") >= 30) & (F.col("aligned_rows") >= 3) & (F.col("position_count") >= 10)
        & (F.col("vertical_bands") >= 2) & (F.col("numeric_blocks") >= 2)
    )


CANDIDATE = [*KEY, "blocks", "aligned_rows", "numeric_blocks", "positions", "position_count", "vertical_bands", "is_candidate"]


def key_value_halves(rows: DataFrame, split: float = 0.5) -> DataFrame:
    """Words left of the middle are the key, the others the value."""
    left = x_center() < split
    both = rows.groupBy(*KEY, "row").agg(
        F.array_sort(F.collect_list(F.when(left, F.struct(x_center().alias("o"), "word_id", "text")))).alias("l"),
        F.array_sort(F.collect_list(F.when(~left, F.struct(x_center().alias("o"), "word_id", "text")))).alias("r"),
    )
    return both.select(
        *KEY, "row", *[F.trim(F.array_join(F.transform(c, lambda p: p["text"]), " ")).alias(n) for c, n in (("l", "key"), ("r", "value"))]
    ).where((F.col("key") != "") | (F.col("value") != ""))


def place_cells(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Row and nearest column of each word, texts of a cell joined from left to right."""
    return assign_nearest(rows, columns).groupBy(*KEY, "row", "col").agg(
        ordered_text(F.struct("x0", "word_id")).alias("value"), F.bool_or(F.col("text").contains(":")).alias("__colon")
    )


def key_value_columns(words: DataFrame, columns: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """One row per text line with as many columns as there are anchors; labels are in column 0 or
    hold a colon. Form fields, when given, come first. fields(doc_id, page, n, name, value); dealt by document
    into as many partitions as the words, they meet the lines without another exchange of these."""
    lines = place_cells(with_row_number(words, rounded_y(100)), columns)
    body = lines.select(*KEY, "row", "col", "value", ((F.col("col") == 0) | F.col("__colon")).alias("is_label"))
    if fields is None:
        return body
    filled = fields.where((F.trim("name") != "") | (F.trim("value") != ""))
    order = W.partitionBy(*KEY).orderBy("n")
    top = filled.withColumn("row", (F.row_number().over(order) - 1).cast("long")).select(
        *KEY, "row",
        F.inline(F.array(
            F.struct(F.lit(0).cast("long").alias("col"), F.trim("name").alias("value"), F.lit(True).alias("is_label")),
            F.struct(F.lit(1).cast("long").alias("col"), F.trim("value").alias("value"), F.lit(False).alias("is_label")),
        )),
    )
    both = top.withColumn("__top", F.lit(True)).unionByName(body.withColumn("__top", F.lit(False)))
    shift = F.coalesce(F.max(F.when(F.col("__top"), F.col("row") + 1)).over(W.partitionBy(*KEY)), F.lit(0))
    return both.withColumn("__shift", shift).withColumn("row", F.col("row") + F.when(F.col("__top"), 0).otherwise(F.col("__shift"))).drop("__top", "__shift")


def label_value_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """J37 for plain text: a 'label: value' line opens a row; other lines continue the last value."""
    lines = docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    label = F.trim(F.regexp_extract("line", r"^([^:]*):", 1))
    w = W.partitionBy("doc_id").orderBy("line_no")
    first = F.row_number().over(w) == 1
    opened = lines.withColumn("__label", label).withColumn("__open", ((F.col("__label") != "") | first).cast("int"))
    rows = opened.withColumn("row", (F.sum("__open").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("long"))
    part = F.when(F.col("__label") != "", F.trim(F.substr("line", F.instr("line", ":") + 1))).otherwise(F.trim("line"))
    value = F.when((F.col("__open") == 1) & (F.col("__label") == ""), F.lit("")).otherwise(part)
    name = F.when(F.col("__open") == 1, F.coalesce(F.nullif("__label", F.lit("")), F.trim("line")))
    return rows.withColumns({"__v": value, "__n": name}).groupBy("doc_id", "row").agg(
        F.max("__n").alias("label"), F.trim(ordered_text("line_no", F.col("__v"))).alias("value")
    )


def body_rows_for_soft_mode(words: DataFrame) -> DataFrame:
    """J38 test: rows under the top one that hold two words or more."""
    numbered = with_row_number(words, rounded_y(50))
    rows = numbered.groupBy(*KEY, "row").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("rows"), long_count((F.col("row") > 0) & (F.col("n") >= 2)).alias("body_rows")
    )


def soft_table(header: DataFrame, body: DataFrame, anchors: DataFrame) -> DataFrame:
    """Header words by nearest anchor; body words too, but a long number takes the first free column
    of its row. Pages with fewer than two anchors give nothing here (see ``index_content``)."""
    arrays = _anchor_arrays(anchors, "x").where(F.size("__anchors") >= 2)
    head = header.withColumn("row", F.lit(0).cast("long")).withColumn("__free", F.lit(False))
    rest = with_row_number(body, rounded_y(50)).withColumn("row", F.col("row") + 1).withColumn(
        "__free", long_number_with_spaces("text")
    )
    names = [*KEY, "row", "x0", "x1", "word_id", "text", "__free"]
    nearest = F.array_min(
        F.transform("__anchors", lambda a, i: F.struct(F.abs(a["x"] - x_center()).alias("d"), i.alias("i")))
    )["i"]
    block = F.struct("x0", "word_id", "text", F.col("__free").alias("free"), nearest.alias("near"))
    both = head.select(*names).unionByName(rest.select(*names)).unionByName(arrays, allowMissingColumns=True)
    page = W.partitionBy(*KEY).orderBy(F.col("word_id").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    known = both.withColumn("__anchors", F.first("__anchors", ignorenulls=True).over(page)).where("word_id IS NOT NULL AND __anchors IS NOT NULL")
    rows = known.groupBy(*KEY, "row").agg(
        F.array_sort(F.collect_list(block)).alias("__b"), F.first(F.size("__anchors")).alias("__n")
    )

    def put(cells: Column, b: Column) -> Column:
        free = F.array_position(cells, "")
        at = F.when(b["free"], F.when(free > 0, free - 1).otherwise(0)).otherwise(b["near"])
        return F.transform(cells, lambda v, i: F.when(i == at, F.trim(F.concat(v, F.lit(" "), b["text"]))).otherwise(v))

    filled = F.aggregate("__b", F.array_repeat(F.lit(""), F.col("__n")), put)
    return rows.select(*KEY, "row", F.posexplode(filled).alias("col", "value")).withColumn("col", F.col("col").cast("long"))


def visual_grid(placed: DataFrame, far: float = 0.10) -> DataFrame:
    """J39 (visual 0.10, hybrid 0.08): words by row and nearest column, texts of a cell joined from left to right.
    placed(doc_id, page, row, word_id, text, x0, at) has the words with their centres and, without word_id, the columns.

    Blocks farther than ``far`` from every column become columns of their own before anything is placed, so all rows
    share one numbering. Words and columns are swept along the page, so nothing is joined.
    """
    page = W.partitionBy(*KEY)
    to_right, to_left = page.orderBy("at"), page.orderBy(F.desc("at"))
    is_word = F.col("word_id").isNotNull()

    def left(mark: Column) -> Column:
        return F.max(F.when(mark, F.col("at"))).over(to_right.rangeBetween(W.unboundedPreceding, W.currentRow))

    def right(mark: Column) -> Column:
        return F.min(F.when(mark, F.col("at"))).over(to_left.rangeBetween(W.unboundedPreceding, W.currentRow))

    near = placed.withColumn("__l", left(~is_word)).withColumn("__r", right(~is_word))
    distance = F.least(F.col("at") - F.col("__l"), F.col("__r") - F.col("at"))
    marked = near.withColumn("__m", ~is_word | distance.isNull() | (distance > far))
    between = marked.withColumn("__r", right(F.col("__m"))).withColumn("__l", left(F.col("__m")))
    before = F.max(F.when(F.col("__m"), F.col("at"))).over(to_right.rowsBetween(W.unboundedPreceding, -1))
    opens = F.col("__m") & (before.isNull() | (before < F.col("at")))
    known = between.withColumn("__o", opens.cast("int")).withColumn(
        "__n", F.sum("__o").over(to_right.rangeBetween(W.unboundedPreceding, W.currentRow))
    )
    after = F.col("__l").isNull() | F.coalesce(F.col("__r") - F.col("at") < F.col("at") - F.col("__l"), F.lit(False))
    col = F.when(after, F.col("__n")).otherwise(F.col("__n") - 1)
    return known.where(is_word).withColumn("col", col).groupBy(*KEY, "row", "col").agg(ordered_text(F.struct("x0", "word_id")).alias("value"))


def occupancy(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Every position a cell covers, with the number of covering cells and the owner's place."""
    covered = cells.select(
        *keys, F.col("row").alias("owner_row"), F.col("col").alias("owner_col"),
        F.explode(F.sequence("row", F.col("row") + F.greatest(F.lit(1), "rowspan") - 1)).alias("r"), "col", "colspan",
    ).select(
        *keys, "owner_row", "owner_col", "r",
        F.explode(F.sequence("col", F.col("col") + F.greatest(F.lit(1), "colspan") - 1)).alias("c"),
    )
    return covered.groupBy(*keys, "r", "c").agg(
        F.count(F.lit(1)).alias("covers"), F.min("owner_row").alias("owner_row"), F.min("owner_col").alias("owner_col")
    )


def covered_area(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows, cols, covered, conflicts) of each table without listing positions, by a sweep.

    The row edges of all cells of a table cut it into strips. A cell adds to the strips it reaches, and in each it is two
    events, one at its first column and one behind its last; the running sum of events is how many cells cover the
    columns from one event to the next. A span of any size is cut at the edges of other cells only.
    """
    spans = cells.select(
        *keys, "row", "col", (F.col("row") + F.greatest(F.lit(1), "rowspan")).alias("bottom"), (F.col("col") + F.greatest(F.lit(1), "colspan")).alias("right")
    )
    table = W.partitionBy(*keys)
    edges = F.array_sort(F.array_union(F.collect_set("row").over(table), F.collect_set("bottom").over(table)))
    cut = spans.withColumns({"edges": edges, "rows": F.max("bottom").over(table), "cols": F.max("right").over(table)})
    reach = F.sequence(F.array_position("edges", F.col("row")), F.array_position("edges", F.col("bottom")) - 1)
    strips = cut.select(*keys, "rows", "cols", "col", "right", "edges", F.explode(reach).alias("strip")).select(
        *keys, "rows", "cols", "strip", (F.get("edges", F.col("strip").cast("int")) - F.get("edges", (F.col("strip") - 1).cast("int"))).alias("height"),
        F.explode(F.array(F.struct(F.col("col").alias("x"), F.lit(1).alias("d")), F.struct(F.col("right").alias("x"), F.lit(-1).alias("d")))).alias("e"),
    )
    events = strips.groupBy(*keys, "rows", "cols", "strip", "height", "e.x").agg(F.sum("e.d").alias("d"))
    along = W.partitionBy(*keys, "strip").orderBy("x")
    swept = events.withColumns({"covers": F.sum("d").over(along.rowsBetween(W.unboundedPreceding, 0)), "width": F.lead("x").over(along) - F.col("x")})
    area = F.col("height") * F.col("width")
    return swept.groupBy(*keys, "rows", "cols").agg(
        F.coalesce(F.sum(F.when(F.col("covers") > 0, area)), F.lit(0)).cast("long").alias("covered"),
        F.coalesce(F.sum(F.when(F.col("covers") > 1, area)), F.lit(0)).cast("long").alias("conflicts"),
    )


def span_conflicts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Tables with a position covered twice."""
    area = covered_area(cells, keys)
    return area.select(*keys, F.col("covered").alias("positions"), "conflicts", (F.col("conflicts") > 0).alias("span_conflict"))


def grid_integrity(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Every position of the bounding grid is covered exactly once. Counting suffices: a grid of R x C
    with R x C distinct covered positions and no double cover has no hole, so no position list is built."""
    return covered_area(cells, keys).withColumn(
        "is_valid", (F.col("covered") == F.col("rows") * F.col("cols")) & (F.col("conflicts") == 0)
    )


def locked_columns(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Header rows are row 0 and following rows (of the first three) while half the cells are bold;
    a column's anchor is the left edge of its first header cell, else 0.1 per column."""
    rows = cells.where(F.col("row") < 3).groupBy(*keys, "row").agg(F.avg(F.col("bold").cast("double")).alias("b"))
    ok = ((F.col("row") == 0) | (F.col("b") >= 0.5)).cast("int")
    w = W.partitionBy(*keys).orderBy("row")
    unbroken = (F.min(ok).over(w.rowsBetween(W.unboundedPreceding, 0)) == 1) & (F.col("row") == F.row_number().over(w) - 1)
    heads = rows.withColumn("__h", unbroken).where("__h").select(*keys, "row")
    anchors = cells.join(heads, [*keys, "row"]).where(F.col("x0").isNotNull()).groupBy(*keys, "col").agg(F.min_by("x0", "row").alias("x"))
    size = cells.groupBy(*keys).agg(F.max(F.col("col") + F.greatest(F.lit(1), "colspan") - 1).alias("__max"))
    spine = size.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__max").cast("long"))).alias("col"))
    return spine.join(anchors, [*keys, "col"], "left").withColumn("x", F.coalesce("x", F.col("col") * 0.1))


def plain_text_rows(docs: DataFrame, text: str = "text", max_lines: int | None = None) -> DataFrame:
    """Non-empty lines as rows of one column; the optional limit is the reader's display limit."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda v: F.trim(v)), lambda v: v != "")
    kept = lines if max_lines is None else F.slice(lines, 1, max_lines)
    return docs.select("doc_id", F.posexplode(kept).alias("row", "value")).withColumn("row", F.col("row").cast("long"))


def index_content(docs: DataFrame, text: str = "text") -> DataFrame:
    """J43 / J38 fallback: index and content columns."""
    return plain_text_rows(docs, text).select("doc_id", "row", (F.col("row") + 1).cast("string").alias("index"), F.col("value").alias("content"))


SEPARATORS = [":", " - ", " – ", " — ", "\t"]


def resume_rows(lines: DataFrame) -> DataFrame:
    """Key and value by the first separator that gives a short key; other lines are headings or text.
    lines(doc_id, row, value)."""
    v = F.col("value")

    def split_at(sep: str) -> Column:
        at = F.instr(v, sep)
        key, rest = F.trim(F.substr(v, F.lit(1), at - 1)), F.trim(F.substr(v, at + len(sep)))
        ok = (at > 0) & (key != "") & (F.length(key) < 50) & ((rest != "") | (F.length(key) < 20))
        return F.when(ok, F.struct(key.alias("key"), rest.alias("rest")))

    found = F.coalesce(*[split_at(s) for s in SEPARATORS])
    first = F.substring(v, 1, 1)
    upper_first = (F.upper(first) == first) & (F.lower(first) != first)
    all_caps = (F.upper(v) == v) & (F.lower(v) != v)
    heading = ((F.length(v) < 50) & all_caps) | (upper_first & ~F.substring(v, 1, 10).contains(" "))
    return lines.withColumn("__f", found).select(
        "doc_id", "row", F.coalesce(F.col("__f.key"), v).alias("key"), F.col("__f.rest").alias("value"),
        (F.col("__f").isNull() & heading).alias("is_heading"),
    )


def certificate_rows(lines: DataFrame) -> DataFrame:
    """Split at the first colon or long dash, else one centred line."""
    at = F.regexp_instr("value", F.lit("[:—–]"))
    v = F.col("value")
    return lines.select(
        "doc_id", "row",
        F.when(at > 0, F.trim(F.substr(v, F.lit(1), at - 1))).otherwise(v).alias("key"),
        F.when(at > 0, F.trim(F.substr(v, at + 1))).alias("value"), (at == 0).alias("centred"),
    )


def statement_rows(rows: DataFrame) -> DataFrame:
    """Words of a row from left to right, split further at '|' and tabs, with their spans."""
    parts = F.filter(F.transform(F.split("text", r"[|\t]"), lambda p: F.trim(p)), lambda p: p != "")
    pieces = spans(rows).select(*KEY, "row", "x0", "word_id", "colspan", "rowspan", F.posexplode(parts).alias("__i", "value"))
    w = W.partitionBy(*KEY, "row").orderBy("x0", "word_id", "__i")
    return pieces.select(
        *KEY, "row", (F.row_number().over(w) - 1).cast("long").alias("col"), "value", "colspan", "rowspan",
        ((F.col("colspan") > 1) | (F.col("rowspan") > 1)).alias("merged"),
    )


def generic_rows(rows: DataFrame, columns: DataFrame, tol: float = 0.02) -> DataFrame:
    """Global column per word; a second word for a taken column goes behind the last column."""
    w = W.partitionBy(*KEY, "row", "col").orderBy("x0", "word_id")
    placed = _assign_or_new(rows, columns, tol).where("__last IS NOT NULL").withColumn("__n", F.row_number().over(w))
    return placed.select(
        *KEY, "row", "word_id", F.when(F.col("__n") == 1, F.col("col")).otherwise(F.col("__last") + 1).alias("col"), F.col("text").alias("value")
    )


def aligned_table(words: DataFrame, row_step: float = 3.0, gap: float = 50.0, snap: float = 30.0, drop_unmatched: bool = False) -> DataFrame:
    """Rows by y to the nearest ``row_step``, columns by gaps of ``gap``; words farther than ``snap``
    from every column go to column 0 (or away with ``drop_unmatched``)."""
    x = F.floor(F.col("x0") + 0.5).cast("double")
    rounded = words.where(F.trim("text") != "").withColumn("__x", x).withColumn("__y", F.floor(F.col("y0") / row_step + 0.5) * row_step)
    spots = rounded.select(*KEY, F.col("__x").alias("x")).distinct()
    cols = islands(spots, F.col("x"), gap, "col", strict=True).groupBy(*KEY, "col").agg(F.floor(F.avg("x") + 0.5).cast("double").alias("x"))
    numbered = with_row_number(rounded, F.col("__y"))
    tall = numbered.withColumn("__rows", F.max("row").over(W.partitionBy(*KEY))).where(F.col("__rows") >= 1)
    near = assign_nearest(tall, cols, F.col("__x"))
    fits = F.col("distance") < snap
    kept = near.where(fits) if drop_unmatched else near
    placed = kept.withColumn("col", F.when(fits, F.col("col")).otherwise(0).cast("long"))
    return placed.groupBy(*KEY, "row", "col").agg(ordered_text(F.struct("__x", "word_id"), F.trim("text")).alias("value"))

