"""Cleaning of cell tables (survey group K).

Input ``cells``: doc_id, page, row, col, value and where needed font_size, bold, merged; one sheet is one
(doc_id, page), a bounded group. Row rules work on ``rows``: one record per row with its cells as an array
ordered by column, so they are plain expressions; sheet rules are windows on the sheet.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillmeter.functions.exprs import any_contains, col, first_rule, let, long_count
from quillmeter.operators.layout import KEY, ordered_text
from quillmeter.operators.pagefolds import SPACES, Page, by_page

# Words that mark labels, headers and currencies.
FORM_LABEL_WORDS = ["number", "name", "date", "amount", "id", "url", "status", "channel"]
PAIR_LABEL_WORDS = ["name", "id", "number", "date", "amount", "status", "channel", "mode", "fee", "ref", "approval",
                    "biller", "customer", "payment", "agent", "transaction", "consumer", "mobile"]
PAIR_NEXT_WORDS = ["date", "amount", "total", "transaction", "account", "address", "email", "phone", "id", "number",
                   "receipt", "invoice", "bill", "agent", "merchant", "customer", "consumer"]
PAIR_LABEL_PATTERNS = [r"payment\s+mode", r"payment\s+status", r"payment\s+channel", r"approval\s+ref", r"digital\s+fee",
                       "convenience fee", "platform fee", "receipt no", "invoice no"]
PAIR_HINDI_WORDS = ["नाम", "पिता", "पति", "आधार", "जाती", "कार्ड", "प्रकार", "समग्र", "परिवार", "क्र"]
BILL_LABEL_WORDS = ["name", "date", "number", "id", "amount", "fee", "status", "channel", "mode"]
BILL_LABEL_NAMES = ["website url", "approval ref no"]
HEADER_WORDS = ["name", "date", "amount", "total", "item", "description", "qty", "quantity", "price", "rate", "sum", "subtotal"]
LINE_LABEL_WORDS = ["name", "id", "number", "date", "amount", "biller", "customer", "payment", "mobile", "consumer",
                    "spice", "money", "assured", "bill"]
CURRENCIES = ["₹", "$", "€", "£", "¥", "Rs.", "INR", "USD"]
KEY_SEPARATORS = [":", "|", "\t", " - ", " – ", " — "]
KEY_LABELS = ["Name of the customer", "Biller Name", "Biller ID", "B-Connect Txn ID", "Approval Ref No",
              "Consumer Number/IVRS", "Mobile Number", "Payment Mode", "Payment Status", "Payment Channel", "Bill Date",
              "Bill Amount", "Name", "ID", "Number", "Date", "Amount", "Total", "Status", "Transaction", "Payment",
              "Approval", "Ref", "Consumer", "Mobile"]
TEMPLATE_FIELDS = ["Name", "ID Number", "Date of Birth", "Address", "Photo"]

# Patterns that make a value splittable.
VALUE_PATTERNS = [r"\d{4,}", r"\d{2}-\d{2}-\d{4}", r"\d{2}:\d{2}", r"'[^']*'", r"[A-Z]{2}\d{2}[A-Z]{2}\d{4}", r"\d+\.\d+"]
TOKEN_TYPES = [("date", r"^\d{2}-\d{2}-\d{4}$"), ("time", r"^\d{2}:\d{2}$"), ("number", r"^\d+$"), ("decimal", r"^\d+\.\d+$"),
               ("quoted", r"^'[^']*'"), ("vehicle", r"^[A-Z]{2}\d{2}[A-Z]{2}\d{4}$"), ("mixed", r"^\d")]


BULLET = re.compile(r"[•\-*·]|[1-5]\.")


def strip(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def filled(c: str | Column = "value") -> Column:
    return F.coalesce(strip(c) != "", F.lit(False))


def rows_of(cells: DataFrame) -> DataFrame:
    """One record per row: ``vals`` holds struct(c, v) in column order."""
    return cells.groupBy(*KEY, "row").agg(
        F.array_sort(F.collect_list(F.struct(F.col("col").alias("c"), F.coalesce("value", F.lit("")).alias("v")))).alias("vals")
    )


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.select(*KEY, "row", F.inline("vals").alias("col", "value"))


def renumber(rows: DataFrame, *order: str) -> DataFrame:
    """Rows numbered from zero by the given order."""
    w = W.partitionBy(*KEY).orderBy(*order)
    numbered = rows.withColumn("__r", (F.row_number().over(w) - 1).cast("long"))
    return numbered.drop("row", *[o for o in order if o != "row"]).withColumnRenamed("__r", "row")


def _set(vals: Column, at: Column, value: Column) -> Column:
    return F.transform(vals, lambda x: F.struct(x["c"].alias("c"), F.when(x["c"] == at, value).otherwise(x["v"]).alias("v")))


def _only(vals: Column, at: Column, value: Column) -> Column:
    return F.transform(vals, lambda x: F.struct(x["c"].alias("c"), F.when(x["c"] == at, value).otherwise("").alias("v")))


def _texts(vals: str | Column = "vals") -> Column:
    """Non-empty texts of a row, trimmed, in column order."""
    return F.filter(F.transform(vals, lambda x: strip(x["v"])), lambda v: v != "")


def drop_empty_rows(cells: DataFrame) -> DataFrame:
    """Rows without text vanish; the others are renumbered."""
    has = F.bool_or(filled()).over(W.partitionBy(*KEY, "row"))
    kept = cells.withColumn("__h", has).where("__h").drop("__h")
    return kept.withColumn("row", (F.dense_rank().over(W.partitionBy(*KEY).orderBy("row")) - 1).cast("long"))


def drop_sparse_columns(cells: DataFrame, least: int = 2) -> DataFrame:
    """Columns with fewer than ``least`` filled cells vanish; if all would, those with any text stay."""
    n = F.count_if(filled()).over(W.partitionBy(*KEY, "col"))
    best = F.max("__n").over(W.partitionBy(*KEY))
    counted = cells.withColumn("__n", n).withColumn("__best", best)
    kept = counted.where((F.col("__best") == 0) | (F.col("__n") >= F.least(F.lit(least), F.col("__best"))))
    rank = (F.dense_rank().over(W.partitionBy(*KEY).orderBy("col")) - 1).cast("long")
    return kept.withColumn("col", F.when(F.col("__best") == 0, F.col("col")).otherwise(rank)).drop("__n", "__best")


def drop_repeated_rows(cells: DataFrame) -> DataFrame:
    """K3: empty rows and rows equal to the row before them vanish."""
    rows = rows_of(cells).where(F.size(_texts()) > 0).withColumn("__t", F.transform("vals", lambda x: strip(x["v"])))
    before = F.lag("__t").over(W.partitionBy(*KEY).orderBy("row"))
    kept = rows.withColumn("__b", before).where(F.col("__b").isNull() | (F.col("__t") != F.col("__b"))).drop("__t", "__b")
    return cells_of(renumber(kept, "row"))


def _explode_parts(rows: DataFrame, at: Column, parts: Column) -> DataFrame:
    """Rows with ``parts`` become one row per part, alone in column ``at``; the others stay."""
    out = rows.withColumns({"__at": at, "__p": parts}).select(
        *KEY, "row", "vals", "__at", F.posexplode(F.coalesce("__p", F.array(F.lit(None).cast("string")))).alias("__i", "__v")
    )
    vals = F.when(F.col("__v").isNull(), F.col("vals")).otherwise(_only(F.col("vals"), F.col("__at"), F.col("__v")))
    return renumber(out.withColumn("vals", vals).drop("__at", "__v"), "row", "__i")


def _periods(v: Column) -> Column:
    return F.length(v) - F.length(F.replace(v, F.lit("."), F.lit("")))


def _clean_parts(v: Column, sep: str) -> Column:
    return F.filter(F.transform(F.split(v, sep), lambda p: strip(p)), lambda p: p != "")


def split_collapsed_rows(rows: DataFrame) -> DataFrame:
    """K4: a row with a line break, more than two periods or a double blank is split at the lines, else the
    sentences, of its longest cell."""
    needs = F.exists("vals", lambda x: (_periods(x["v"]) > 2) | x["v"].contains("\n") | x["v"].contains("  "))
    longest = F.array_max(F.transform("vals", lambda x: F.struct(F.length(x["v"]).alias("n"), (-x["c"]).alias("o"), x["v"].alias("v"))))

    def parts(v: Column) -> Column:
        lines = _clean_parts(v, "\n")
        sentences = F.transform(_clean_parts(v, r"\."), lambda s: F.concat(s, F.lit(".")))
        return first_rule(
            [(v.contains("\n") & (F.size(lines) > 0), lines), ((_periods(v) > 2) & ~v.contains("\n") & (F.size(sentences) > 1), sentences)]
        )

    return _explode_parts(rows, -longest["o"], F.when(needs, let(longest["v"], parts)))


def split_label_value(rows: DataFrame) -> DataFrame:
    """K5: the first 'label: value' cell keeps the label; the value goes into the next column."""
    def two(v: Column) -> Column:
        p = F.split(v, ":")
        return (F.size(p) == 2) & (strip(p[0]) != "") & (strip(F.get(p, F.lit(1))) != "")

    hit = F.get(F.filter("vals", lambda x: two(x["v"])), F.lit(0))

    def fixed(h: Column) -> Column:
        label, value = strip(F.split(h["v"], ":")[0]), strip(F.get(F.split(h["v"], ":"), F.lit(1)))
        nxt = h["c"] + 1
        base = _set(_set(F.col("vals"), h["c"], label), nxt, value)
        has = F.exists("vals", lambda x: x["c"] == nxt)
        return F.when(has, base).otherwise(F.array_append(base, F.struct(nxt.alias("c"), value.alias("v"))))

    return rows.withColumn("vals", F.when(hit.isNotNull(), let(hit, fixed)).otherwise(F.col("vals")))


def split_delimited_rows(rows: DataFrame) -> DataFrame:
    """K6: a cell with several parts between '|' (else ';') gives one row per part."""
    mark = F.get(F.filter("vals", lambda x: x["v"].contains("|") | x["v"].contains(";")), F.lit(0))

    def parts(v: Column) -> Column:
        p = F.when(v.contains("|"), _clean_parts(v, r"\|")).otherwise(_clean_parts(v, ";"))
        return let(p, lambda q: F.when(F.size(q) > 1, q))

    return _explode_parts(rows, mark["c"], F.when(mark.isNotNull(), let(mark["v"], parts)))


def single_column_layout(rows: DataFrame) -> DataFrame:
    """K7: at least 70 % of the rows have their only text in the first column."""
    n = F.size(_texts())
    first = strip(F.get("vals", F.lit(0))["v"]) != ""
    return rows.groupBy(*KEY).agg(
        long_count((n == 1) & first & (F.get("vals", F.lit(0))["c"] == 0)).alias("single_rows"), long_count(n > 1).alias("multi_rows")
    ).withColumn(
        "is_single_column",
        F.coalesce(F.col("single_rows") / F.nullif(F.col("single_rows") + F.col("multi_rows"), F.lit(0)) >= 0.7, F.lit(False)),
    )


def _pair_up(rows: DataFrame, joins: Column) -> DataFrame:
    """Rows that are swallowed by the row before them. ``joins``: the row may follow its predecessor as value.

    A swallowed row cannot swallow the next one, so in a run of joining rows every second one is swallowed,
    starting with the first: a run position instead of a step-by-step walk.
    """
    w = W.partitionBy(*KEY).orderBy("row")
    can = F.coalesce(joins & F.lag("row").over(w).isNotNull(), F.lit(False))
    runs = rows.withColumn("__j", can).withColumn("__run", F.sum((~F.col("__j")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    place = F.row_number().over(W.partitionBy(*KEY, "__run").orderBy("row")) - 1
    return runs.withColumn("__swallowed", F.col("__j") & (place % 2 == 1)).withColumn("__next_swallowed", F.lead("__swallowed").over(w)).drop("__j", "__run")


def _words(v: Column) -> Column:
    return F.size(F.filter(F.split(v, r"\s+"), lambda w: w != ""))


def pair_form_rows(rows: DataFrame) -> DataFrame:
    """K8: a label row takes the following row as its value unless that looks like a label itself."""
    texts = rows.withColumn("__t", F.get(_texts(), F.lit(0))).where(F.col("__t").isNotNull())
    t = F.col("__t")
    is_label = t.contains(":") | (_words(t) <= 3) | any_contains(F.lower(t), FORM_LABEL_WORDS)
    w = W.partitionBy(*KEY).orderBy("row")
    paired = _pair_up(texts, ~is_label).withColumn("__n", F.lead("__t").over(w)).where(~F.col("__swallowed"))
    out = paired.select(*KEY, "row", t.alias("label"), F.when(F.col("__next_swallowed"), F.col("__n")).otherwise("").alias("value"))
    return renumber(out, "row").select(*KEY, "row", "label", "value")


def needs_pairing(cells: DataFrame) -> DataFrame:
    """Fewer than 70 % of at least three rows have a cell beyond the first column."""
    rows = cells.groupBy(*KEY, "row").agg(F.bool_or(F.col("col") >= 1).alias("second"))
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"), long_count(F.col("second")).alias("rows_with_second")).withColumn(
        "apply_pairing",
        (F.col("rows") >= 3) & ((F.col("rows_with_second") / F.col("rows") < 0.7) | (1 - F.col("rows_with_second") / F.col("rows") > 0.3)),
    )


def pair_label_rows(rows: DataFrame) -> DataFrame:
    """A lone label in column 0 takes the lone text of the next row as its value unless that is a label."""
    v0 = strip(F.get("vals", F.lit(0))["v"])
    alone = (F.get("vals", F.lit(0))["c"] == 0) & ~F.exists("vals", lambda x: (x["c"] >= 1) & (strip(x["v"]) != ""))
    base = rows.withColumns({"__v": v0, "__alone": alone})
    v, low = F.col("__v"), F.lower("__v")
    caps = (F.upper(v) == v) & (F.lower(v) != v) & (F.length(v) > 1)
    digits = F.replace(v, F.lit(" "), F.lit("")).rlike(r"^\p{Nd}+$")
    label = F.col("__alone") & (
        any_contains(low, PAIR_LABEL_WORDS + PAIR_NEXT_WORDS + PAIR_HINDI_WORDS) | ((F.length(v) < 50) & (v.contains(":") | (v.contains(" ") & ~caps & ~digits)))
    )
    named = any_contains(low, PAIR_NEXT_WORDS + PAIR_HINDI_WORDS) | low.rlike("|".join(PAIR_LABEL_PATTERNS))
    value = F.col("__alone") & ~(named | ((F.length(v) < 30) & v.contains(":")))
    w = W.partitionBy(*KEY).orderBy("row")
    marked = base.withColumns({"__label": label, "__value": value}).withColumn("__pl", F.lag("__label").over(w))
    paired = _pair_up(marked, F.col("__value") & F.coalesce("__pl", F.lit(False))).withColumn("__n", F.lead("__v").over(w)).where(~F.col("__swallowed"))
    joined = F.array(
        F.struct(F.lit(0).cast("long").alias("c"), v.alias("v")), F.struct(F.lit(1).cast("long").alias("c"), F.col("__n").alias("v"))
    )
    out = paired.select(*KEY, "row", F.when(F.coalesce("__next_swallowed", F.lit(False)), joined).otherwise(F.col("vals")).alias("vals"))
    return cells_of(renumber(out, "row"))


#: What a white space is in patterns, and the line ends before which ``$`` matches.
BLANKS, LINE_ENDS = " \t\n\x0b\f\r", ("\x85", "\u2028", "\u2029")
PAIRS = "doc_id long, page long, row long, label string, value string"
Row = tuple[list[int], list[str]]
Pairs = list[tuple[int, str, str]]


def _by_sheet(rows: DataFrame, more: list[str], rule: Callable[[Page], Pairs]) -> DataFrame:
    """``rule`` turns the rows of a sheet, their columns and texts in ``c`` and ``v``, into (row, label, value)."""
    def run(p: Page) -> list[tuple]:
        return [(p["doc_id"][0], p["page"][0], *r) for r in rule(p)]

    return by_page(rows.select(*KEY, "row", "vals.c", "vals.v", *more), PAIRS, ["row"], run)


def _bill_pairs(sheet: list[list[str]], ahead: int) -> Pairs:
    def is_label(t: str) -> bool:
        low = t.lower()
        return (len(t) < 50 and (":" in t or low in BILL_LABEL_NAMES)) or any(w in low for w in BILL_LABEL_WORDS)

    grid = [[str(v).strip() for v in row] for row in sheet]
    out: list[tuple[str, str]] = []
    i = 0
    while i < len(grid):
        row = grid[i]
        texts = [t for t in row if t]
        head, _, tail = texts[0].partition(":") if len(texts) == 1 else ("", "", "")
        if not texts:
            i += 1
        elif head.strip() and tail.strip():
            out.append((head.strip(), tail.strip()))
            i += 1
        elif row[0] and is_label(row[0]) and not (len(row) > 1 and row[1]):
            value, i = "", i + 1
            for j in range(i, min(i + ahead, len(grid))):
                first, second = grid[j][0], grid[j][1] if len(grid[j]) > 1 else ""
                pick = first if ":" not in first and len(first) > 2 else second if first and len(second) > 2 else ""
                if pick:
                    value, i = pick, j + 1
                    break
            out.append((row[0], value))
        else:
            out.append((texts[0], " ".join(texts[1:])))
            i += 1
    return [(n, *pair) for n, pair in enumerate(out)]


def pair_bill_rows(rows: DataFrame, ahead: int = 2) -> DataFrame:
    """K9: 'label: value' cells are split; a label without value looks for it in the next ``ahead`` rows
    (first text without a colon, else second column) and consumes the rows up to it. Of other rows the first text
    is the label and the rest the value."""
    return _by_sheet(rows, [], lambda p: _bill_pairs(p["v"], ahead))


def resume_layout(rows: DataFrame) -> DataFrame:
    """Bullets get rows of their own before their row; a row is first text and the joined rest."""
    texts = _texts()
    bullets = F.filter(texts, lambda v: v.rlike(r"^([•\-*·]|[1-5]\.)"))
    own = F.transform(bullets, lambda b: F.struct(b.alias("label"), F.lit("").alias("value")))
    rest = F.struct(F.get("__t", F.lit(0)).alias("label"), F.array_join(F.slice("__t", F.lit(2), F.greatest(F.size("__t"), F.lit(1))), " ").alias("value"))
    out = rows.withColumn("__t", texts).where(F.size("__t") > 0).select(*KEY, "row", F.posexplode(F.array_append(own, rest)).alias("__i", "p"))
    return renumber(out.select(*KEY, "row", "__i", "p.*"), "row", "__i").select(*KEY, "row", "label", "value")


def certificate_layout(rows: DataFrame) -> DataFrame:
    """The first text is the field; every further text gives a row with it."""
    more = F.slice("__t", F.lit(2), F.greatest(F.size("__t"), F.lit(1)))
    values = F.when(F.size("__t") > 1, more).otherwise(F.array(F.lit("")))
    out = rows.withColumn("__t", _texts()).where(F.size("__t") > 0).select(
        *KEY, "row", F.get("__t", F.lit(0)).alias("label"), F.posexplode(values).alias("__i", "value")
    )
    return renumber(out, "row", "__i").select(*KEY, "row", "label", "value")


def letter_layout(rows: DataFrame) -> DataFrame:
    """Paragraphs between empty rows, joined."""
    w = W.partitionBy(*KEY).orderBy("row")
    t = rows.withColumn("__t", F.array_join(_texts(), " "))
    runs = t.withColumn("__p", F.sum((F.col("__t") == "").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).where(F.col("__t") != "")
    paragraphs = runs.groupBy(*KEY, "__p").agg(ordered_text("row", F.col("__t")).alias("label"), F.min("row").alias("row"))
    return renumber(paragraphs.drop("__p"), "row").select(*KEY, "row", "label", F.lit("").alias("value"))


def generic_fixes(rows: DataFrame) -> DataFrame:
    """Collapsed rows, then labels, then delimiters."""
    return split_delimited_rows(split_label_value(split_collapsed_rows(rows)))


def _as_pairs(rows: DataFrame) -> DataFrame:
    t = rows.withColumn("__t", _texts())
    rest = F.array_join(F.slice("__t", F.lit(2), F.greatest(F.size("__t"), F.lit(1))), " ")
    return t.where(F.size("__t") > 0).select(*KEY, "row", F.get("__t", F.lit(0)).alias("label"), rest.alias("value"))


def _bare(v: str) -> str:
    """``strip`` of one text."""
    return v[:-1].strip(BLANKS) + v[-1] if v.endswith(LINE_ENDS) else v.strip(BLANKS)


def _clean(parts: list[str]) -> list[str]:
    return [b for b in map(_bare, parts) if b]


def _first_and_rest(texts: list[str]) -> tuple[str, str]:
    return texts[0], " ".join(texts[1:])


def _numbered(pairs: Iterable[tuple[str, str]]) -> Pairs:
    return [(n, *pair) for n, pair in enumerate(pairs)]


def _unrepeated(rows: list[Row]) -> Pairs:
    bare = [[_bare(v) for v in vs] for _, vs in rows]
    kept = [t for t in bare if any(t)]
    return _numbered(_first_and_rest([v for v in t if v]) for i, t in enumerate(kept) if not i or t != kept[i - 1])


def _resume(rows: list[Row]) -> Pairs:
    texts = [t for t in (_clean(vs) for _, vs in rows) if t]
    return _numbered(p for t in texts for p in [*((v, "") for v in t if BULLET.match(v)), _first_and_rest(t)])


def _certificate(rows: list[Row]) -> Pairs:
    texts = [t for t in (_clean(vs) for _, vs in rows) if t]
    return _numbered((t[0], v) for t in texts for v in (t[1:] or [""]))


def _letter(rows: list[Row]) -> Pairs:
    lines = [" ".join(_clean(vs)) for _, vs in rows]
    return _numbered((" ".join(part), "") for filled_, part in groupby(lines, key=bool) if filled_)


def _form(rows: list[Row]) -> Pairs:
    texts = [t[0] for t in (_clean(vs) for _, vs in rows) if t]
    out: list[tuple[str, str]] = []
    may = False  # the row before was not swallowed
    for t in texts:
        low = t.lower()
        is_label = ":" in t or sum(1 for w in SPACES.split(t) if w) <= 3 or any(w in low for w in FORM_LABEL_WORDS)
        if may and not is_label:
            out[-1] = (out[-1][0], t)
            may = False
        else:
            out.append((t, ""))
            may = True
    return _numbered(out)


def _alone(cs: list[int], at: int, parts: list[str]) -> list[Row]:
    return [(cs, [part if c == at else "" for c in cs]) for part in parts]


def _generic(rows: list[Row]) -> Pairs:
    """``generic_fixes`` of one sheet."""
    lines: list[Row] = []
    for cs, vs in rows:
        parts: list[str] = []
        at = 0
        if any(v.count(".") > 2 or "\n" in v or "  " in v for v in vs):
            _, at, v = max((len(v), -c, v) for c, v in zip(cs, vs))
            at = -at
            if "\n" in v:
                parts = _clean(v.split("\n"))
            elif v.count(".") > 2:
                sentences = [f"{t}." for t in _clean(v.split("."))]
                parts = sentences if len(sentences) > 1 else []
        lines += _alone(cs, at, parts) if parts else [(cs, vs)]
    done: list[Row] = []
    for cs, vs in lines:
        for c, v in zip(cs, vs):
            label, _, value = v.partition(":")
            if v.count(":") == 1 and _bare(label) and _bare(value):
                vs = [_bare(value) if k == c + 1 else _bare(label) if k == c else old for k, old in zip(cs, vs)]
                if c + 1 not in cs:
                    cs, vs = [*cs, c + 1], [*vs, _bare(value)]
                break
        mark = next(((c, v) for c, v in zip(cs, vs) if "|" in v or ";" in v), None)
        parts = _clean(mark[1].split("|" if "|" in mark[1] else ";")) if mark else []
        done += _alone(cs, mark[0], parts) if mark and len(parts) > 1 else [(cs, vs)]
    texts = ((n, _clean(vs)) for n, (_, vs) in enumerate(done))
    return [(n, *_first_and_rest(t)) for n, t in texts if t]


#: The rule of each type; the others go through the generic fixes.
SHEET_RULES: dict[str, Callable[[list[Row]], Pairs]] = {
    "invoice": _unrepeated, "bank_statement": _unrepeated, "bill_or_receipt": lambda rows: _bill_pairs([vs for _, vs in rows], 2),
    "resume": _resume, "certificate": _certificate, "id_card": _certificate, "letter": _letter, "generic_form": _form,
}


def fixes_by_type(cells: DataFrame, types: DataFrame) -> DataFrame:
    """Each sheet goes through the rules of its type; every row ends as first text and rest. Sheets are read once, whatever the
    number of types. types(doc_id, page, doc_type), or without page if the sheets of a document are of one type; dealt like the cells
    they meet these without an exchange. Sheets without type vanish."""
    of = [c for c in KEY if c in types.columns]
    both = rows_of(cells).unionByName(types.select(*of, "doc_type"), allowMissingColumns=True)
    seen = W.partitionBy(*of).orderBy(F.col("row").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    typed = both.withColumn("doc_type", F.first("doc_type", ignorenulls=True).over(seen)).where("row IS NOT NULL AND doc_type IS NOT NULL")
    return _by_sheet(typed, ["doc_type"], lambda p: SHEET_RULES.get(p["doc_type"][0], _generic)(list(zip(p["c"], p["v"]))))


def should_split(text: str | Column) -> Column:
    """Long text with three typed values, or numbers beside dates or enough words."""
    t = col(text)
    tokens = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    typed = reduce(lambda a, b: a + b, (F.regexp_count(t, F.lit(p)) for p in VALUE_PATTERNS))
    numbers, dates = F.exists(tokens, lambda w: w.rlike(r"^\d")), F.exists(tokens, lambda w: w.rlike(r"^\d{2}-\d{2}-\d{4}"))
    words = F.exists(tokens, lambda w: ~w.rlike(r"^\d"))
    mixed = (F.size(tokens) >= 4) & ((numbers & dates) | (numbers & words & (F.size(tokens) >= 5)))
    return F.coalesce((F.length(strip(t)) >= 30) & ((typed >= 3) | mixed), F.lit(False))


def split_value(text: str | Column, most: int = 10) -> Column:
    """Parts at quoted strings, else where the kind of token changes; the last part takes what exceeds
    ``most``."""
    t = col(text)
    tokens = F.filter(F.split(t, r"\s+"), lambda w: w != "")

    def kind(w: Column) -> Column:
        return first_rule([(w.rlike(p), n) for n, p in TOKEN_TYPES], "text")

    typed = F.transform(tokens, lambda w: F.struct(w.alias("w"), kind(w).alias("k")))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("k"))

    def grow(acc: Column, x: Column) -> Column:
        same = (F.size(acc["parts"]) > 0) & ((acc["k"] == x["k"]) | (acc["k"] == "mixed") | (x["k"] == "mixed"))
        head = F.slice(acc["parts"], F.lit(1), F.greatest(F.size(acc["parts"]) - 1, F.lit(0)))
        joined = F.array_append(head, F.concat(F.element_at(acc["parts"], -1), F.lit(" "), x["w"]))
        return F.struct(F.when(same, joined).otherwise(F.array_append(acc["parts"], x["w"])).alias("parts"), x["k"].alias("k"))

    by_kind = F.aggregate(typed, start, grow, lambda a: a["parts"])
    pieces = F.regexp_extract_all(t, F.lit(r"'[^']*'|'[^']*$|[^']+'?[^']*$|[^']+"), F.lit(0))
    quoted = F.filter(F.transform(pieces, lambda p: strip(p)), lambda p: p != "")
    parts = F.when(t.rlike("'[^']*'"), quoted).otherwise(by_kind)

    def capped(p: Column) -> Column:
        tail = F.array_join(F.slice(p, F.lit(most), F.greatest(F.size(p) - most + 1, F.lit(0))), " ")
        return F.when(F.size(p) > most, F.array_append(F.slice(p, 1, most - 1), tail)).otherwise(p)

    return F.when(should_split(t), let(parts, capped)).otherwise(F.array(t))


def limit_columns(cells: DataFrame, most: int) -> DataFrame:
    """Text beyond the last allowed column joins the last allowed cell."""
    capped = cells.withColumn("__c", F.least("col", F.lit(most - 1)).cast("long"))
    text = ordered_text("col", F.when(filled(), F.col("value")))
    return capped.groupBy(*KEY, "row", F.col("__c").alias("col")).agg(F.trim(text).alias("value"))


def as_number(value: str | Column) -> Column:
    """Numeric value without currency marks, commas and blanks; null when it is none."""
    bare = reduce(lambda c, m: F.replace(c, F.lit(m), F.lit("")), [*CURRENCIES, ",", " "], col(value))
    return bare.try_cast("double")


def semantic_columns(cells: DataFrame, bands: DataFrame | None = None, doc_type: Column | None = None) -> DataFrame:
    """Highest column with header, numeric or aligned text, plus one; not more than the visual bands.
    Invoices with labels left, values right and mostly one or two filled cells per row have two.
    cells carry ``align``; bands(doc_id, page, bands)."""
    v = strip("value")
    text = cells.where(filled())
    header = (F.col("row") < 3) & (F.col("bold") | any_contains(F.lower(v), HEADER_WORDS) | (F.length(v) < 30))
    numeric = any_contains(v, CURRENCIES) | as_number(v).isNotNull()
    signal = header | numeric | F.col("align").isin("left", "right")
    per_row = text.withColumn("__s", F.when(signal, F.col("col"))).groupBy(*KEY, "row").agg(
        F.max("__s").alias("signal"), F.max("col").alias("last"), F.size(F.collect_set("col")).alias("n"),
        F.bool_or(F.col("align") == "left").alias("l"), F.bool_or(F.col("align") == "right").alias("r"),
    )
    page = per_row.groupBy(*KEY).agg(
        F.coalesce(F.max("signal"), F.max("last")).alias("__m"), F.bool_or("l").alias("__l"), F.bool_or("r").alias("__r"),
        (F.count_if(F.col("n") <= 2) / F.count(F.lit(1)) >= 0.7).alias("__two"),
    )
    if bands is not None:
        page = page.join(bands, KEY, "left")
        count = F.least(F.col("__m") + 1, F.when(F.col("bands") > 0, F.col("bands")).otherwise(F.col("__m") + 1))
    else:
        count = F.col("__m") + 1
    bill = F.lit(False) if doc_type is None else doc_type.isin("invoice", "bill", "receipt")
    return page.select(*KEY, F.when(bill & F.col("__l") & F.col("__r") & F.col("__two"), 2).otherwise(count).cast("long").alias("columns"))


def key_value_split(value: str | Column) -> Column:
    """struct(key, value) by the first separator with text on both sides, then by label words."""
    return let(col(value), _key_value)


def _key_value(v: Column) -> Column:
    def pair(key: Column, rest: Column, ok: Column) -> Column:
        return F.when(ok & (rest != ""), F.struct(key.alias("key"), rest.alias("value")))

    def at(sep: str) -> Column:
        return let(F.instr(v, sep), lambda i: let(strip(F.substr(v, F.lit(1), i - 1)), lambda key: pair(
            key, strip(F.substr(v, i + len(sep))), (i > 0) & (key != ""))))

    def after(label: str) -> Column:
        border = "" if " " in label or "/" in label else r"\b"
        pattern = rf"(?is)^(.*?{border}{label}\s+)(.*)$"
        return let(strip(F.regexp_extract(v, pattern, 1)), lambda key: pair(
            key, strip(F.regexp_extract(v, pattern, 2)), F.length(key) < 100))

    whole = F.struct(strip(v).alias("key"), F.lit("").alias("value"))
    return F.coalesce(*[at(s) for s in KEY_SEPARATORS], *[after(x) for x in KEY_LABELS], whole)


def one_font_per_row(cells: DataFrame) -> DataFrame:
    """Rows with several font sizes are split by size, in order of first appearance."""
    seen = F.min("col").over(W.partitionBy(*KEY, "row", "font_size"))
    rank = F.dense_rank().over(W.partitionBy(*KEY).orderBy("row", "__s"))
    return cells.withColumn("__s", seen).withColumn("row", (rank - 1).cast("long")).drop("__s")


def lines_to_rows(cells: DataFrame) -> DataFrame:
    """Every line of a cell becomes a row; a longer line that is no label and starts small is a value
    (column 1)."""
    lines = cells.select(*KEY, "row", "col", F.posexplode(F.split("value", "\n")).alias("i", "line")).withColumn("line", strip("line")).where(F.col("line") != "")
    first = F.substring("line", 1, 1)
    upper = (F.upper(first) == first) & (F.lower(first) != first)
    is_value = ~any_contains(F.lower("line"), LINE_LABEL_WORDS) & (F.length("line") > 10) & ~upper
    placed = lines.select(*KEY, (F.col("row") + F.col("i")).cast("long").alias("row"), is_value.cast("long").alias("col"),
                          F.struct("row", F.col("col").alias("c"), "i").alias("o"), "line")
    return placed.groupBy(*KEY, "row", "col").agg(ordered_text("o", F.col("line")).alias("value"))


def sheet_shape(cells: DataFrame) -> DataFrame:
    """Highest row and column, filled cells, emptiness."""
    return cells.groupBy(*KEY).agg(
        F.max("row").alias("max_row"), F.max("col").alias("max_col"), long_count(filled()).alias("filled")
    ).withColumn("is_empty", F.col("filled") == 0)


def cell_at(cells: DataFrame, row: int, column: int) -> DataFrame:
    """One cell of every sheet."""
    return cells.where((F.col("row") == row) & (F.col("col") == column))


def merge_ranges(cells: DataFrame) -> DataFrame:
    """Runs of equal neighbours: across when longer than five characters, down when longer than three."""
    def runs(line: str, along: str, longer: int, kind: str) -> DataFrame:
        w = W.partitionBy(*KEY, line).orderBy(along)
        same = (F.lag("__v").over(w) == F.col("__v")) & (F.lag(along).over(w) == F.col(along) - 1)
        marked = cells.withColumn("__v", strip("value")).withColumn("__o", (~F.coalesce(same, F.lit(False))).cast("int"))
        grouped = marked.withColumn("__g", F.sum("__o").over(w.rowsBetween(W.unboundedPreceding, 0)))
        return grouped.groupBy(*KEY, line, "__g").agg(
            F.min(along).alias("start"), F.max(along).alias("end"), F.first("__v").alias("value")
        ).where((F.length("value") > longer) & (F.col("end") > F.col("start"))).select(
            *KEY, F.lit(kind).alias("kind"), F.col(line).alias("line"), "start", "end", "value"
        )

    return runs("row", "col", 5, "horizontal").unionByName(runs("col", "row", 3, "vertical"))


def spread_merged_text(ranges: DataFrame) -> DataFrame:
    """The text of a merged range cut into equal pieces over its cells."""
    n = F.col("end") - F.col("start") + 1
    size = F.ceil(F.length("value") / n).cast("int")
    return ranges.select(
        *KEY, "kind", "line", F.explode(F.sequence("start", "end")).alias("at"), "start", "value", size.alias("__s")
    ).select(*KEY, "kind", "line", "at", F.substr("value", ((F.col("at") - F.col("start")) * F.col("__s") + 1).cast("int"), F.col("__s")).alias("value"))


def field_template(rows: DataFrame) -> DataFrame:
    """Field from the first cell, value from the other texts joined; sheets without any get the empty
    card template."""
    field = strip(F.get("vals", F.lit(0))["v"])
    rest = F.array_join(_texts(F.slice("vals", F.lit(2), F.greatest(F.size("vals"), F.lit(1)))), " ")
    pairs = rows.withColumns({"field": field, "value": rest})
    ok = (F.col("field") != "") & (F.col("value") != "")
    found = pairs.where(ok).select(*KEY, "row", "field", "value")
    bare = pairs.groupBy(*KEY).agg(F.bool_or(ok).alias("__any")).where(~F.col("__any"))
    blank = bare.select(*KEY, F.posexplode(F.array(*map(F.lit, TEMPLATE_FIELDS))).alias("row", "field")).select(
        *KEY, F.col("row").cast("long").alias("row"), "field",
        F.when(F.col("field") == "Photo", "(Please add photo manually)").otherwise("").alias("value"),
    )
    return found.unionByName(blank)


def first_rows(cells: DataFrame, n: int = 100) -> DataFrame:
    """Partial export of the first n rows of each sheet."""
    return cells.where(F.col("row") < n)


def join_neighbours(cells: DataFrame) -> DataFrame:
    """K25 (off by default in the chain): adjacent filled cells of a row join two by two."""
    w = W.partitionBy(*KEY, "row").orderBy("col")
    text = cells.withColumn("__f", filled())
    same = F.col("__f") & F.lag("__f").over(w) & (F.lag("col").over(w) == F.col("col") - 1)
    runs = text.withColumn("__g", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    pair = F.floor((F.row_number().over(W.partitionBy(*KEY, "row", "__g").orderBy("col")) - 1) / 2)
    return runs.withColumn("__p", pair).groupBy(*KEY, "row", "__g", "__p").agg(
        F.min("col").alias("col"), F.trim(ordered_text("col", F.col("value"))).alias("value"), F.count(F.lit(1)).alias("colspan")
    ).drop("__g", "__p")


def split_cells(rows: DataFrame, most: int = 10) -> DataFrame:
    """Rows with a splittable value become the parts of all their cells in order; nothing is dropped."""
    split = F.exists("vals", lambda x: should_split(strip(x["v"])))
    parts = F.filter(F.flatten(F.transform("vals", lambda x: split_value(strip(x["v"]), most))), lambda p: p != "")
    spread = F.transform(parts, lambda p, i: F.struct(i.cast("long").alias("c"), p.alias("v")))
    return cells_of(rows.withColumn("vals", F.when(split, spread).otherwise(F.col("vals"))))


def normalise_style(cells: DataFrame, header_rows: int = 1) -> DataFrame:
    """Numbers right, merged cells centred, others left; body cells get the mean body font size."""
    bare = reduce(lambda c, m: F.replace(c, F.lit(m), F.lit("")), [",", "₹", "$"], F.col("value"))
    number = strip(bare).try_cast("double").isNotNull()
    body = F.col("row") >= header_rows
    mean = F.floor(F.avg(F.when(body, F.col("font_size"))).over(W.partitionBy(*KEY)))
    return cells.withColumns(
        {
            "align": first_rule([(F.col("merged"), "center"), (number, "right")], "left"),
            "font_size": F.when(body & mean.isNotNull(), mean.cast("double")).otherwise(F.col("font_size")),
        }
    )


def headers_only(cells: DataFrame) -> DataFrame:
    """Header rows with 'Column n' for empty names; sheets without header get one notice cell."""
    named = F.when(filled(), F.col("value")).otherwise(F.concat(F.lit("Column "), F.col("col") + 1))
    heads = cells.where("is_header").select(*KEY, "row", "col", named.alias("value"))
    bare = cells.groupBy(*KEY).agg(F.bool_or("is_header").alias("__h")).where(~F.col("__h"))
    notice = bare.select(*KEY, F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("col"), F.lit("Template/Incomplete Table").alias("value"))
    return heads.unionByName(notice)


def simple_rowwise(cells: DataFrame) -> DataFrame:
    """Filled cells only, rows renumbered."""
    return drop_empty_rows(cells.where(filled())).select(*KEY, "row", "col", "value")
