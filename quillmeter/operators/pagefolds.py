"""Order-dependent layout steps (survey group J): a running mean or an already made choice decides the next.

Each is a short Python rule over the rows of one page. Spark sorts the rows by page, without an exchange where words
already are hash-partitioned by document, and streams them in Arrow batches of rows (``mapInArrow``); columns are turned
into lists once a batch, and a rule gets slices of them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window as W

KEY = ["doc_id", "page"]
Page = dict[str, list]


def _pages(df: DataFrame, names: list[str], order: list[str], run: Callable[[pa.RecordBatch, list[int]], pa.RecordBatch], schema: StructType | str) -> DataFrame:
    """``run`` gets the whole pages of about one Arrow batch, their rows in ``order``, and where each page begins.

    A page may begin in one batch and end in a later one; its pieces wait until the next page begins. So a task holds one
    batch and one page, however many pages it has and however large they are.
    """
    page = W.partitionBy(*KEY).orderBy(*order)
    numbered = df.select(*names, F.row_number().over(page).alias("__n")).sortWithinPartitions(*KEY, *order)

    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        starts = np.flatnonzero(table.column("__n").to_numpy() == 1).tolist()
        return run(table.select(names).to_batches()[0], [*starts, table.num_rows])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column(batch.schema.get_field_index("__n")).to_numpy(zero_copy_only=False) == 1)
            if starts.size:
                last = int(starts[-1])
                ready = [*waiting, batch.slice(0, last)] if last else waiting
                if ready:
                    yield whole(ready)
                waiting = []
                batch = batch.slice(last)
            if batch.num_rows:
                waiting.append(batch)
        if waiting:
            yield whole(waiting)

    return numbered.mapInArrow(stream, schema)


def _values(column: pa.Array) -> list:
    """The column as a list; numbers without nulls go through numpy, several times faster."""
    plain = pa.types.is_integer(column.type) or pa.types.is_floating(column.type)
    return column.to_numpy(zero_copy_only=False).tolist() if plain and not column.null_count else column.to_pylist()


def by_page(df: DataFrame, schema: str, order: list[str], rule: Callable[[Page], list[tuple]]) -> DataFrame:
    """``rule`` turns the columns of a page, its rows in ``order``, into output rows."""
    target, names = to_arrow_schema(StructType.fromDDL(schema)), df.columns

    def run(batch: pa.RecordBatch, ends: list[int]) -> pa.RecordBatch:
        columns = {n: _values(batch.column(i)) for i, n in enumerate(names)}
        rows: list[tuple] = []
        for low, high in pairwise(ends):
            rows += rule({n: c[low:high] for n, c in columns.items()})
        out = zip(*rows, strict=True) if rows else [[] for _ in target.names]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, target, strict=True)], schema=target)

    return _pages(df, names, order, run, schema)


def _label(words: DataFrame, order: list[str], name: str, reads: list[str], rule: Callable[[Page], list[int]]) -> DataFrame:
    """Add an integer label to the words of each page, taken in ``order``; ``rule`` gets the columns it ``reads``."""
    schema = StructType([*words.schema.fields, StructField(name, LongType())])
    names = words.columns

    def run(batch: pa.RecordBatch, ends: list[int]) -> pa.RecordBatch:
        columns = {n: _values(batch.column(names.index(n))) for n in reads}
        labels: list[int] = []
        for low, high in pairwise(ends):
            labels += rule({n: c[low:high] for n, c in columns.items()})
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.int64())], names=[*names, name])

    return _pages(words, names, order, run, schema)


def rows_by_font(words: DataFrame, font_tol: float = 2.0, y_factor: float = 0.5) -> DataFrame:
    """A word joins the current row when its centre and font are close to the running means."""
    def rule(p: Page) -> list[int]:
        out, row, yc, font = [], -1, 0.0, 0.0
        for a, b, f in zip(p["y0"], p["y1"], p["font_size"]):
            y = (a + b) / 2
            if row >= 0 and abs(y - yc) <= (f + font) / 2 * y_factor and abs(f - font) <= font_tol:
                yc, font = (yc + y) / 2, (font + f) / 2
            else:
                row, yc, font = row + 1, y, f
            out.append(row)
        return out

    return _label(words, ["y0", "word_id"], "row", ["y0", "y1", "font_size"], rule)


def rows_dynamic(words: DataFrame, reach: float = 50.0) -> DataFrame:
    """Tolerance from both line heights, similar fonts, x within reach of the row; the row's y is the
    font-weighted mean of its words."""
    def rule(p: Page) -> list[int]:
        out, row = [], -1
        y_sum = weight = first_font = lo = hi = 0.0
        for y, f, a, b in zip(p["y0"], p["font_size"], p["x0"], p["x1"]):
            tol = min(max((f + first_font) * 0.6 * 0.25, 2.0), 10.0)
            joins = (
                row >= 0 and y - y_sum / weight <= tol
                and abs(first_font - f) / max(first_font, f) < 0.25 and lo - reach <= a <= hi + reach
            )
            if joins:
                y_sum, weight, lo, hi = y_sum + y * f, weight + f, min(lo, a), max(hi, b)
            else:
                row, y_sum, weight, first_font, lo, hi = row + 1, y * f, f, f, a, b
            out.append(row)
        return out

    return _label(words, ["y0", "word_id"], "row", ["y0", "font_size", "x0", "x1"], rule)


def rows_by_overlap(words: DataFrame, threshold: float = 0.7) -> DataFrame:
    """First open row whose extent overlaps the word's by ``threshold`` (intersection over union)."""
    def rule(p: Page) -> list[int]:
        spans: list[list[float]] = []
        out = []
        for a, b in zip(p["y0"], p["y1"]):
            for i, s in enumerate(spans):
                inter = min(b, s[1]) - max(a, s[0])
                if inter > 0 and inter / (max(b, s[1]) - min(a, s[0])) >= threshold:
                    s[0], s[1] = min(a, s[0]), max(b, s[1])
                    out.append(i)
                    break
            else:
                out.append(len(spans))
                spans.append([a, b])
        return out

    return _label(words, ["word_id"], "row", ["y0", "y1"], rule)


def _means(places: list[float], tol: float) -> list[float]:
    """Places, from left to right, join the first cluster whose mean is within ``tol``; the clusters' means at the end."""
    sums: list[list[float]] = []
    for x in places:
        for s in sums:
            if abs(x - s[0] / s[1]) <= tol:
                s[0] += x
                s[1] += 1
                break
        else:
            sums.append([x, 1])
    return [total / n for total, n in sums]


def _leaders(centres: list[float], rows: list[int], tol: float, min_rows: int) -> list[tuple[float, int]]:
    """Columns (place, rows that support it) of one page, from left to right."""
    seen: dict[float, set] = {}
    for x, r in zip(centres, rows):
        seen.setdefault(x, set()).add(r)
    found = []
    for mean in _means(sorted(seen), tol):
        support = len(set().union(*(rs for x, rs in seen.items() if abs(x - mean) <= tol)))
        if support >= min_rows:
            found.append((mean, support))
    return sorted(found)


def leader_columns(rows: DataFrame, tol: float, min_rows: int = 1) -> DataFrame:
    """Distinct centres, left to right, join the first cluster whose mean is within ``tol``; clusters
    near words of at least ``min_rows`` rows are columns. Input words carry ``row``."""
    def rule(p: Page) -> list[tuple]:
        found = _leaders([(a + b) / 2 for a, b in zip(p["x0"], p["x1"])], p["row"], tol, min_rows)
        return [(p["doc_id"][0], p["page"][0], i, x, n) for i, (x, n) in enumerate(found)]

    return by_page(
        rows.select(*KEY, "row", "x0", "x1"), "doc_id long, page long, col long, x double, row_support long", ["x0"], rule
    )


def _count_columns(xs: list[float], tol: float) -> int:
    """``xs``: the centres of one page in ascending order."""
    count, total, n = 0, xs[0], 1
    for x in xs[1:]:
        if abs(x - total / n) <= tol:
            total, n = total + x, n + 1
        else:
            count, total, n = count + (n >= 2), x, 1
    return 1 if len(xs) < 3 else count + (n >= 2)


def column_count(words: DataFrame, tol: float = 0.02) -> DataFrame:
    """Clusters around a running mean with two words or more; one when there are too few words."""
    def rule(p: Page) -> list[tuple]:
        xs = sorted((a + b) / 2 for a, b in zip(p["x0"], p["x1"]))
        return [(p["doc_id"][0], p["page"][0], _count_columns(xs, tol))]

    return by_page(words.select(*KEY, "x0", "x1"), "doc_id long, page long, columns long", ["x0"], rule)


def detected_columns(words: DataFrame, native_cells: DataFrame, tol: float = 0.02) -> DataFrame:
    """The widest row of the page's native tables if it has two cells or more, else the clusters of words.
    native_cells(doc_id, page, table_id, row, col) holds the cells of valid tables."""
    rows = native_cells.groupBy(*KEY, "table_id", "row").agg(F.count(F.lit(1)).alias("n"))
    widest = rows.groupBy(*KEY).agg(F.max("n").alias("native")).where("native >= 2")
    counted = column_count(words, tol).join(widest, KEY, "left")
    return counted.select(*KEY, F.coalesce("native", "columns").alias("columns"), F.col("native").isNotNull().alias("from_native"))


def _opens(*sorted_by: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in one of the arrays."""
    opens = np.ones(len(sorted_by[0]), bool)
    opens[1:] = np.logical_or.reduce([a[1:] != a[:-1] for a in sorted_by])
    return opens


def _per_page(pages: int, of: np.ndarray, amount: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(of, amount, pages).astype(np.int64)


FACTS = """doc_id long, page long, blocks long, left_blocks long, right_blocks long, grid_rows long, aligned_rows long, numeric_blocks long,
  positions long, position_count long, vertical_bands long, columns long"""


def page_facts(words: DataFrame, parts_per_page: int = 50, band_tol: float = 0.08, column_tol: float = 0.02, gap: float = 0.05) -> DataFrame:
    """J14, J33 and J34 in one pass over the words of a page, the pages of a batch side by side. Rows are rounded centres, as in
    ``rounded_y``; ``numeric`` tells how many numeric blocks a word is. ``grid_rows``: rows of two words or more, ``aligned_rows``:
    those of them with separated words, ``vertical_bands``: leader clusters of two rows or more."""
    names, target = [*KEY, "x0", "x1", "y0", "y1", "numeric"], to_arrow_schema(StructType.fromDDL(FACTS))

    def run(batch: pa.RecordBatch, ends: list[int]) -> pa.RecordBatch:
        doc, page, x0, x1, y0, y1, numeric = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        pages, first = len(ends) - 1, np.array(ends[:-1])
        of = np.repeat(np.arange(pages), np.diff(ends))
        x, height = (x0 + x1) / 2, np.rint((y0 + y1) / 2 * parts_per_page) / parts_per_page
        by_row = np.lexsort((x, height, of))
        page_at, x_at = of[by_row], x[by_row]
        opens = _opens(page_at, height[by_row])
        start, row_at = np.flatnonzero(opens), np.cumsum(opens) - 1
        row_of, several = page_at[start], np.diff([*start, len(x)]) >= 2
        step = np.diff(x_at, prepend=x_at[0])
        step[start] = 0.0
        distinct = np.add.reduceat((opens | (step != 0)).astype(np.int64), start)
        wide = several & (np.maximum.reduceat(step, start) >= gap)
        by_x = np.lexsort((row_at, x_at, page_at))
        page_x, x_x, row_x = page_at[by_x], x_at[by_x], row_at[by_x]
        in_wide = wide[row_x]
        spots = _opens(page_x[in_wide], x_x[in_wide])
        places = _opens(page_x, x_x)
        bands, columns = [], []
        for low, high in pairwise(ends):
            xs, rows = x_x[low:high], row_x[low:high]
            near = (rows[np.abs(xs - mean) <= band_tol] for mean in _means(xs[places[low:high]].tolist(), band_tol))
            bands.append(sum(r.size > 0 and r.min() != r.max() for r in near))
            columns.append(_count_columns(xs.tolist(), column_tol))
        found = [
            doc[first], page[first], np.diff(ends), _per_page(pages, of[x0 < 0.3]), _per_page(pages, of[x > 0.7]), _per_page(pages, row_of[several]),
            _per_page(pages, row_of[wide]), _per_page(pages, row_of[several], np.add.reduceat(numeric[by_row], start)[several]),
            _per_page(pages, page_x[in_wide][spots]), _per_page(pages, row_of[wide], distinct[wide]), bands, columns]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, target)], schema=target)

    return _pages(words, names, ["word_id"], run, FACTS)


CONSENSUS = "doc_id long, page long, col long, x double, row_support long"


def consensus_columns(words: DataFrame, row_tol: float, tol: float = 0.04, share: float = 0.6) -> DataFrame:
    """J2 and J11 in one pass over the words of a page, the pages of a batch side by side: what ``layout.consensus_columns`` gives on
    the rows of ``layout.row_bands``."""
    names, target = [*KEY, "x0", "x1", "y0", "y1"], to_arrow_schema(StructType.fromDDL(CONSENSUS))

    def run(batch: pa.RecordBatch, ends: list[int]) -> pa.RecordBatch:
        doc, page, x0, x1, y0, y1 = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        pages, first = len(ends) - 1, np.array(ends[:-1])
        of = np.repeat(np.arange(pages), np.diff(ends))
        x, yc = (x0 + x1) / 2, (y0 + y1) / 2
        by_y = np.lexsort((yc, of))
        opens = _opens(of[by_y])
        opens[1:] |= np.diff(yc[by_y]) > row_tol
        rows, row = _per_page(pages, of[by_y][opens]), np.empty(len(x), np.int64)
        row[by_y] = np.cumsum(opens)
        by_x = np.lexsort((row, x, of))
        by_x = by_x[_opens(of[by_x], x[by_x], row[by_x])]
        page_at, x_at = of[by_x], x[by_x]
        opens = _opens(page_at)
        opens[1:] |= np.diff(x_at) > tol
        start, run_at = np.flatnonzero(opens), np.cumsum(opens) - 1
        run_of, cx = page_at[start], np.add.reduceat(x_at, start) / np.diff([*start, len(x_at)])
        near = np.abs(x_at - cx[run_at]) <= tol
        near_run, near_row = run_at[near], row[by_x][near]
        by_run = np.lexsort((near_row, near_run))
        support = _per_page(len(start), near_run[by_run][_opens(near_run[by_run], near_row[by_run])])
        ok = support >= np.floor(rows * share)[run_of]
        chosen = np.flatnonzero(ok | (_opens(run_of) & (_per_page(pages, run_of[ok]) == 0)[run_of]))
        at = run_of[chosen]
        opens = np.flatnonzero(_opens(at))
        col = np.arange(len(at)) - np.repeat(opens, np.diff([*opens, len(at)]))
        found = [doc[first][at], page[first][at], col, cx[chosen], support[chosen]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, target)], schema=target)

    return _pages(words, names, ["word_id"], run, CONSENSUS)


SEPARATORS = {ord(c): None for c in " -/."}
LETTERS, DIGITS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"


def _digit_share(text: str) -> float:
    if text.isascii():
        bare = text.encode().translate(None, b" -/.")
        return (len(bare) - len(bare.translate(None, DIGITS))) / len(bare) if bare else 0.0
    bare = text.translate(SEPARATORS)
    return sum(c.isdigit() for c in bare) / len(bare) if bare else 0.0


def _script(text: str) -> str:
    if not text:
        return "unknown"
    n = len(text)
    if text.isascii():
        plain = text.encode()
        latin, digits = n - len(plain.translate(None, LETTERS)), n - len(plain.translate(None, DIGITS))
    else:
        if sum("ऀ" <= c <= "ॿ" for c in text) / n > 0.3:
            return "devanagari"
        latin, digits = sum("a" <= c.lower() <= "z" for c in text), sum(c.isdigit() for c in text)
    if latin / n > 0.3:
        return "latin"
    return "numeric" if digits / n > 0.5 else "mixed"


@lru_cache(maxsize=200_000)
def _kind(text: str | None) -> tuple[float, str]:
    return _digit_share(text or ""), _script(text or "")


def logical_cells(words: DataFrame, overlap: float = 0.7, height_factor: float = 1.5, numeric: float = 0.6) -> DataFrame:
    """Grow each cell downwards over words that overlap one of its words in x by 70 %, lie within
    1.5 line heights, and share the script (or both are numbers); empty and null texts join nothing. Every word is in exactly one cell."""
    def rule(p: Page) -> list[int]:
        x0, x1, y0, y1 = p["x0"], p["x1"], p["y0"], p["y1"]
        size = len(x0)
        limit = (sum(y1) - sum(y0)) / size * height_factor
        yc = [(a + b) / 2 for a, b in zip(y0, y1)]
        kinds = [_kind(t) for t in p["text"]]
        num = [share >= numeric for share, _ in kinds]
        script = [s for _, s in kinds]
        # words of one y0 lie by x0: where their line ends, and how far the line reaches up to each of them
        end, reach = [size] * size, x1[:]
        for i in range(size - 2, -1, -1):
            end[i] = end[i + 1] if y0[i] == y0[i + 1] else i + 1
        for i in range(1, size):
            if y0[i] == y0[i - 1] and reach[i] < reach[i - 1]:
                reach[i] = reach[i - 1]
        owner = [-1] * size
        cells = 0
        for i in range(size):
            if owner[i] >= 0:
                continue
            members, lowest, left, right = [i], yc[i], x0[i], x1[i]
            owner[i] = cells
            j = i + 1
            while j < size and y0[j] - lowest <= limit:
                last = end[j]
                for j in range(bisect_right(reach, left, j, last), last):
                    if x0[j] >= right:
                        break
                    if owner[j] >= 0 or x1[j] <= left:
                        continue
                    for m in reversed(members):
                        common = min(x1[m], x1[j]) - max(x0[m], x0[j])
                        if (
                            common > 0 and common / min(x1[m] - x0[m], x1[j] - x0[j]) >= overlap and abs(yc[m] - yc[j]) <= limit
                            and ((num[m] and num[j]) or script[m] == script[j] != "unknown")
                        ):
                            members.append(j)
                            owner[j] = cells
                            lowest, left, right = max(lowest, yc[j]), min(left, x0[j]), max(right, x1[j])
                            break
                j = last
            cells += 1
        return owner

    return _label(words, ["y0", "x0", "word_id"], "cell", ["x0", "x1", "y0", "y1", "text"], rule)


BLOCK = ["doc_id", "page", "word_id", "text", "x0", "y0", "x1", "y1", "font_size"]
BOX = "doc_id long, page long, word_id long, text string, x0 double, y0 double, x1 double, y1 double, font_size double"


def _merge_run(joins: Callable[[list, tuple], bool], opens: Callable[[str], bool] | None = None) -> Callable[[pa.RecordBatch, list[int]], pa.RecordBatch]:
    """Join each word to the block before it (by y, then x) while ``joins`` holds; boxes and texts grow.
    Blocks are lists in the order of ``BLOCK``. ``opens``: of two words that join, one has a space in its text and
    fulfils it, so that pages without such a word stay as they are."""
    target, text = to_arrow_schema(StructType.fromDDL(BOX)), BLOCK.index("text")

    def merged(part: pa.RecordBatch, ends: list[int]) -> pa.RecordBatch:
        rows = list(zip(*map(_values, part.columns)))
        blocks: list[list] = []
        for low, high in pairwise(ends):
            first = len(blocks)
            for w in rows[low:high]:
                if len(blocks) > first and joins(blocks[-1], w):
                    b = blocks[-1]
                    b[3] = f"{b[3]} {w[3]}".strip()
                    b[4], b[5], b[6], b[7] = min(b[4], w[4]), min(b[5], w[5]), max(b[6], w[6]), max(b[7], w[7])
                else:
                    blocks.append(list(w))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*blocks), target)], schema=target)

    def run(batch: pa.RecordBatch, ends: list[int]) -> pa.RecordBatch:
        batch = batch.cast(target)
        if opens is None:
            return merged(batch, ends)
        texts = batch.column(text)
        spaced = np.flatnonzero(pc.match_substring(texts, " ").fill_null(False).to_numpy(zero_copy_only=False))
        pages = sorted({bisect_right(ends, i) - 1 for i in spaced.tolist() if opens(texts[i].as_py())})
        parts, done = [], 0
        for k in pages:
            parts += [batch.slice(done, ends[k] - done), merged(batch.slice(ends[k], ends[k + 1] - ends[k]), [0, ends[k + 1] - ends[k]])]
            done = ends[k + 1]
        parts.append(batch.slice(done))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    return run


def _merge_runs(words: DataFrame, run: Callable[[pa.RecordBatch, list[int]], pa.RecordBatch], schema: str = BOX) -> DataFrame:
    return _pages(words.select(*BLOCK), BLOCK, ["y0", "x0", "word_id"], run, schema)


def _spaced_id(text: str) -> bool:
    return " " in text and 10 <= sum(c.isdigit() for c in text) <= 12


def _long_number(text: str) -> bool:
    """``profile.long_number_with_spaces`` of one text."""
    return " " in text and 10 <= sum(c.isdecimal() for c in text) <= 12


def _merge_numeric(gap: float) -> Callable[[pa.RecordBatch, list[int]], pa.RecordBatch]:
    def joins(a: list, b: tuple) -> bool:
        dy = abs((a[5] + a[7]) - (b[5] + b[7])) / 2
        return dy <= (a[7] - a[5]) * 0.5 and b[4] - a[6] <= gap and (_spaced_id(a[3]) or _spaced_id(b[3]))

    return _merge_run(joins, _spaced_id)


def merge_numeric_pieces(words: DataFrame, gap: float = 0.05) -> DataFrame:
    """Neighbours on a row closer than ``gap`` join when one of them is a long spaced number."""
    return _merge_runs(words, _merge_numeric(gap))


PLACED = "doc_id long, page long, row long, word_id long, text string, x0 double, at double"


def numeric_pieces_and_columns(words: DataFrame, parts_per_page: int, tol: float, min_rows: int = 1, gap: float = 0.05) -> DataFrame:
    """J22, J7 and J9 in one pass, for J39: the merged words with their row and centre ``at``, and the leader columns of
    their page, ``at`` their place and ``word_id`` null. Rows are rounded centres, as in ``rounded_y``."""
    merge, target = _merge_numeric(gap), to_arrow_schema(StructType.fromDDL(PLACED))

    def run(batch: pa.RecordBatch, ends: list[int]) -> pa.RecordBatch:
        blocks = merge(batch, ends)
        of = {n: blocks.column(n) for n in BLOCK}
        doc, page, x0, y0, x1, y1 = (of[n].to_numpy(zero_copy_only=False) for n in (*KEY, "x0", "y0", "x1", "y1"))
        at, height = (x0 + x1) / 2, np.rint((y0 + y1) / 2 * parts_per_page) / parts_per_page
        starts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(page) != 0)) + 1
        row = np.empty(len(doc), np.int64)
        marks: list[tuple[int, int, float]] = []
        for low, high in pairwise([0, *starts.tolist(), len(doc)]):
            row[low:high] = np.unique(height[low:high], return_inverse=True)[1]
            found = _leaders(at[low:high].tolist(), row[low:high].tolist(), tol, min_rows)
            marks += [(int(doc[low]), int(page[low]), x) for x, _ in found]
        placed = pa.RecordBatch.from_arrays([of["doc_id"], of["page"], pa.array(row), of["word_id"], of["text"], of["x0"], pa.array(at)], schema=target)
        docs, pages, places = zip(*marks) if marks else ((), (), ())
        none = [None] * len(marks)
        columns = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((docs, pages, none, none, none, none, places), target)], schema=target)
        return pa.Table.from_batches([placed, columns]).combine_chunks().to_batches()[0]

    return _merge_runs(words, run, PLACED)


def _below(factor: float) -> Callable[[list, tuple], bool]:
    def joins(a: list, b: tuple) -> bool:
        dx = abs((a[4] + a[6]) - (b[4] + b[6])) / 2
        return b[5] - a[7] <= (a[7] - a[5]) * factor and dx < (a[6] - a[4]) * 0.5

    return joins


def merge_vertical(words: DataFrame, factor: float = 0.8) -> DataFrame:
    """A word at most 0.8 heights under the block and centred within half its width joins it."""
    return _merge_runs(words, _merge_run(_below(factor)))


def _dense(of: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Number of each value among the different ones of its page, from zero."""
    order = np.lexsort((value, of))
    page_at = of[order]
    opens = _opens(page_at, value[order])
    number = np.cumsum(opens)
    first = _opens(page_at)
    out = np.empty(len(of), np.int64)
    out[order] = number - number[first][np.cumsum(first) - 1]
    return out


def _joined(texts: pa.Array, order: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Texts in ``order``, those from each of ``starts`` up to the next joined by blanks; nulls are left out."""
    taken, ends = texts.take(pa.array(order)), np.append(starts, len(order))
    if taken.null_count:
        filled = taken.is_valid().to_numpy(zero_copy_only=False)
        taken, ends = taken.drop_null(), np.append(0, np.cumsum(filled))[ends]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken), " ")


CELL = "doc_id long, page long, row long, col long, value string"


def soft_table(words: DataFrame, tol: float = 0.05, min_rows: int = 3, factor: float = 0.8) -> DataFrame:
    """J7, J23, J9 and J38 in one pass over the words of a page: what ``layout.soft_table`` gives for the words of the top row (rounded
    centres, as in ``rounded_y(100)``) and the others, merged down the page, on the leader columns of these."""
    merge, boxes, target = _merge_run(_below(factor)), to_arrow_schema(StructType.fromDDL(BOX)), to_arrow_schema(StructType.fromDDL(CELL))

    def put(blocks: list[tuple[str | None, bool, int]], columns: int) -> list[str | None]:
        cells: list[str | None] = [""] * columns
        for text, free, near in blocks:
            at = near if not free else cells.index("") if "" in cells else 0
            cells[at] = None if text is None or cells[at] is None else f"{cells[at]} {text}".strip(" ")
        return cells

    def run(batch: pa.RecordBatch, ends: list[int]) -> pa.RecordBatch:
        of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        y0, y1 = (batch.column(BLOCK.index(n)).to_numpy(zero_copy_only=False) for n in ("y0", "y1"))
        height = np.rint((y0 + y1) / 2 * 100)
        top = height == np.minimum.reduceat(height, ends[:-1])[of]
        head, of_body = batch.filter(pa.array(top)).cast(boxes), of[~top]
        if not len(of_body):
            return pa.RecordBatch.from_pylist([], schema=target)
        starts = np.flatnonzero(_opens(of_body)).tolist()
        body = merge(batch.filter(pa.array(~top)), [*starts, len(of_body)])
        doc, page = (body.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        body_of = of_body[starts][np.cumsum(_opens(doc, page)) - 1]
        both = pa.Table.from_batches([head, body]).combine_chunks().to_batches()[0]
        doc, page, word, x0, y0, x1, y1 = (both.column(BLOCK.index(n)).to_numpy(zero_copy_only=False) for n in (*KEY, "word_id", "x0", "y0", "x1", "y1"))
        of, x, texts = np.concatenate([of[top], body_of]), (x0 + x1) / 2, both.column(BLOCK.index("text"))
        in_body = np.arange(len(of)) >= head.num_rows
        row = np.zeros(len(of), np.int64)
        row[in_body] = _dense(body_of, np.rint((y0[in_body] + y1[in_body]) / 2 * 50)) + 1
        anchors: list[np.ndarray] = [np.empty(0)] * (len(ends) - 1)
        bounds = [*(np.flatnonzero(_opens(body_of)) + head.num_rows).tolist(), len(of)]
        for low, high in pairwise(bounds):
            anchors[of[low]] = np.array([m for m, _ in _leaders(x[low:high].tolist(), row[low:high].tolist(), tol, min_rows)])
        width = np.array([len(a) for a in anchors])
        order = np.lexsort((word, x0, row, of))
        order = order[width[of[order]] >= 2]
        if not len(order):
            return pa.RecordBatch.from_pylist([], schema=target)
        near = np.empty(len(order), np.int64)
        bounds = [*np.flatnonzero(_opens(of[order])).tolist(), len(order)]
        for low, high in pairwise(bounds):
            near[low:high] = np.abs(anchors[of[order[low]]] - x[order[low:high], None]).argmin(axis=1)
        spaced = pc.match_substring(texts, " ").fill_null(True).to_numpy(zero_copy_only=False)
        slow = spaced | pc.equal(texts, "").fill_null(True).to_numpy(zero_copy_only=False)
        opens = _opens(of[order], row[order])
        first, row_at = np.flatnonzero(opens), np.cumsum(opens) - 1
        columns = width[of[order[first]]]
        begin = np.append(0, np.cumsum(columns))
        values = np.full(begin[-1], "", object)
        walked = np.logical_or.reduceat(slow[order], first)
        plain = np.flatnonzero(~walked[row_at])
        if len(plain):
            cell = begin[row_at[plain]] + near[plain]
            by_cell = np.argsort(cell, kind="stable")
            opens = np.flatnonzero(_opens(cell[by_cell]))
            values[cell[by_cell[opens]]] = _joined(texts, order[plain[by_cell]], opens).to_numpy(zero_copy_only=False)
        last = np.append(first[1:], len(order))
        for k in np.flatnonzero(walked).tolist():
            some = order[first[k]:last[k]]
            words_of = [texts[i].as_py() for i in some.tolist()]
            free = [bool(b) and t is not None and _long_number(t) for b, t in zip(in_body[some], words_of)]
            values[begin[k]:begin[k + 1]] = put(list(zip(words_of, free, near[first[k]:last[k]].tolist())), int(columns[k]))
        each = np.repeat(first, columns)
        found = [doc[order[each]], page[order[each]], row[order[each]], np.arange(begin[-1]) - np.repeat(begin[:-1], columns), values]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, target)], schema=target)

    return _merge_runs(words, run, CELL)


def _extreme(most: np.ufunc, column: pa.Array, order: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Least (``np.fmin``) or largest value of each group, nulls left out."""
    out = most.reduceat(column.to_numpy(zero_copy_only=False)[order], starts)
    return pa.array(out, mask=np.isnan(out)) if column.null_count else pa.array(out)


def merge_lines(cells: DataFrame, threshold: float) -> DataFrame:
    """J25 in one pass over the words of a page; see ``layout.merge_lines``. ``__mixed`` tells of each word whether its page is of mixed
    languages. Openers of all cells of a batch are taken side by side: the first words left over, and all words near to them."""
    shown = ["confidence", "x0", "x1", "y0", "y1"]
    names = [*KEY, "row", "col", "word_id", "text", *shown, "__mixed"]
    fields = [cells.schema[n] for n in [*KEY, "row", "col"]] + [StructField("value", StringType())] + [cells.schema[n] for n in shown]
    schema = StructType([*fields, StructField("parts", LongType())])
    target = to_arrow_schema(schema)

    def run(batch: pa.RecordBatch, ends: list[int]) -> pa.RecordBatch:
        of_name = dict(zip(names, batch.columns))
        row, col, word, y0, y1, mixed = (of_name[n].to_numpy(zero_copy_only=False) for n in ("row", "col", "word_id", "y0", "y1", "__mixed"))
        of, yc, height = np.repeat(np.arange(len(ends) - 1), np.diff(ends)), (y0 + y1) / 2, y1 - y0
        tall = height > 0
        known = np.bincount(of[tall], minlength=len(ends) - 1)
        mean = np.bincount(of[tall], height[tall], len(ends) - 1) / np.maximum(known, 1)
        near = mean[of] * np.where(mixed, threshold * 1.5, threshold)
        order = np.lexsort((word, col, row, of))
        order = order[known[of[order]] > 0]
        if not len(order):
            return pa.RecordBatch.from_pylist([], schema=target)
        cell, opener = np.empty(len(of), np.int64), np.empty(len(of), np.int64)
        cell[order] = np.cumsum(_opens(of[order], row[order], col[order]))
        left, number = order, 0
        while len(left):
            opens = _opens(cell[left])
            first = left[opens][np.cumsum(opens) - 1]
            joins = opens | (np.abs(yc[left] - yc[first]) < near[first])
            opener[left[joins]] = number
            left, number = left[~joins], number + 1
        order = order[np.lexsort((opener[order], cell[order]))]  # stable: words of a cell stay in order
        first = np.flatnonzero(_opens(cell[order], opener[order]))
        least = {n: _extreme(np.fmax if n in ("x1", "y1") else np.fmin, of_name[n], order, first) for n in shown}
        each = pa.array(order[first])
        found = [*(of_name[n].take(each) for n in (*KEY, "row", "col")), _joined(of_name["text"], order, first), *least.values(), pa.array(np.diff([*first, len(order)]))]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(found, target)], schema=target)

    return _pages(cells, names, ["word_id"], run, schema)


LABELLED = f"{CELL}, is_label boolean"


def key_value_columns(words: DataFrame, row_tol: float, tol: float = 0.02, head_font: float = 12.0, fields: DataFrame | None = None) -> DataFrame:
    """J2, J12, J7, J15 and J37 in one pass over the words of a page: what ``layout.key_value_columns`` gives on the header anchors of the
    rows of ``layout.row_bands`` that have a mean font above ``head_font``. Fields that are dealt like the words meet them without a join."""
    names, target = [*KEY, "word_id", "text", "x0", "x1", "y0", "y1", "font_size", "__field", "__value"], to_arrow_schema(StructType.fromDDL(LABELLED))
    rows = words.select(*names[:-2], F.lit(None).cast("long").alias("__field"), F.lit(None).cast("string").alias("__value"))
    if fields is not None:
        filled = fields.where((F.trim("name") != "") | (F.trim("value") != ""))
        given = filled.select(*KEY, F.trim("name").alias("text"), F.col("n").cast("long").alias("__field"), F.trim("value").alias("__value"))
        rows = rows.unionByName(given, allowMissingColumns=True)

    def run(batch: pa.RecordBatch, ends: list[int]) -> pa.RecordBatch:
        is_field = batch.column(2).is_null().to_numpy(zero_copy_only=False)
        every = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        given = np.bincount(every[is_field], minlength=len(ends) - 1)
        parts = []
        if is_field.any():
            top, at = batch.filter(pa.array(is_field)), every[is_field]
            number = np.arange(len(at)) - np.append(0, np.cumsum(given))[at]
            for i, values in enumerate((top.column(3), top.column(names.index("__value")))):
                parts.append(pa.RecordBatch.from_arrays(
                    [top.column(0), top.column(1), pa.array(number), pa.array(np.full(len(at), i)), values, pa.array(np.full(len(at), i == 0))], schema=target))
        if not is_field.all():
            parts.append(placed(batch.filter(pa.array(~is_field)), every[~is_field], given))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    def placed(batch: pa.RecordBatch, of: np.ndarray, shift: np.ndarray) -> pa.RecordBatch:
        doc, page, word, texts, x0, x1, y0, y1, font = (
            c if n == "text" else c.to_numpy(zero_copy_only=False) for n, c in zip(names[:-2], batch.columns[:-2]))
        x, yc = (x0 + x1) / 2, (y0 + y1) / 2
        by_y = np.lexsort((word, yc, of))
        new_page = _opens(of[by_y])
        opens = new_page.copy()
        opens[1:] |= np.diff(yc[by_y]) > row_tol
        start, band = np.flatnonzero(opens), np.cumsum(opens) - 1
        is_head = np.add.reduceat(font[by_y], start) / np.diff([*start, len(x)]) > head_font
        headed = np.bincount(of[by_y[start]], is_head, int(of[-1]) + 1) > 0
        # without header rows the first band of the page
        chosen = is_head[band] | (~headed[of[by_y]] & (band == band[new_page][np.cumsum(new_page) - 1]))
        heads = by_y[chosen]
        spots, spot_of = np.concatenate([x0[heads], x1[heads], x[heads]]), np.tile(of[heads], 3)
        order = np.lexsort((spots, spot_of))
        spots, spot_of = spots[order], spot_of[order]
        kept = _opens(spot_of, spots)
        spots, spot_of = spots[kept], spot_of[kept]
        opens = _opens(spot_of)
        opens[1:] |= np.diff(spots) > tol
        start = np.flatnonzero(opens)
        size = np.diff([*start, len(spots)])
        anchors, anchor_of = spots[start + size // 2], spot_of[start]
        at_page = np.flatnonzero(_opens(anchor_of))
        known = dict(zip(anchor_of[at_page].tolist(), np.split(anchors, at_page[1:])))
        col = np.empty(len(x), np.int64)
        for low, high in pairwise([*np.flatnonzero(_opens(of)).tolist(), len(of)]):
            marks, places = known[int(of[low])], x[low:high]
            here = np.maximum(np.searchsorted(marks, places, side="right") - 1, 0)
            after = np.minimum(here + 1, len(marks) - 1)
            before = marks[here] <= places  # else the word lies before the first column
            col[low:high] = np.where(before & (marks[after] - places < places - marks[here]), after, here)
        row = _dense(of, np.rint(yc * 100))
        order = np.lexsort((word, x0, col, row, of))
        first = np.flatnonzero(_opens(of[order], row[order], col[order]))
        colon, known_text = (c.to_numpy(zero_copy_only=False) for c in (pc.match_substring(texts, ":").fill_null(False), texts.is_valid()))
        each = order[first]
        in_first, has_colon, has_text = col[each] == 0, np.logical_or.reduceat(colon[order], first), np.logical_or.reduceat(known_text[order], first)
        label = pa.array(in_first | has_colon, mask=~in_first & ~has_text)  # cells of unknown texts only may be labels or not
        found = [doc[each], page[each], row[each] + shift[of[each]], col[each], _joined(texts, order, first), label]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(found, target)], schema=target)

    return _pages(rows, names, ["word_id", "__field"], run, LABELLED)


def join_continued_lines(cells: DataFrame, longest: int = 80) -> DataFrame:
    """Going down, a cell swallows the one below unless it is a header (bold or row 0), ends a sentence,
    both are numbers, or it is long; rows left empty vanish. cells(doc_id, page, row, col, value, bold)."""
    def rule(p: Page) -> list[tuple]:
        grid = {(r, c): [v, b] for r, c, v, b in zip(p["row"], p["col"], p["value"], p["bold"])}
        places = sorted(grid)
        for r, c in places:
            below = grid.get((r + 1, c))
            text, bold = grid[(r, c)]
            if below is None or not text or not below[0] or bold or r == 0:
                continue
            bare = text.strip()
            if bare[-1:] in (".", "!", "?", "।") or (bare.isdecimal() and below[0].strip().isdecimal()) or len(text) >= longest:
                continue
            grid[(r, c)][0], below[0] = f"{text} {below[0]}", ""
        return [(p["doc_id"][0], p["page"][0], r, c, grid[(r, c)][0]) for r, c in places if grid[(r, c)][0].strip()]

    return by_page(
        cells.select(*KEY, "row", "col", "value", "bold"), "doc_id long, page long, row long, col long, value string", ["row", "col"], rule
    )


def fill_boxes(cells: DataFrame) -> DataFrame:
    """Row by row, a cell without a box takes one beside its left neighbour, else under the one above,
    else diagonal, with average size. cells(doc_id, page, row, col, x0, y0, x1, y1), boxes null when missing."""
    def rule(p: Page) -> list[tuple]:
        given = {
            (r, c): (a, b, d, e)
            for r, c, a, b, d, e in zip(p["row"], p["col"], p["x0"], p["y0"], p["x1"], p["y1"]) if a is not None
        }
        boxes = dict(given)
        if boxes:
            w = sum(b[2] - b[0] for b in given.values()) / len(given)
            h = sum(b[3] - b[1] for b in given.values()) / len(given)
            for r in range(max(p["row"]) + 1):
                for c in range(max(p["col"]) + 1):
                    if (r, c) in boxes:
                        continue
                    left, up, diag = boxes.get((r, c - 1)), boxes.get((r - 1, c)), boxes.get((r - 1, c - 1))
                    if left:
                        boxes[(r, c)] = (left[2], left[1], left[2] + w, left[3])
                    elif up:
                        boxes[(r, c)] = (up[0], up[3], up[2], up[3] + h)
                    elif diag:
                        boxes[(r, c)] = (diag[2], diag[3], diag[2] + w, diag[3] + h)
        return [(p["doc_id"][0], p["page"][0], r, c, *b, (r, c) not in given) for (r, c), b in sorted(boxes.items())]

    return by_page(
        cells.select(*KEY, "row", "col", "x0", "y0", "x1", "y1"),
        "doc_id long, page long, row long, col long, x0 double, y0 double, x1 double, y1 double, inferred boolean", ["row", "col"], rule,
    )


SPACES = re.compile(r"\s+", re.ASCII)


class _Blocks:
    """The different texts of a page's blocks, in their order, for J30. Nothing is compared with all of them: texts that
    contain another are found by one search, contained ones by search or by their lengths, similar ones by shared rare words."""

    def __init__(self, texts: list[str], floor: float) -> None:
        self.texts, self.floor = texts, floor
        self.place = {t: i for i, t in enumerate(texts)}
        self.joined, ends = "\0".join(texts), np.cumsum([len(t) + 1 for t in texts])
        self.starts = [0, *ends.tolist()]
        self.shorter = sorted((len(t), i) for i, t in enumerate(texts))
        self.words = [self._words(t) for t in texts]
        self.sizes = sorted({len(w) for w in self.words})
        self.rare: dict[str, list[int]] | None = None

    @staticmethod
    def _words(text: str) -> set[str]:
        words = set(SPACES.split(text))
        words.discard("")
        return words

    def _prefix(self, words: set[str]) -> list[str]:
        return sorted(words, key=lambda w: (-len(w), w))[: max(0, len(words) - ceil(len(words) * self.floor - 1e-9) + 1)]

    def _contains(self, v: str) -> int:
        """First block with ``v`` in it, else their number."""
        if "\0" in v:
            return next((i for i, t in enumerate(self.texts) if v in t), len(self.texts))
        at = self.joined.find(v)
        return bisect_right(self.starts, at) - 1 if at >= 0 else len(self.texts)

    def _inside(self, v: str, before: int) -> int:
        """First block that is a part of ``v``, if it comes before ``before``."""
        short = self.shorter[: bisect_right(self.shorter, (len(v), -1))]
        if len(short) <= len(v):
            return min((i for _, i in short if i < before and self.texts[i] in v), default=before)
        cuts = (v[k:k + n] for n in sorted({n for n, _ in short}) for k in range(len(v) - n + 1))
        return min((self.place[c] for c in cuts if c in self.place), default=before)

    def best(self, v: str) -> int | None:
        """Place of the most similar text above the floor, the first of equally similar ones."""
        score, place = (1.0, self.place[v]) if v in self.place else (0.0, len(self.texts))
        if score < 1 and self.floor < 0.8:
            holds = self._contains(v)
            first = min(holds, self._inside(v, holds))
            if first < len(self.texts):
                score, place = 0.8, first
        words = self._words(v)
        least, most = len(words) * (self.floor - 1e-9), len(words) / (self.floor - 1e-9) if self.floor > 1e-9 else float("inf")
        at = bisect_right(self.sizes, most)
        if at and self.sizes[at - 1] >= least:
            if self.rare is None:
                self.rare = {}
                for i, known in enumerate(self.words):
                    for w in self._prefix(known):
                        self.rare.setdefault(w, []).append(i)
            for i in {i for w in self._prefix(words) for i in self.rare.get(w, ()) if least <= len(self.words[i]) <= most}:
                common = len(words & self.words[i])
                s = common / (len(words) + len(self.words[i]) - common)
                if s > self.floor and (s, -i) > (score, -place) and v not in self.texts[i] and self.texts[i] not in v:
                    score, place = s, i
        return place if score > self.floor else None


def match_blocks(rows: DataFrame, shown: StructType, floor: float) -> DataFrame:
    """J30 in one pass over the cells and blocks of a page: a cell with a text to look for (``__t``) takes the number ``__o``, as
    ``matched_word``, and where it has none itself the box of the most similar block. Rows without ``__o`` are the cells; they leave with
    the columns ``shown``."""
    box, names = ["x0", "y0", "x1", "y1"], [*shown.names, "__t", "__o"]
    schema = StructType([*shown.fields, StructField("matched_word", LongType())])
    target = to_arrow_schema(schema)

    def run(batch: pa.RecordBatch, ends: list[int]) -> pa.RecordBatch:
        texts, order = batch.column(names.index("__t")).to_pylist(), batch.column(names.index("__o"))
        is_cell = order.is_null().to_numpy(zero_copy_only=False)
        hits: list[int | None] = []
        for low, high in pairwise(ends):
            first = low + int(is_cell[low:high].sum())  # cells come before the blocks, which are in order
            rows_of: dict[str, int] = {}
            for i in range(first, high):
                if texts[i]:
                    rows_of.setdefault(texts[i], i)
            places = list(rows_of.values())
            blocks, known = _Blocks(list(rows_of), floor) if rows_of else None, {}
            for v in texts[low:first]:
                if not v or blocks is None:
                    hits.append(None)
                    continue
                if v not in known:
                    known[v] = blocks.best(v)
                hits.append(None if known[v] is None else places[known[v]])
        found = pa.array(hits, pa.int64())
        cells = batch.filter(pa.array(is_cell))
        columns = {n: cells.column(i) for i, n in enumerate(shown.names)}
        for n in box:
            columns[n] = pc.coalesce(columns[n], batch.column(names.index(n)).take(found))
        return pa.RecordBatch.from_arrays([*columns.values(), order.take(found)], names=target.names).cast(target)

    return _pages(rows, names, ["__o"], run, schema)
