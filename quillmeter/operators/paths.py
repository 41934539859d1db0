"""Rules where each decision depends on the last, for keys with more rows than one task should read.

Rows of a key are numbered and cut into chunks of bounded size. What a chunk does to the state that enters it is a
function; chunks work theirs out side by side, the functions are composed, and with its entering state known each
chunk is finished by itself. Two forms:

``path_nodes``: the state is "row i decides next, in class c" with a few classes, and what follows is known for each
such node. A chunk maps its nodes to the nodes where its paths leave it (pointer doubling on arrays); paths across
chunks are composed by joins that double their length, so their number is the logarithm of the number of chunks.

``entering_states``: the state has numbers of any size (a balance, a deadline). A chunk run from one entering state
also tells for which range of states the same decisions are made, and so what leaves it for that whole range: one piece
of its piecewise map. Chunks without a piece for the state that really enters are run again; the rest is composed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillmeter.operators.scans import join_null_safe, running_total
from quillmeter.sources.sinks import written

#: Rows of a key that one task reads at most.
CHUNK_ROWS = 200_000


def split_hot(rows: DataFrame, keys: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys with at most ``limit`` rows, and those of larger keys (None if there are none).

    Whether larger keys exist is asked at once, by a count that combines before its shuffle.
    """
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit).select(*keys)
    if hot.isEmpty():
        return rows, None
    return join_null_safe(rows, hot, keys, "left_anti"), join_null_safe(rows, hot, keys, "left_semi")


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, chunk_us: int) -> DataFrame:
    """Add ``i``, the number of earlier rows of the key. ``at`` is the first column of the order, in microseconds."""
    counted = running_total(rows, keys, order, {"i": F.lit(1).cast("long")}, F.floor(F.col(at) / chunk_us))
    return counted.withColumn("i", F.col("i") - 1)


def with_next(rows: DataFrame, keys: Sequence[str], at: str, span: int, chunk_us: int) -> DataFrame:
    """Add ``next``: the number ``i`` of the key's first row at least ``span`` after each row (its row count if none).

    Rows and the times asked for are sorted together, so no row is compared with another.
    """
    marks = rows.select(*keys, F.col(at).alias("t"), F.lit(1).cast("long").alias("v"), F.lit(None).cast("long").alias("i"))
    asked = rows.select(*keys, (F.col(at) + span).alias("t"), F.lit(0).cast("long").alias("v"), "i")
    before = running_total(marks.unionByName(asked), keys, ["t", "v"], {"next": F.col("v")}, F.floor(F.col("t") / chunk_us))
    return join_null_safe(rows, before.where("i IS NOT NULL").select(*keys, "i", "next"), [*keys, "i"])


def _schema(df: DataFrame, keys: Sequence[str], more: str) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + T._parse_datatype_string(more).fields)


def path_nodes(steps: DataFrame, keys: Sequence[str], classes: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(keys, i, class) of the nodes on each key's path from its row 0 in class 0.

    ``steps`` has per row its number ``i`` and ``jumps``, per class the node that follows, always of a later row. A node
    is ``i * classes + class``; beyond the last row the path ends.
    """
    keys = list(keys)
    chunked = steps.select(*keys, "i", "jumps").withColumn("__chunk", F.floor(F.col("i") / chunk_rows))
    links_type, visited_type = (_schema(steps, keys, s) for s in ("node long, exit long", "i long, class int"))
    links_arrow, visited_arrow = to_arrow_schema(links_type), to_arrow_schema(visited_type)
    n_keys = len(keys)

    def jumps_of(chunk: pa.Table) -> tuple[int, np.ndarray]:
        i = chunk.column("i").to_numpy()
        jumps = chunk.column("jumps").combine_chunks().flatten().to_numpy().reshape(len(i), classes)
        return int(i.min()) * classes, jumps[np.argsort(i)].ravel()

    def compress(key: tuple, chunk: pa.Table) -> pa.Table:
        first, exits = jumps_of(chunk)
        end = first + len(exits)
        while (inside := exits < end).any():
            exits = np.where(inside, exits[np.where(inside, exits - first, 0)], exits)
        same = [pa.repeat(k, len(exits)) for k in key[:n_keys]]
        return pa.Table.from_arrays([*same, pa.array(np.arange(first, end)), pa.array(exits)], schema=links_arrow)

    links = written(chunked.groupBy(*keys, "__chunk").applyInArrow(compress, links_type), "path-links")
    marked = steps.select(*keys).distinct().withColumn("node", F.lit(0).cast("long"))
    while True:
        forward = join_null_safe(marked, links, [*keys, "node"]).select(*keys, F.col("exit").alias("node"))
        marked = written(marked.unionByName(forward).distinct(), "path-marked")
        second = links.select(*keys, F.col("node").alias("exit"), F.col("exit").alias("__far"))
        links = written(join_null_safe(links, second, [*keys, "exit"]).select(*keys, "node", F.col("__far").alias("exit")), "path-links")
        if links.isEmpty():
            break

    def walk(chunk: pa.Table, entry: pa.Table) -> pa.Table:
        if not len(chunk) or not len(entry):
            return visited_arrow.empty_table()
        first, jumps = jumps_of(chunk)
        # the end of a path has a number of the last chunk too, behind its rows
        nexts, at, end, seen = jumps.tolist(), min(entry.column("node").to_pylist()), first + len(jumps), []
        while at < end:
            seen.append(at)
            at = nexts[at - first]
        nodes = np.array(seen, dtype=np.int64)
        same = [pa.repeat(chunk.column(k)[0], len(nodes)) for k in keys]
        return pa.Table.from_arrays([*same, pa.array(nodes // classes), pa.array((nodes % classes).astype(np.int32))], schema=visited_arrow)

    entries = marked.withColumn("__chunk", F.floor(F.col("node") / (classes * chunk_rows)))
    return chunked.groupBy(*keys, "__chunk").cogroup(entries.groupBy(*keys, "__chunk")).applyInArrow(walk, visited_type)


def entering_states(
    rows: DataFrame,
    keys: Sequence[str],
    state: str,
    piece: str,
    start: tuple,
    run: Callable[[list[tuple], tuple | None, int], list[tuple]],
    matches: Callable[[tuple, tuple], bool],
    leave: Callable[[tuple, tuple], tuple],
    bounds: DataFrame,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """(keys, chunk, state columns): what enters each chunk of ``chunk_rows`` rows, numbered by ``i``.

    ``run(rows of a chunk, entering state or None for a guess, bound)`` gives pieces, each beginning with the least and the
    greatest first column of the states it may hold for; ``bounds`` (keys, __chunk, __bound) has what that column is at most
    where a chunk begins. ``matches(piece, state)`` tells whether a piece holds for a state, ``leave(piece, state)`` what
    then leaves the chunk. Each round runs, side by side, all chunks that have no piece for their entering state yet; the
    first of them is exact, later ones may be guesses. As pieces cover all first columns up to the bound, a chunk is run
    again only if the rest of its state was guessed wrong.
    """
    keys, names = list(keys), [f.name for f in T._parse_datatype_string(state).fields]
    pieces_of = [f.name for f in T._parse_datatype_string(piece).fields]
    chunked = rows.withColumn("__chunk", F.floor(F.col("i") / chunk_rows))
    piece_type, entry_type = _schema(rows, keys, f"__chunk long, __round int, {piece}"), _schema(rows, keys, f"__chunk long, {state}, __known boolean")
    piece_arrow, entry_arrow = to_arrow_schema(piece_type), to_arrow_schema(entry_type)
    columns = rows.columns
    order = columns.index("i")

    def ordered(chunk: pa.Table) -> list[tuple]:
        return sorted(zip(*(chunk.column(c).to_pylist() for c in columns), strict=True), key=lambda r: r[order])

    def probe(turn: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def one(chunk: pa.Table, entry: pa.Table) -> pa.Table:
            if not len(chunk) or not len(entry):
                return piece_arrow.empty_table()
            number = entry.column("__chunk")[0].as_py()
            entering = tuple(entry.column(c)[0].as_py() for c in names) if turn else (start if number == 0 else None)
            got = run(ordered(chunk), entering, entry.column("__bound")[0].as_py())
            same = [pa.repeat(chunk.column(k)[0], len(got)) for k in keys] + [pa.repeat(number, len(got)), pa.repeat(turn, len(got))]
            arrays = [a.cast(f.type) for a, f in zip(same, piece_arrow)] + [pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), list(piece_arrow)[len(same) :], strict=True)]
            return pa.Table.from_arrays(arrays, schema=piece_arrow)

        return one

    def resolve(key: tuple, found: pa.Table) -> pa.Table:
        found = found.sort_by([("__chunk", "ascending"), ("__round", "descending")]).combine_chunks()
        numbers, first = np.unique(found.column("__chunk").to_numpy(), return_index=True)
        least, most = (found.column(c).to_numpy() for c in pieces_of[:2])
        out, entering = [], start
        for number, low, high in zip(numbers.tolist(), first.tolist(), [*first[1:].tolist(), len(found)], strict=True):
            at = low + np.flatnonzero((least[low:high] <= entering[0]) & (entering[0] <= most[low:high]))
            near = found.select(pieces_of).take(pa.array(at if len(at) else [low], pa.int64()))
            newest_first = list(zip(*(c.to_pylist() for c in near.columns), strict=True))
            fitting = next((p for p in newest_first if matches(p, entering)), None)
            out.append((number, *entering, fitting is not None))
            entering = leave(fitting or newest_first[0], entering)
        arrays = [pa.repeat(k, len(out)) for k in key] + [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(entry_arrow)[len(keys) :], strict=True)]
        return pa.Table.from_arrays(arrays, schema=entry_arrow)

    wanted = bounds = written(bounds, "chunk-bounds")
    pieces, turn = None, 0
    while True:
        probed = chunked.groupBy(*keys, "__chunk").cogroup(wanted.groupBy(*keys, "__chunk")).applyInArrow(probe(turn), piece_type)
        new = written(probed, "chunk-pieces")
        pieces = new if pieces is None else pieces.unionByName(new)
        entries = written(pieces.groupBy(*keys).applyInArrow(resolve, entry_type), "chunk-entries")
        wanted = join_null_safe(entries.where("NOT __known"), bounds, [*keys, "__chunk"])
        if wanted.isEmpty():
            return entries.drop("__known").withColumnRenamed("__chunk", "chunk")
        turn += 1


def finished_chunks(
    rows: DataFrame, keys: Sequence[str], entries: DataFrame, chunk_rows: int, schema: str, step: Callable[[list, tuple], tuple], out: Sequence[str]
) -> DataFrame:
    """Run every chunk from its entering state; ``schema`` is that of the rows without ``i``, and of ``out``."""
    keys = list(keys)
    columns = [c for c in rows.columns if c != "i"]
    states = [c for c in entries.columns if c not in (*keys, "chunk")]
    fields = to_arrow_schema(T._parse_datatype_string(schema))

    def finish(chunk: pa.Table, entry: pa.Table) -> pa.Table:
        if not len(chunk):
            return fields.empty_table()
        state = [entry.column(c)[0].as_py() for c in states]
        chunk = chunk.sort_by("i").select(columns)
        made = [step(state, row) for row in zip(*(c.to_pylist() for c in chunk.columns), strict=True)]
        new = dict(zip(out, zip(*made, strict=True), strict=True))
        return pa.Table.from_arrays([chunk.column(f.name) if f.name in columns else pa.chunked_array([pa.array(new[f.name], f.type)]) for f in fields], schema=fields)

    chunked = rows.withColumn("chunk", F.floor(F.col("i") / chunk_rows))
    return chunked.groupBy(*keys, "chunk").cogroup(entries.groupBy(*keys, "chunk")).applyInArrow(finish, schema)
