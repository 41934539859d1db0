"""Ordered computation per key that stays parallel when one key holds much of the data.

``running_total`` is a two-level prefix sum: partial sums per (key, time chunk), a window over the
few chunk sums of a key, and a window inside each (key, chunk). No task ever sees a whole key.

``ordered_fold`` is for rules where each decision depends on the earlier ones (a rejected request
must not count). It sorts by (key, order) with Spark's spilling sort and streams the partition
through Python with one small state at a time: no group is materialised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from quillmeter.functions.exprs import micros


def time_chunk(ts: str, seconds: int) -> Column:
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def join_null_safe(rows: DataFrame, offsets: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equality join in which null meets null, so that rows without a key or a time stay."""
    named = offsets.withColumnsRenamed({c: f"__on_{c}" for c in on})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__on_{c}")) for c in on))
    return rows.join(named, same, how).drop(*[f"__on_{c}" for c in on])


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    chunk: Column,
) -> DataFrame:
    """Add inclusive running sums per key. ``chunk`` must never decrease along ``order``."""
    tmp = {name: f"__v_{name}" for name in values}
    base = df.withColumns({"__chunk": chunk, **{tmp[n]: v for n, v in values.items()}})
    on = [*keys, "__chunk"]
    before = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = base.groupBy(*on).agg(*[F.sum(t).alias(t) for t in tmp.values()]).select(
        *on, *[F.coalesce(F.sum(t).over(before), F.lit(0)).alias(f"__o{t}") for t in tmp.values()]
    )
    inside = W.partitionBy(*on).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = join_null_safe(base, offsets, on).withColumns(
        {n: (F.sum(t).over(inside) + F.col(f"__o{t}")) for n, t in tmp.items()}
    )
    return out.select(*df.columns, *values.keys())


def running_min_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, chunk: Column, out: str
) -> DataFrame:
    """Smallest earlier value per key (null for the first row), with the same two-level scheme."""
    base = df.withColumns({"__chunk": chunk, "__v": value})
    on = [*keys, "__chunk"]
    before = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = base.groupBy(*on).agg(F.min("__v").alias("__m")).select(
        *on, F.min("__m").over(before).alias("__o")
    )
    inside = W.partitionBy(*on).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        join_null_safe(base, offsets, on)
        .withColumn(out, F.least(F.min("__v").over(inside), F.col("__o")))
        .select(*df.columns, out)
    )


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best k rows per key. Spark cuts every map task to k rows per key before the shuffle
    (WindowGroupLimit), so a hot key costs k rows per task, not its whole history."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k).withColumn(
        rank, F.col(rank).cast("long")
    )


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    schema: str,
    start: Callable[[], object],
    step: Callable[[object, tuple], tuple],
    out_columns: Sequence[str],
) -> DataFrame:
    """Add columns computed by ``step(state, row) -> outputs`` along each key's order.

    One pass, one state; Arrow batches arrive from a sorted partition, so memory does not grow with a key, and nulls
    stay nulls. ``step`` mutates the state and returns the values of ``out_columns``. A key is read by one task: keys
    that may be large go through ``paths`` instead.
    """
    cols = df.columns
    key_at = [cols.index(k) for k in keys]
    fields = list(to_arrow_schema(T._parse_datatype_string(schema)))
    added = [f for f in fields if f.name in out_columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            produced = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = tuple(row[i] for i in key_at)
                if state is None or key != current:
                    current, state = key, start()
                produced.append(step(state, row))
            values = zip(*produced, strict=True) if produced else [[] for _ in added]
            new = dict(zip(out_columns, values, strict=True))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(new[f.name], f.type) for f in added]], names=[*cols, *[f.name for f in added]]
            )

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
