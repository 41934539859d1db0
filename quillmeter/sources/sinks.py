"""Sinks (survey group A): reports, appended rows, additive tables, wide grids."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmeter.session import ensure_checkpoint_dir


def write_csv_report(df: DataFrame, path: str) -> None:
    """A3: quoted CSV with header, written by the executors in parallel. Quotes within a field are doubled."""
    df.write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def append_rows(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """A4: append to a Parquet table."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_stream(df: DataFrame, path: str, state: str) -> StreamingQuery:
    """A4: append what has arrived and stop; the state folder makes it exactly once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start()


def add_up(existing: DataFrame, increments: DataFrame, keys: Sequence[str], amounts: Sequence[str]) -> DataFrame:
    """A5: the additive upsert as union and sum: order of increments does not matter, none is lost."""
    cols = [*keys, *amounts]
    return existing.select(*cols).unionByName(increments.select(*cols)).groupBy(*keys).agg(*[F.sum(a).alias(a) for a in amounts])


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers n of the finished folders ``name=n`` below ``folder``; unfinished ones have no marker and do not count."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path):
        return []
    inside = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith(f"{name}=")]
    done = [p for p in inside if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=", 1)[1]) for p in done)


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def store_increments(batch: DataFrame, batch_id: int, path: str, keys: Sequence[str], amounts: Sequence[str]) -> None:
    """A5: the sums of one batch under its number. A batch that comes again replaces itself, or is skipped when a
    snapshot already holds it."""
    snapshots = _numbers(batch.sparkSession, f"{path}/snapshots", "upto")
    if snapshots and batch_id <= snapshots[-1]:
        return
    sums = batch.groupBy(*keys).agg(*[F.sum(a).alias(a) for a in amounts])
    sums.write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")


def additive_table_stream(increments: DataFrame, path: str, state: str, keys: Sequence[str], amounts: Sequence[str], compact_every: int = 100) -> StreamingQuery:
    """A5 on a stream: each batch is logged once under its number; every ``compact_every`` batches the log is folded into a
    snapshot, so that reading costs one snapshot and a bounded log."""

    def store(batch: DataFrame, batch_id: int) -> None:
        store_increments(batch, batch_id, path, keys, amounts)
        if (batch_id + 1) % compact_every == 0:
            compact_additive_table(batch.sparkSession, path, keys, amounts)

    return increments.writeStream.foreachBatch(store).option("checkpointLocation", state).trigger(availableNow=True).start()


def _parts(spark: SparkSession, path: str) -> tuple[int, list[int], list[str]]:
    """The number the latest snapshot goes up to (-1: none), the logged batches behind it, and the folders of both."""
    snapshots = _numbers(spark, f"{path}/snapshots", "upto")
    upto = snapshots[-1] if snapshots else -1
    later = [n for n in _numbers(spark, f"{path}/log", "batch") if n > upto]
    return upto, later, ([f"{path}/snapshots/upto={upto}"] if snapshots else []) + [f"{path}/log/batch={n}" for n in later]


def read_additive_table(spark: SparkSession, path: str, keys: Sequence[str], amounts: Sequence[str]) -> DataFrame:
    """A5: the latest snapshot and the batches behind it, added up."""
    return spark.read.parquet(*_parts(spark, path)[2]).groupBy(*keys).agg(*[F.sum(a).alias(a) for a in amounts])


def compact_additive_table(spark: SparkSession, path: str, keys: Sequence[str], amounts: Sequence[str]) -> None:
    """A5: fold the log into a new snapshot, then drop what it holds.

    Readers take the latest finished snapshot and only batches behind it, so a crash before the snapshot is finished
    changes nothing, and one before the old folders are dropped leaves folders that nobody reads and the next
    compaction drops.
    """
    _, later, folders = _parts(spark, path)
    if later:
        sums = spark.read.parquet(*folders).groupBy(*keys).agg(*[F.sum(a).alias(a) for a in amounts])
        sums.write.mode("overwrite").parquet(f"{path}/snapshots/upto={later[-1]}")
    upto = _numbers(spark, f"{path}/snapshots", "upto")[-1:]
    for name, folder in (("batch", "log"), ("upto", "snapshots")):
        for n in _numbers(spark, f"{path}/{folder}", name):
            if upto and (n <= upto[0] if name == "batch" else n < upto[0]):
                _drop(spark, f"{path}/{folder}/{name}={n}")


def wide_grid(cells: DataFrame, keys: Sequence[str], columns: Sequence[int]) -> DataFrame:
    """Long cells to one row per sheet row; the column list is given, so no extra pass finds it."""
    return cells.groupBy(*keys, "row").pivot("col", list(columns)).agg(F.first("value"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder that all executors share."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a lost executor costs no more than the step at hand."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
