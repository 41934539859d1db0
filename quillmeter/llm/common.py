"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillmeter.session import ensure_checkpoint_dir

#: ASCII white space, the only separator of words in the corpus operators.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the one that all executors share (``spark.checkpoint.dir``)."""
    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there and no task runs twice."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column | str) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def crc_bucket(key: Column | str, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; null for a null key."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % n


#: Bytes of text that a task turns into Python strings at a time; a longer text comes alone.
BATCH_BYTES = 4 << 20


def portions(texts: pa.Array) -> Iterator[slice]:
    """Neighbouring texts of ``BATCH_BYTES`` together at most, or a single one."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        upto = max(start + 1, int(np.searchsorted(ends, before + BATCH_BYTES, side="right")))
        yield slice(start, upto)
        start = upto


def with_text_columns(
    df: DataFrame, text: str, make: Callable[[], Callable[[list[str]], list]], new: dict[str, str], keep: list[str] | None = None
) -> DataFrame:
    """Append columns computed from the texts, a few megabytes at a time, without a shuffle.

    ``make`` runs once per task and returns the function from a list of texts (null: empty) to one list per new
    column. ``new`` maps names to Spark types. A new column replaces a kept one of the same name. ``text`` may be a
    field of a kept struct (``doc.text``); then it does not travel a second time.
    """
    kept = [c for c in dict.fromkeys(keep if keep is not None else df.columns) if c not in new]
    added = T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in new.items()))
    schema = T.StructType([df.schema[c] for c in kept] + added.fields)
    arrow = [to_arrow_type(f.dataType) for f in added.fields]
    parent, _, child = text.partition(".")
    inside = child and text not in df.columns
    at = kept.index(parent) if inside else len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            column = pc.struct_field(batch.column(at), child) if inside else batch.column(at)
            for some in portions(column):
                texts = [t or "" for t in column[some].to_pylist()]
                columns = [pa.array(v, type=t) for v, t in zip(apply(texts), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*[c[some] for c in batch.columns[: len(kept)]], *columns], names=[*kept, *new])

    # a text of its own travels last, so that it may also be among the kept columns
    source = [] if inside else [F.col(f"`{text}`").cast("string").alias("__text")]
    return df.select(*[F.col(f"`{c}`") for c in kept], *source).mapInArrow(run, schema)
