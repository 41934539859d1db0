"""Mixture-controlled packing of tokenised documents into fixed windows.

Every source is a queue of tokens. Deficit round-robin gives source ``s`` a quantum of ``window * T_s / T`` tokens
per window; what a window could not send in whole tokens is carried as a deficit of less than one token. After any
number of windows the carried deficits follow from the totals alone (`sent`), so every partition starts with the
right deficits without waiting for the one before, and every token finds its window by arithmetic: no sequence is
assembled in one place. All windows but the last are full; the last ones are cut at powers of two, which need no
padding.
"""

from __future__ import annotations

import functools
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.llm import bpe
from quillmeter.llm.common import materialised, portions

#: Most queues; with more sources several share a queue by hash. The list of totals is what tasks receive.
MAX_QUEUES = 1024
#: Offsets (a queue in a chunk, three numbers each) up to which they are broadcast; more are joined by a shuffle.
SMALL_OFFSETS = 200_000


class Rounds:
    """The deficit round-robin over queues with the given totals."""

    def __init__(self, totals: list[int], window: int) -> None:
        self.totals = np.array(totals, dtype=np.int64)
        self.window, self.all = window, int(sum(totals))
        self.full = self.all // window
        self.before: dict[int, list[int]] = {}
        self.begins: dict[int, list[int]] = {}
        rest, at = self.all - self.full * window, self.full * window
        self.tail: list[tuple[int, int]] = []  # start and length of the sequences behind the full windows
        for bit in range(rest.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                self.tail.append((at, 1 << bit))
                at += 1 << bit

    def sent_at(self, total: int) -> np.ndarray:
        """Tokens of each queue among the first ``total`` sent: the fair share rounded, deficits served in turn.

        Token ``j`` of a queue falls due at the share ``(j + 1/2) / T_s``. The first ``total`` tokens by due time
        (ties by queue) are sent; so each count is monotone in ``total`` and within one token or so of its share.
        """
        totals, n = self.totals, len(self.totals)
        if total <= 0:
            return np.zeros(n, dtype=np.int64)
        if total >= self.all:
            return totals.copy()
        exact = totals.astype(object) * total
        sent = np.array([int(min(t, (2 * e + self.all) // (2 * self.all))) for t, e in zip(totals, exact, strict=True)], dtype=np.int64)
        due = lambda s, j: (2 * int(j) + 1, int(totals[s]))  # the fraction (2j+1) / T_s
        while (gap := total - int(sent.sum())) != 0:
            best = None
            for s in range(n):
                j = sent[s] if gap > 0 else sent[s] - 1
                if not 0 <= j < totals[s]:
                    continue
                a, b = due(s, j)
                if best is None or (a * best[2] < best[1] * b if gap > 0 else a * best[2] >= best[1] * b):
                    best = (s, a, b)
            sent[best[0]] += 1 if gap > 0 else -1
        return sent

    def bounds(self, k: int) -> tuple[int, int]:
        """First token and length of sequence ``k``."""
        return (k * self.window, self.window) if k < self.full else self.tail[k - self.full]

    def sent(self, k: int) -> list[int]:
        """Tokens of each queue sent before sequence ``k``."""
        got = self.before.get(k)
        if got is None:
            if len(self.before) > 16_384:
                self.before.clear()
            n = self.full + len(self.tail)
            got = self.before[k] = self.sent_at(self.all if k >= n else self.bounds(k)[0]).tolist()
        return got

    def ahead(self, k: int) -> list[int]:
        """Where each queue's tokens begin in sequence ``k``, less the tokens it sent before."""
        got = self.begins.get(k)
        if got is None:
            if len(self.begins) > 16_384:
                self.begins.clear()
            got, at = [], 0
            for a, b in zip(self.sent(k), self.sent(k + 1), strict=True):
                got.append(at - a)
                at += b - a
            self.begins[k] = got
        return got

    def sequence_of(self, queue: int, token: int) -> int:
        """The sequence that holds a token of a queue."""
        low = max(0, min(self.full, int((token * self.all) // (max(1, int(self.totals[queue])) * self.window)) - 2))
        while low > 0 and self.sent(low)[queue] > token:
            low -= 1
        while self.sent(low + 1)[queue] <= token:
            low += 1
        return low

    def pieces(self, queue: int, first: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the document, length, sequence, offset) of a document whose first token is ``first``."""
        at, end = first, first + length
        k = self.sequence_of(queue, at)
        while at < end:
            upto = min(end, self.sent(k + 1)[queue])
            if upto > at:
                yield at - first, upto - at, k, at + self.ahead(k)[queue]
                at = upto
            k += 1


def as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


#: Bytes of encoded stretches that a Python worker remembers.
REMEMBERED_BYTES = 64 << 20


@functools.cache
def stretches(path: str) -> bpe.Memory:
    """Ids of stretches between white space as bytes, kept by a Python worker from task to task.

    Words are encoded by the model of the tokenizers library; splitting texts and remembering stretches is done here,
    because most stretches of a corpus recur. The memory is bounded in bytes, as workers live on.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        split = bpe.Splitter(json.load(f))
    model = Tokenizer.from_file(path).model
    word = lambda letters: [t.id for t in model.tokenize(letters)]
    return bpe.Memory(lambda chunk: as_bytes(split.encode_chunk(chunk, word)), most_bytes=REMEMBERED_BYTES)


def tokens(docs: DataFrame, path: str, end_id: int, doc_id: str, text: str, source: str) -> DataFrame:
    """(doc_id, queue, chunk, ahead, n, ids): ids as little-endian 32-bit numbers, ``end_id`` last.

    A chunk is what one task read; ``ahead`` counts the tokens of the same queue before the row in its chunk. The
    rows are written once, so that chunks keep their meaning whatever happens to executors later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = stretches(path).__getitem__
        tail = as_bytes([end_id])
        chunk = TaskContext.get().partitionId()
        ahead: dict[str | None, int] = {}
        for whole in batches:
            for some in portions(whole.column(2)):
                batch = whole.slice(some.start, some.stop - some.start)
                ids, before, n = [], [], []
                queues = batch.column(1).to_pylist()
                for queue, t in zip(queues, batch.column(2).to_pylist(), strict=True):
                    data = b"".join([*map(of, bpe.chunks(t or "")), tail])
                    ids.append(data)
                    n.append(len(data) // 4)
                    before.append(ahead.get(queue, 0))
                    ahead[queue] = before[-1] + n[-1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([chunk] * len(n), pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "queue", "chunk", "ahead", "n", "ids"],
                )

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.concat(F.lit("s:"), F.col(source).cast("string")).alias("queue"),
        F.col(text).cast("string").alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, queue string, chunk int, ahead long, n long, ids binary")


def pack(
    docs: DataFrame,
    path: str,
    window: int = 2048,
    end_id: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id lies in one piece. A null or empty text is the end id alone; a null source is a queue of its own; a row
    that occurs twice is packed twice; an empty table gives no pieces. Documents stay in the order of the input
    within their queue. Memory per task: one Arrow batch, and the totals of at most ``MAX_QUEUES`` queues.
    """
    spark = docs.sparkSession
    rows = tokens(docs, path, end_id, doc_id, text, source)
    n_sources = docs.select(F.col(source).alias("s")).distinct().limit(MAX_QUEUES + 1).count()
    if n_sources > MAX_QUEUES:
        shared = F.concat(F.lit("h:"), F.pmod(F.xxhash64(source), F.lit(MAX_QUEUES)).cast("string"))
        rows = tokens(docs.withColumn(source, shared), path, end_id, doc_id, text, source)
    rows = materialised(rows.withColumn("queue", F.coalesce("queue", F.lit("null"))), "packing-tokens")

    sums = rows.groupBy("queue", "chunk").agg(F.sum("n").alias("n"))
    queues = {r["queue"]: int(r["n"]) for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    names = sorted(queues)
    position = {q: i for i, q in enumerate(names)}
    totals = [queues[q] for q in names]
    earlier = F.sum("n").over(_by_chunk()) - F.col("n")
    offsets = sums.select(F.col("queue").alias("__q"), F.col("chunk").alias("__c"), earlier.alias("__base"))
    if sums.count() <= SMALL_OFFSETS:
        offsets = F.broadcast(offsets)
    placed = rows.join(offsets, (F.col("queue") == F.col("__q")) & (F.col("chunk") == F.col("__c"))).select(
        "doc_id", "queue", (F.col("__base") + F.col("ahead")).alias("first"), "n", "ids"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = Rounds(totals, window)
        for whole in batches:
            for some in portions(whole.column(4)):
                batch = whole.slice(some.start, some.stop - some.start)
                out = [
                    (d, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, k, offset)
                    for d, q, first, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                    for start, length, k, offset in rounds.pieces(position[q], first, n)
                ]
                columns = zip(*out, strict=True) if out else [()] * len(COLUMNS)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=COLUMNS)

    return placed.mapInArrow(cut, ", ".join(f"{c} long" for c in COLUMNS)) if names else spark.createDataFrame([], ", ".join(f"{c} long" for c in COLUMNS))


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _by_chunk():
    from pyspark.sql import Window

    return Window.partitionBy("queue").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
