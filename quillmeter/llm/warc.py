"""Web archives with an index: written once, read back by coalesced byte ranges.

Every task writes archives of its own (one gzip member per record) to the shared folder and returns index rows:
file, offset, length, URL, digest. Only the rows of attempts that Spark committed are kept, so files of lost or
repeated attempts are never read. Reading sorts the selected index rows by file and offset, joins neighbouring
ranges into large reads, and parses the records from them.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.llm.common import materialised, shared_folder

LEAST_REVISIT = 1000
ARCHIVE_BYTES = 256 << 20
#: Ranges at most this far apart are read together, in reads of at most about this size.
GAP, READ = 64 << 10, 8 << 20
#: Archive bytes that a reading task takes.
TASK_BYTES = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, page_id long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP header, which states the payload's length, and no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _headers(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = (line.partition(": ") for line in head.decode().split("\r\n")[1:])
    return {k.lower(): v for k, _, v in fields}, rest


def parse(data: bytes) -> dict:
    """The record's fields; the payload of a revisit is null. A response whose payload lost its digest fails."""
    fields, rest = _headers(data)
    block = rest[: int(fields["content-length"])]
    http, payload = _headers(block)
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = fields["warc-type"] == "revisit"
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"record {fields['warc-record-id']}: the payload does not have its digest")
    return {
        "page_id": _page(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": int(http["content-length"]),
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": _page(fields["warc-refers-to"]) if revisit else None,
        "payload": None if revisit else payload,
    }


def with_targets(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """(page_id, url, html, digest, refers_to): which page a revisit refers to, null for responses.

    Of equal payloads of at least LEAST_REVISIT bytes the row with the largest page id is the response. Rows that tie
    for it (repeated rows) are all responses, as are groups without any id. Only groups of two or more rows are
    joined; the pages of a large group are a hot key of a join, which Spark splits.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html")
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    long = F.octet_length("html") >= LEAST_REVISIT
    groups = rows.where(long).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("target"))
    groups = materialised(groups.where("n > 1 AND target IS NOT NULL").select(F.col("digest").alias("key"), "target"), "warc-groups")
    joined = rows.join(groups, (F.col("digest") == F.col("key")) & long, "left")
    own = F.col("page_id").eqNullSafe(F.col("target"))
    return joined.select("page_id", "url", "html", "digest", F.when(~own, F.col("target")).alias("refers_to"))


def write(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z"
) -> DataFrame:
    """Write a record per page and return the index, itself written to the shared folder.

    A null payload is empty; a null URL leaves its header out; a null id has an empty name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        stem = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, name, at, number = None, "", 0, 0
        try:
            for batch in batches:
                index: list[tuple] = []
                for p, u, h, d, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at, number = f"{stem}-{number}.warc.gz", 0, number + 1
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = pack.compress(record(p, u, h.encode(), d, target, date)) + pack.flush()
                    out.write(member)
                    index.append((name, at, len(member), u, d, p))
                    at += len(member)
                columns = zip(*index, strict=True) if index else [()] * 6
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["file", "offset", "length", "url", "digest", "page_id"],
                )
        finally:
            if out is not None:
                out.close()

    return materialised(with_targets(pages, page_id, url, html).mapInArrow(run, INDEX), "warc-index")


def read(selected: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records that index rows name. Rows are dealt by ranges of file and offset, then read in that order."""

    def fetch(fs: pafs.FileSystem, root: str, name: str, ranges: list[tuple[int, int]]) -> Iterator[dict]:
        with fs.open_input_file(f"{root}/{name}") as f:
            start = ranges[0][0]
            data = f.read_at(ranges[-1][0] + ranges[-1][1] - start, start)
        for offset, length in ranges:
            yield parse(zlib.decompress(data[offset - start : offset - start + length], 31))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        name, ranges = "", []

        def flush() -> Iterator[pa.RecordBatch]:
            if ranges:
                rows = list(fetch(fs, root, name, ranges))
                if not payload:
                    for r in rows:
                        r["payload"] = None
                yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

        for batch in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                near = ranges and file == name and offset - sum(ranges[-1]) <= GAP and offset + length - ranges[0][0] <= READ
                if not near:
                    yield from flush()
                    name, ranges = file, []
                ranges.append((offset, length))
        yield from flush()

    total = selected.agg(F.sum("length").alias("n")).first()["n"] or 0
    n_tasks = 1 + total // TASK_BYTES
    ordered = selected.select("file", "offset", "length").repartitionByRange(n_tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, RECORD)


SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive all pages and read every record back."""
    folder = shared_folder(pages.sparkSession, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read(write(pages, folder), folder, payload=False)
