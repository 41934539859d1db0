"""Sources (survey group A): HTML trees, JSON webhooks, recognition responses, sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmeter.functions.lexicons import SKIPPED_FOLDERS

WEBHOOK = (
    "event string, payload struct<"
    "payment:struct<entity:struct<id:string,amount:bigint,currency:string,error_description:string,"
    "notes:struct<userId:string,plan:string>>>,"
    "subscription:struct<entity:struct<customer_id:string,customer_email:string,end_at:bigint>>>"
)
OCR_BLOCKS = (
    "doc_id bigint, Blocks array<struct<Id:string,BlockType:string,RowIndex:int,ColumnIndex:int,Text:string,"
    "Relationships:array<struct<Type:string,Ids:array<string>>>>>"
)


def outside_folders(path: str | Column, skip: Sequence[str] = SKIPPED_FOLDERS) -> Column:
    """A1: no folder of the path is on the skip list or a virtual environment."""
    p = F.col(path) if isinstance(path, str) else path
    folders = F.slice(F.split(p, "/"), F.lit(1), F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0)))
    return ~F.exists(folders, lambda f: f.isin(*skip) | f.rlike(r"^(\.venv|venv|env)"))


def html_tree(spark: SparkSession, root: str, skip: Sequence[str] = SKIPPED_FOLDERS) -> DataFrame:
    """A1: every HTML file below ``root`` as (url, html), listed folders left out."""
    files = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").text(root, wholetext=True)
    )
    rel = F.substr(F.col("_metadata.file_path"), F.instr(F.col("_metadata.file_path"), root.rstrip("/")) + len(root.rstrip("/")))
    return files.select(rel.alias("url"), F.col("value").alias("html")).where(outside_folders("url", skip))


def by_key(table: DataFrame, **equals: object) -> DataFrame:
    """A2: rows by key; the predicates reach the Parquet scan."""
    for name, value in equals.items():
        table = table.where(F.col(name) == F.lit(value))
    return table


def parse_webhooks(raw: DataFrame, body: str = "body") -> DataFrame:
    """JSON bodies (batch or stream) into typed columns; a body that is no JSON gives nulls.

    Payments name the user in their notes; subscriptions name an e-mail address, whose owner at that time is found
    by ``subscriptions.with_owners``.
    """
    p = F.from_json(F.col(body), WEBHOOK)
    pay, sub = p["payload"]["payment"]["entity"], p["payload"]["subscription"]["entity"]
    return raw.withColumns(
        {
            "event": p["event"], "payment_id": pay["id"], "amount": pay["amount"], "currency": pay["currency"],
            "user_id": pay["notes"]["userId"].try_cast("long"), "email": sub["customer_email"], "plan": pay["notes"]["plan"],
            "end_at": F.timestamp_seconds(sub["end_at"]).cast("timestamp_ntz"),
        }
    ).drop(body)


def webhook_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """JSON lines (event_id, ts, body) arriving in a folder."""
    return parse_webhooks(
        spark.readStream.schema("event_id long, ts timestamp_ntz, body string").option("maxFilesPerTrigger", files_per_batch).json(folder)
    )


def explode_blocks(responses: DataFrame) -> DataFrame:
    """Recognition responses (doc_id, Blocks) as one row per block with its child ids."""
    b = responses.select("doc_id", F.explode("Blocks").alias("b"))
    children = F.flatten(F.transform(F.filter("b.Relationships", lambda r: r["Type"] == "CHILD"), lambda r: r["Ids"]))
    return b.select(
        "doc_id", F.col("b.Id").alias("id"), F.col("b.BlockType").alias("block_type"), F.col("b.RowIndex").alias("row_index"),
        F.col("b.ColumnIndex").alias("column_index"), F.col("b.Text").alias("text"), children.alias("children"),
    )


def ocr_responses(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines files of responses with the declared schema (no inference pass)."""
    return explode_blocks(spark.read.schema(OCR_BLOCKS).json(path))


def sheet_cells(wide: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A wide sheet as (keys, col, value) rows in one pass."""
    values = F.array(*[F.col(c).cast("string") for c in columns])
    return wide.select(*keys, F.posexplode(values).alias("col", "value"))


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table (one file or a folder of files) read as a stream of files."""
    path = f"{folder}/{name}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(jpath).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.parquet(path) if is_folder else reader.option("pathGlobFilter", name).parquet(folder)
