"""Corpus cleaning: toxicity, quality, near duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the
shared folder and reads it again, so a lost executor costs no more than the stage at hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmeter.llm import packing, pii, quality, simhash, toxicity
from quillmeter.llm.common import materialised
from quillmeter.llm.queries import tokenizer_path
from quillmeter.session import read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def whole_rows(docs: DataFrame) -> DataFrame:
    """Each document as one struct ``doc``: it travels once, and its columns can not clash with those of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose calibrated toxicity is 0.3 or more; null texts have none."""
    model = toxicity.fit(docs, toxicity.train_labels(read_table(spark, sf_dir, "labels")))
    scored = toxicity.score(whole_rows(docs), model, "doc.text", keep=["doc"])
    return scored.where("score < 0.3").select("doc.*")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or are more likely bad than good by the votes of all rules.

    Null and empty texts fail.
    """
    facts = materialised(quality.describe(whole_rows(docs), "doc.text", keep=["doc"]), "pipeline-facts")
    return quality.judge(facts, quality.label_model(facts)).where("kept").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity of 0.8 or more."""
    return simhash.keep_one_of_each_group(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every span by its kind in brackets; ``n_chars`` follows the new text, null texts stay null."""
    found = pii.scan(whole_rows(docs), "doc.text", keep=["doc"])
    text = F.when(F.col("doc.text").isNotNull(), F.col("redacted"))
    new = {"text": text, "n_chars": F.when(text.isNotNull(), F.length(text).cast("long")).otherwise(F.col("doc.n_chars"))}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"doc.`{c}`") for c in docs.columns])


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in windows of 2048 tokens, at the corpus's own mixture of sources."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("packing", pack_windows),
]

#: The learned stages have no SQL form; tests hold each stage against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
