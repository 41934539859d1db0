import pytest
from plain_rules import CLASHES, ODD, ODD_IDS
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet")


@pytest.fixture
def make_docs(spark):
    def make(texts, ids=None, sources=None, clash=False):
        ids = list(range(len(texts))) if ids is None else ids
        sources = ["s"] * len(texts) if sources is None else sources
        rows = [(i, t, None, s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources, strict=True)]
        df = spark.createDataFrame(rows, DOCS)
        for name in CLASHES if clash else ():
            df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make


@pytest.fixture
def odd_docs(make_docs):
    return make_docs(ODD, ODD_IDS, [None if i % 4 == 0 else "s" for i in range(len(ODD))], clash=True)
