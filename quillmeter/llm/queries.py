"""Registered queries of the package: each applies its operator to whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmeter.llm import additive, bpe, brown, cws, licenses, merkle, packing, periodic, pii, quality, simhash, toxicity, warc
from quillmeter.session import read_table

QueryFn = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file; the files are installed beside Python on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.train_labels(read_table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "evidence",
        "n_passages",
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(read_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_documents(read_table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.compare_with_edit(read_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read_table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("matches")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(read_table(spark, sf_dir, "documents")).drop("pattern")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(read_table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read_table(spark, sf_dir, "documents"), tampered=merkle.tamper_some())


def op13_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive.rate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, QueryFn] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_warc,
        op3_brown,
        op4_fingerprints,
        op5_pii,
        op6_licenses,
        op7_quality,
        op8_bpe,
        op9_packing,
        op10_simhash,
        op11_periodic,
        op12_merkle,
        op13_additive,
    )
}

def _crc32(text: str) -> str:
    """crc32 of a text of ASCII characters in DuckDB, which has no such function: bit by bit."""
    step = "xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)"
    byte = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda s, i: {step})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {byte}), 4294967295::BIGINT)"


def _leaf(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MERKLE_SQL = f"""
    WITH RECURSIVE leaves AS (
      SELECT doc_id, coalesce('s:' || source, 'null') AS tree, {_leaf("text")} AS h,
             CASE WHEN {_crc32("doc_id::VARCHAR")} % 5 = 0 THEN {_leaf(_LOWER)} ELSE {_leaf("text")} END AS told
      FROM documents
    ),
    placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM leaves),
    nodes AS (
      SELECT tree, 0 AS level, i, h, count(*) OVER (PARTITION BY tree) AS n FROM placed
      UNION ALL
      SELECT tree, level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 15) // 16
      FROM nodes WHERE n > 1 GROUP BY tree, level, i // 16
    ),
    subroots AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i FROM nodes WHERE n = 1),
    upper_nodes AS (
      SELECT 0 AS level, i, h, count(*) OVER () AS n FROM subroots
      UNION ALL
      SELECT level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 15) // 16
      FROM upper_nodes WHERE n > 1 GROUP BY level, i // 16
    ),
    height AS (SELECT tree, max(level) AS levels FROM nodes GROUP BY tree),
    path AS (  -- siblings of a leaf, from below to the top
      SELECT p.doc_id, n.level AS step, n.i, n.i < p.i // pow(16, n.level)::BIGINT AS is_left, n.h
      FROM placed p JOIN nodes n ON n.tree = p.tree AND n.n > 1
       AND n.i // 16 = p.i // pow(16, n.level + 1)::BIGINT AND n.i <> p.i // pow(16, n.level)::BIGINT
      UNION ALL
      SELECT p.doc_id, t.levels + n.level, n.i, n.i < s.i // pow(16, n.level)::BIGINT, n.h
      FROM placed p JOIN subroots s USING (tree) JOIN height t USING (tree) JOIN upper_nodes n ON n.n > 1
       AND n.i // 16 = s.i // pow(16, n.level + 1)::BIGINT AND n.i <> s.i // pow(16, n.level)::BIGINT
    ),
    sides AS (
      SELECT doc_id, step, coalesce(string_agg(h, '' ORDER BY i) FILTER (is_left), '') AS before,
             coalesce(string_agg(h, '' ORDER BY i) FILTER (NOT is_left), '') AS behind
      FROM path GROUP BY doc_id, step
    ),
    total AS (SELECT t.tree, t.levels + (SELECT max(level) FROM upper_nodes) AS steps FROM height t),
    folds AS (
      SELECT doc_id, tree, 0 AS step, told AS h FROM placed
      UNION ALL
      SELECT f.doc_id, f.tree, f.step + 1, sha256(coalesce(s.before, '') || f.h || coalesce(s.behind, ''))
      FROM folds f JOIN total t ON t.tree = f.tree AND f.step < t.steps LEFT JOIN sides s ON s.doc_id = f.doc_id AND s.step = f.step
    ),
    proofs AS (SELECT doc_id, sha256(string_agg(h, '' ORDER BY step, i)) AS proof FROM path GROUP BY doc_id)
    SELECT p.doc_id, p.h AS leaf, s.h AS subroot, r.h AS root, coalesce(q.proof, sha256('')) AS proof_sha256,
           f.h AS folded_root, f.h = r.h AS verified
    FROM placed p JOIN subroots s USING (tree) JOIN total t USING (tree)
    JOIN (SELECT h FROM upper_nodes WHERE n = 1) r ON true
    JOIN folds f ON f.doc_id = p.doc_id AND f.step = t.steps LEFT JOIN proofs q ON q.doc_id = p.doc_id
"""


ORACLES: dict[str, str] = {
    "op12_merkle": MERKLE_SQL,
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS digest FROM p),
        g AS (SELECT digest, max(page_id) AS target FROM d WHERE n >= 1000 GROUP BY digest)
        SELECT d.page_id, d.n AS payload_bytes, d.digest AS payload_digest,
               CASE WHEN d.page_id <> g.target THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN d.page_id <> g.target THEN g.target END AS refers_to
        FROM d LEFT JOIN g ON d.digest = g.digest AND d.n >= 1000
    """,
}
