"""Periodic runs, Merkle manifests and the additive quality model against plain versions of their rules."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from plain_rules import ASCII, ODD
from pyspark.sql import functions as F

from quillmeter.llm import additive, merkle, periodic

# --- runs ------------------------------------------------------------------------------------------------------------


def plain_runs(words, least=24):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((low, high - low, q) for (low, high), q in found.items())


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def made_up_words(rng):
    words = []
    while rng.random() < 0.8:
        period = [rng.choice(b"abcd"[: rng.randint(1, 4)].decode()).encode() for _ in range(rng.randint(1, 40))]
        words += (period * rng.randint(1, 6))[: rng.randint(1, 150)]
    return words


@pytest.mark.parametrize("least", [3, 6, 24])
def test_runs_of_made_up_texts(least):
    rng = random.Random(least)
    for _ in range(60):
        texts = [made_up_words(rng) for _ in range(rng.randint(0, 5))]
        assert periodic.runs_of_texts(texts, least) == [plain_runs(t, least) for t in texts]


def test_sums_are_exact_for_large_numbers():
    rng = np.random.default_rng(3)
    ids = np.concatenate([np.tile(rng.integers(1, 2**40, 64), 6), np.zeros(400, dtype=np.int64)])
    found = list(periodic.occurrences(ids, np.array([0, 64, 128]), 64, periodic.Transforms()))
    assert found == [(0, 64), (64, 64), (128, 64)]
    assert periodic.digit_bits(40, 64) < 40


def test_one_word_many_times_is_searched_once():
    assert periodic.runs_of_texts([[b"word"] * 200_000, [b"x"]], 24) == [[(0, 200_000, 1)], []]


def plain_digest(doc_id, text):
    words = plain_words(text)
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_periodic_digest(make_docs):
    rng = random.Random(5)
    texts = [" ".join(w.decode() for w in made_up_words(rng)) for _ in range(60)] + [t for t in ODD if t is None or len(t) < 1000]
    ids = [*range(len(texts) - 1), None]
    got = [tuple(r) for r in periodic.digest(make_docs(texts, ids)).collect()]
    assert sorted(got, key=str) == sorted((plain_digest(i, t) for i, t in zip(ids, texts, strict=True)), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids) >= 5


def test_periodic_odd_rows(odd_docs, make_docs):
    found = periodic.find_runs(odd_docs, keep=odd_docs.columns).collect()
    assert len(found) == len(ODD) and {"score", "key"} <= set(found[0].asDict())
    assert sorted(r["n_words"] for r in found) == sorted(len(plain_words(t)) for t in ODD)
    assert periodic.digest(make_docs([])).collect() == []


def test_whole_table_of_periodic_documents(spark, documents):
    got = {r["doc_id"]: tuple(r) for r in periodic.digest(documents).collect()}
    some = [r for r in documents.collect() if len(plain_words(r["text"])) < 600]
    assert len(some) > 100 and all(got[r["doc_id"]] == plain_digest(r["doc_id"], r["text"]) for r in some)


# --- Merkle manifest -------------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        low = i // 16 * 16
        out.append(("".join(level[low:i]), "".join(level[i + 1 : low + 16])))
        i //= 16
    return out


def plain_manifest(rows):
    """``rows``: (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(field, r)))
    trees = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf(r))):
        trees.setdefault(r[1], []).append(r)
    levels = {s: plain_tree([leaf(r) for r in rs]) for s, rs in trees.items()}
    top = plain_tree([levels[s][-1][0] for s in trees])
    out = []
    for k, (s, rs) in enumerate(trees.items()):
        for i, r in enumerate(rs):
            path = plain_path(levels[s], i) + plain_path(top, k)
            folded = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                folded = leaf((*r[:4], r[4].translate(ASCII)))
            for before, behind in path:
                folded = sha(before + folded + behind)
            proof = sha("".join(a + b for a, b in path))
            out.append((r[0], leaf(r), levels[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows(docs):
    return sorted((tuple(r) for r in merkle.manifest(docs, tampered=merkle.tamper_some()).collect()), key=str)


@pytest.mark.parametrize("shape", ["mixed", "one leaf", "hot source", "many sources"])
def test_manifest(make_docs, shape, monkeypatch):
    n = {"mixed": 40, "one leaf": 1, "hot source": 700, "many sources": 330}[shape]
    source = {
        "mixed": lambda i: [None, "a", "ä", "b", "Z"][i * i % 5],
        "one leaf": lambda i: None,
        "hot source": lambda i: "hot" if i % 3 else f"s{i % 7}",
        "many sources": lambda i: f"s{i}",
    }[shape]
    texts = [None if i % 11 == 3 else f"Text {i} É" if i % 2 else f"low {i}" for i in range(n)]
    ids = [None if i == 17 else (n - i) * 3 for i in range(n)]
    docs = make_docs(texts, ids, [source(i) for i in range(n)])
    want = plain_manifest([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()])
    assert manifest_rows(docs.repartition(5)) == want


def test_manifest_of_odd_rows(odd_docs, make_docs):
    want = plain_manifest([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in odd_docs.collect()])
    assert manifest_rows(odd_docs) == want
    assert merkle.manifest(make_docs([])).collect() == []
    twice = manifest_rows(make_docs(["A", "A", "A"], [5, 5, 5]))
    assert len({r[1] for r in twice}) == 1 and len(twice) == 3


def test_a_partition_fetches_each_missing_node_once():
    rng = random.Random(2)
    for size in (1, 2, 16, 17, 300, 5000):
        places = sorted(rng.sample(range(size), min(size, 40)))
        levels = plain_tree([sha(str(i)) for i in range(size)])
        asked = merkle.missing(places, size)
        assert len(asked) == len(set(asked))
        known = {(level, i // 16**level) for i in places for level in range(len(levels))}
        assert not known & set(asked)
        shared = merkle.SharedNodes(size, {(level, i): levels[level][i] for level, i in asked} | {(0, i): levels[0][i] for i in places})
        shared.derive(places)
        for i in places:
            assert [("".join(a), "".join(b)) for a, b in shared.siblings(i)] == plain_path(levels, i)
            assert merkle.fold(levels[0][i], shared.siblings(i)) == levels[-1][0]


def test_columns_of_other_names(spark):
    docs = spark.createDataFrame([(1, "a", "T"), (2, "b", "U")], "`key.id` long, place string, body string")
    got = merkle.manifest(docs, "key.id", "place", ("key.id", "body"), "body", F.lit(True)).collect()
    assert [r["verified"] for r in got] == [False, False]


# --- additive model --------------------------------------------------------------------------------------------------


def test_tables_learn_single_properties_and_a_pair():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 4))
    odds = 3 * np.sin(3 * x[:, 0]) + 5 * (x[:, 1] > 0) * (x[:, 2] > 0) - 1
    y = (rng.uniform(size=4000) < 1 / (1 + np.exp(-odds))).astype(float)
    model = additive.train(x[:3000], y[:3000], n_pairs=3)
    assert (1, 2) in model.pairs
    bare = additive.AdditiveModel(model.intercept, model.cuts, model.tables)
    loss = lambda m: additive._loss(y[3000:], m.log_odds(x[3000:]))
    best = additive._loss(y[3000:], odds[3000:])
    assert loss(model) < loss(bare) and loss(model) < best + 0.06
    assert np.std(model.tables[3]) < 0.3 < np.std(model.tables[0])
    assert np.corrcoef(model.tables[0][model.bins(x)[:, 0]], np.sin(3 * x[:, 0]))[0, 1] > 0.95


def test_score_is_the_sum_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, (500, 3)).astype(float)
    model = additive.train(x, (x[:, 0] > x[:, 1]).astype(float), n_pairs=2)
    for row in x[:50]:
        codes = [int(np.sum(row[i] > c)) for i, c in enumerate(model.cuts)]
        total = model.intercept + sum(t[codes[i]] for i, t in enumerate(model.tables))
        total += sum(t[codes[i], codes[j]] for (i, j), t in model.pairs.items())
        assert model.log_odds(row[None])[0] == pytest.approx(total)


def plain_steps(g, w, ridge):
    """Best single split, tried one by one."""
    value = lambda a, b: sum(g[a:b]) ** 2 / (sum(w[a:b]) + ridge)
    return max(range(1, len(g)), key=lambda k: value(0, k) + value(k, len(g)))


def test_a_tree_of_two_leaves_is_the_best_split():
    rng = np.random.default_rng(4)
    for _ in range(50):
        g, w = rng.normal(size=9), rng.uniform(0.6, 2, 9)
        steps = additive.tree_steps(g, w, 2, 1.0, 0.5)
        cuts = [k for k in range(1, 9) if steps[k] != steps[k - 1]]
        assert cuts == [plain_steps(g, w, 1.0)]
        assert steps[0] == pytest.approx(g[: cuts[0]].sum() / (w[: cuts[0]].sum() + 1))


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = additive.rate(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    bad = [r["predicted"] for r in rows if r["quality"] == 0]
    assert len(good) > 500 and len(bad) > 80
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1


def test_quality_of_odd_rows(spark, odd_docs, make_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rows = additive.rate(odd_docs, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    by_text = {}
    for r, t in zip(additive.score(odd_docs, additive.fit(odd_docs, labels), keep=["text"]).collect(), ODD, strict=True):
        by_text.setdefault((t or "").strip(), set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())
    none = labels.where("false")
    assert {r["score"] for r in additive.rate(odd_docs, none).collect()} == {0.5}
    assert additive.rate(make_docs([]), labels).collect() == []
