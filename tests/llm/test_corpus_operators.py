"""Archives, language scores, fingerprints, packing, near duplicates, pipeline: each against plain Python."""

import collections
import hashlib
import math
import random
import struct
import zlib

import corpus_pipeline
import pytest
import xxhash
from plain_rules import ODD, base_spans, words
from pyspark.sql import functions as F

from quillmeter.llm import brown, bpe, cws, packing, simhash, warc
from quillmeter.llm.components import components
from quillmeter.llm.queries import tokenizer_path

# --- archives -----------------------------------------------------------------------------------------------------------


def test_records_survive_the_round_trip(spark):
    big = "x" * 1200
    rows = [(1, "u", big), (5, None, big), (3, "a\nb", big), (5, None, big), (7, "s", "tiny"), (8, "s", "tiny"), (None, "n", big)]
    rows += [(9, "z", None), (10, "é", "é" * 600), (11, "é", "é" * 600), (None, "q", "y" * 2000), (None, "q", "y" * 2000)]
    pages = spark.createDataFrame([(*r, "?") for r in rows], "page_id long, url string, html string, digest string")
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    want = collections.Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        group = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        target = max(group) if group and len(data) >= 1000 else page
        refers = None if page == target else target
        want[page, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers] += 1
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_index_addresses_single_records(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/archives"
    index = warc.write(pages, folder)
    picked = warc.read(index.where("page_id % 7 = 3"), folder).orderBy("page_id").collect()
    assert [r.page_id for r in picked] == list(range(3, 40, 7))
    assert all(bytes(r.payload).decode() == f"page {r.page_id} " * 50 and r.url == f"http://h/{r.page_id}" for r in picked)
    row = index.first()
    data = (tmp_path / "archives" / row.file).read_bytes()[row.offset : row.offset + row.length]
    assert zlib.decompress(data, 31).startswith(b"WARC/1.1\r\n")


# --- language scores ----------------------------------------------------------------------------------------------------------


def test_base_scores_and_gain(documents, odd_docs):
    for docs in (documents, odd_docs):
        rows = docs.select("doc_id", "text").collect()
        held = {r.doc_id: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows}
        counts = collections.Counter(w for r in rows if not held[r.doc_id] for w in [*words(r.text), " "])
        n, v = sum(counts.values()), len(counts)
        want = collections.Counter()
        for r in rows:
            ws = [*words(r.text), " "]
            base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
            want[r.doc_id, held[r.doc_id], len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 4)] += 1
        out = brown.score_documents(docs).collect()
        got = collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out)
        assert got == want
        assert all(math.isfinite(r.score) and r.score <= 0 for r in out)
    assert brown.score_documents(odd_docs.limit(0)).count() == 0


def test_classes_beat_single_words_and_sum_to_one(spark, make_docs):
    rng = random.Random(8)
    kinds = [[a + b for a in x for b in "aeiou"] for x in ("bcd", "fgh", "klm")]
    texts = [" ".join(rng.choice(kinds[i % 3]) for i in range(60)) for _ in range(200)]
    docs = make_docs(texts)
    out = brown.score_documents(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert out.s > out.b + 0.3 * 60
    training = docs.where(~brown.held_out())
    counts = brown.word_counts(training)
    model = brown.fit(training, counts)
    shares = {bytes(r.word): r.n for r in counts.collect()}
    for before in range(0, model.lift.shape[0], 7):
        total = 10 ** float(model.log_share(0))
        for w, n in shares.items():
            total += 10 ** (float(model.log_share(n)) + model.lift[before, model.classes[model.units.of(w)]])
        assert total == pytest.approx(1.0, abs=1e-6)


# --- fingerprints -------------------------------------------------------------------------------------------------------------


def test_fingerprints_estimate_weighted_likeness(documents):
    rows = {r.doc_id: r.text for r in documents.collect()}
    ids = sorted(rows)
    got = {r.doc_id: r for r in cws.compare_with_edit(documents).collect()}
    assert sorted(got) == ids

    def likeness(a, b):
        a, b = (collections.Counter(t.lower().encode().split()) for t in (a, b))
        return sum((a & b).values()) / max(1, sum((a | b).values()))

    errors = []
    for i, d in enumerate(ids):
        text, after = rows[d], rows[ids[(i + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[d].n_chars == len(text) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors.append(got[d].near_edited - likeness(text, edited))
    assert abs(sum(errors) / len(errors)) < 0.03
    assert sum(e * e for e in errors) / len(errors) < 0.012
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.95 * len(got)


def test_fingerprints_of_odd_rows(make_docs, odd_docs):
    out = cws.compare_with_edit(odd_docs).collect()
    assert len(out) == len(ODD) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert {r.fingerprint for r in out if r.doc_id in (1, 2, 3, 11)} == {""}
    one = cws.compare_with_edit(make_docs(["a b c"])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a ba ").hexdigest()
    same = cws.compare_with_edit(make_docs(["x y z", "x y z", "q"])).orderBy("doc_id").collect()
    assert same[0].fingerprint == same[1].fingerprint and same[0].near_next == 1.0
    assert cws.compare_with_edit(odd_docs.limit(0)).count() == 0


def test_neighbours_across_ranges(make_docs, monkeypatch):
    monkeypatch.setattr(cws, "RANGE_ROWS", 3)
    ids = [0, 1, 2, 50, 51, 10**12, 10**12 + 1, -5, 77, 78, 79]
    texts = [f"text {i} end{i}" for i in ids]
    out = {r.doc_id: r.edited_sha256 for r in cws.compare_with_edit(make_docs(texts, ids)).collect()}
    order = sorted(ids)
    for i, d in enumerate(order):
        text, after = f"text {d} end{d}", f"text {order[(i + 1) % len(ids)]} end{order[(i + 1) % len(ids)]}"
        half = len(text) // 2
        assert out[d] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()


# --- packing -----------------------------------------------------------------------------------------------------------------


def check_packing(docs, window=2048):
    encode = bpe.encoder(tokenizer_path())
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append([*encode(r.text or ""), 1])
    rows = packing.pack(docs, tokenizer_path(), window).collect()
    sequences, total = collections.defaultdict(list), 0
    for r in rows:
        candidates = [ids for ids in texts[r.doc_id] if len(ids) == r.doc_tokens]
        piece = [zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])) for ids in candidates]
        assert r.ids_crc32 in piece and r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        total += r.length
    assert total == sum(len(i) for group in texts.values() for i in group)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == window or at < window and at & (at - 1) == 0
    return rows


def test_packing_places_every_token_once(documents, odd_docs):
    rows = check_packing(documents)
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.length, r.doc_tokens))
    for pieces in by_doc.values():
        at = 0
        for start, length, tokens in sorted(pieces):
            assert start == at
            at += length
        assert at == tokens
    check_packing(odd_docs, 64)
    assert packing.pack(odd_docs.limit(0), tokenizer_path()).count() == 0


def test_windows_hold_the_mixture():
    rng = random.Random(9)
    for _ in range(60):
        totals = [rng.choice([rng.randint(1, 50), rng.randint(1, 3000)]) for _ in range(rng.randint(1, 12))]
        rounds = packing.Rounds(totals, rng.choice([16, 64, 2048]))
        for k in range(1, rounds.full):
            sent = rounds.sent(k)
            assert sum(sent) == k * rounds.window
            assert all(a <= b for a, b in zip(rounds.sent(k - 1), sent, strict=True))
            assert all(abs(s - t * k * rounds.window / sum(totals)) <= len(totals) for s, t in zip(sent, totals, strict=True))


def test_many_sources_share_queues(make_docs, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 3)
    check_packing(make_docs([f"some text {i}" for i in range(12)], sources=[f"s{i}" for i in range(12)]), 16)


# --- near duplicates -----------------------------------------------------------------------------------------------------------


def plain_print(text):
    ws = words(text)
    grams = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, differing=2):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(root)
    for i, a in enumerate(order):
        for b in order[:i]:
            if (a ^ b).bit_count() <= differing:
                root[find(a)] = find(b)
    return {p: find(p) for p in order}


def check_clusters(rows, got):
    roots = plain_components({p for _, p in rows})
    least = {}
    for i, p in rows:
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    assert got == collections.Counter((i, p, least.get(roots[p])) for i, p in rows)


def test_near_duplicates_match_brute_force(documents, odd_docs):
    for docs in (documents.where("n_chars < 2500"), odd_docs.where("length(text) < 1000 OR text IS NULL")):
        rows = [(r.doc_id, plain_print(r.text)) for r in docs.collect()]
        out = simhash.near_duplicates(docs).collect()
        check_clusters(rows, collections.Counter((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in out))
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [3, 200])
def test_large_buckets_lose_no_link(spark, monkeypatch, bound):
    monkeypatch.setattr(simhash, "LARGE_BUCKET", bound)
    rng = random.Random(10)
    values = [rng.getrandbits(64) for _ in range(100)]
    for _ in range(8):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            values.append(x)
    rows = [(i, v) for i, v in enumerate(values)]
    table = spark.createDataFrame([(i, v - (v >> 63 << 64)) for i, v in rows], "id long, fp long")
    got = collections.Counter((r.id, r.fp % (1 << 64), r.component_id) for r in simhash.cluster(table, "id").collect())
    check_clusters(rows, got)


def test_thresholds_sum_as_the_pigeonhole_needs():
    import numpy as np

    values = np.array([random.Random(11).getrandbits(63) for _ in range(50)], dtype=np.int64)
    for parts in (2, 3):
        groups = [list(range(p, 64, parts)) for p in range(parts)]
        histograms = np.ones(256 * len(simhash.pieces_of(groups)))
        dealt = simhash.Allocation(groups, histograms, 50, 2).thresholds(values)
        assert (dealt.sum(axis=1) == 2 - parts + 1).all() and (dealt >= -1).all()


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# --- pipeline --------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(800)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    texts = [prose(120) for _ in range(60)]
    near = texts[0].split(" ")
    near[50] = "changed"
    texts += [texts[1], " ".join(near), None, "", prose(100) + " write to some.one@mail.example.com or 10.0.0.1 today."]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long"), texts


def test_stages_keep_columns_and_rows(spark, planted, small_dir):
    docs, texts = planted
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality", "near_duplicates", "personal_data", "packing"]
    for name in list(stages)[:-1]:
        out = stages[name](spark, docs, small_dir)
        assert out.dtypes == docs.dtypes
        assert stages[name](spark, docs.limit(0), small_dir).count() == 0
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(stages["toxicity"](spark, docs, small_dir)) == list(range(len(texts)))
    assert ids(stages["quality"](spark, docs, small_dir)) == [i for i, t in enumerate(texts) if t]
    kept = ids(stages["near_duplicates"](spark, docs, small_dir))
    assert len(set(kept) & {0, 61}) == 1 and len(set(kept) & {1, 60}) == 1 and len(set(kept) & {62, 63}) == 1
    assert set(range(2, 60)) <= set(kept) and 64 in kept
    masked = {r.doc_id: r for r in stages["personal_data"](spark, docs, small_dir).collect()}
    assert "[EMAIL]" in masked[64].text and "[IP]" in masked[64].text and not base_spans(masked[64].text)
    assert masked[64].n_chars == len(masked[64].text) and masked[62].text is None and masked[3].text == texts[3]


def test_run_packs_what_the_stages_kept(spark, small_dir):
    out = corpus_pipeline.run(spark, small_dir)
    assert out.columns == packing.COLUMNS
    pieces = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r.n == 2048 or r.n & (r.n - 1) == 0 for r in pieces) and pieces


def star(n_words=400, copies=12, changes=7):
    """Independent copies of one text, which stands last: each is like it, no two are like each other."""
    rng = random.Random(11)
    centre = [f"w{rng.randrange(10**6)}" for _ in range(n_words)]
    out = []
    for c in range(copies):
        copy = list(centre)
        for k in range(changes):
            copy[(c * 4 + k * (n_words // changes)) % n_words] = f"x{c}-{k}"
        out.append(" ".join(copy))
    return [*out, " ".join(centre)]


def test_star_around_a_later_text_is_one_group(make_docs):
    texts = star()
    like = [[simhash.similar(a, b, 5) for b in texts] for a in texts]
    assert min(like[-1]) >= 0.8 and max(like[i][j] for i in range(12) for j in range(i)) < 0.8
    kept = simhash.keep_one_of_each_group(make_docs(texts).coalesce(1), differing=0).collect()
    assert [r.doc_id for r in kept] == [0]


@pytest.mark.parametrize("texts_in_block", [1, 3, 32])
def test_all_texts_of_a_bucket_are_compared(spark, make_docs, monkeypatch, texts_in_block):
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", texts_in_block)
    rng = random.Random(5)
    letters = "abcdefghij"
    texts = ["".join(rng.choice(letters) + " " for _ in range(rng.randint(5, 8))) for _ in range(12)]
    texts += [t + rng.choice(letters) for t in texts for _ in range(3)] + ["", " "]
    rows = make_docs(texts).select(F.col("doc_id").alias("row"), F.col("text").alias("body"))
    nodes = rows.select(F.col("row").alias("node"), F.array(F.lit(1).cast("long")).alias("samples"))
    roots = {r.node: r.root for r in components(simhash._compared(rows, nodes, 1, 0.8), "a", "b").collect()}
    best = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(texts):
            for j, b in enumerate(texts):
                if simhash.similar(a, b, 1) >= 0.8:
                    best[i] = best[j] = min(best[i], best[j])
    assert len(set(best)) > 4 and [roots.get(i, i) for i in range(len(texts))] == best


def test_close_fingerprints_alone_make_no_copy(make_docs):
    passage = "one two three four five six seven " * 60
    texts = [passage + " ".join(f"{name}{i}" for i in range(20)) for name in "abc"]
    prints = {simhash.majority(simhash.shingle_hashes(t, 5)) for t in texts}
    assert len(prints) == 1 and simhash.similar(texts[0], texts[1], 5) < 0.5
    assert simhash.keep_one_of_each_group(make_docs([*texts, texts[0]])).count() == 3
