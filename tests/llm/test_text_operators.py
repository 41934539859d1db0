"""Toxicity, personal data, licences, quality, encoding: each against plain Python."""

import hashlib
import random
import re

import pytest
from plain_rules import ODD, base_spans, lower

from quillmeter.llm import bpe, licenses, pii, quality, toxicity
from quillmeter.llm.queries import tokenizer_path


# --- toxicity ---------------------------------------------------------------------------------------------------------


def brute_segments(scores):
    """All maximal-scoring segments: the best one, then those of the parts beside it."""

    def best(a, b):
        top = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-9 and (top is None or total > top[2] + 1e-9):
                    top = (i, j + 1, total)
        return [] if top is None else best(a, top[0]) + [top] + best(top[1], b)

    return best(0, len(scores))


def test_segments_match_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 25)
        positive = [(i, rng.uniform(0.2, 2.5)) for i in range(n) if rng.random() < 0.4]
        scores = [-0.25] * n
        for i, s in positive:
            scores[i] = s
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(positive, 0.25)]
        want = [(a, b, round(s, 6)) for a, b, s in brute_segments(scores)]
        assert got == want


def test_toxicity_learns_words_and_leaves_clean_texts(spark, make_docs, odd_docs):
    rng = random.Random(2)
    words = [a + b for a in "bcdfgklm" for b in ("ala", "oro", "imi", "utu")]
    texts, labels = [], []
    for i in range(400):
        body = [rng.choice(words) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                body.insert(rng.randrange(len(body)), rng.choice(["scumbag", "vermin"]))
        texts.append(" ".join(body))
        labels.append((i, i % 4 == 0))
    docs = make_docs(texts)
    table = spark.createDataFrame([(i, int(t)) for i, t in labels] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, toxicity.train_labels(table))
    held = {r.doc_id: r.score for r in toxicity.score(docs, model).where(toxicity.held_out()).collect()}
    assert len(held) > 50
    assert all((held[i] >= 0.3) == t for i, t in labels if i in held)
    odd = toxicity.score(odd_docs, model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score < 0.3 and r.n_passages == 0 for r in odd)


def test_toxicity_without_examples(spark, make_docs):
    docs, empty = make_docs(["a b", None]), spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, empty)
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model).count() == 0


# --- personal data ------------------------------------------------------------------------------------------------------


def test_base_spans_equal_the_patterns():
    rng, automaton = random.Random(5), pii.anchors()
    alphabets = ["ab1.@-+ ", "0123456789.- +()", "1@.a-", "12.", "19 -+4(). ", "é0+1 -9"]
    for _ in range(20_000):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 40)))
        got = [s for s in pii.find(text, automaton) if s[2] in pii.BASE_KINDS]
        assert got == base_spans(text), text


def test_cues_and_redaction():
    text = 'mail a.b@x.example, see https://x.example/a?b=1. token = "0123456789abcdef0123", account: 1234 5678 90'
    spans = pii.find(text, pii.anchors())
    assert [k for _, _, k in spans] == ["email", "url", "secret", "account"]
    assert pii.redacted(text, spans) == 'mail [EMAIL], see [URL]. token = "[SECRET]", account: [ACCOUNT]'
    assert pii.find("tokenised accountant 12345678", pii.anchors()) == []


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("IBAN GB82 WEST 1234 5698 7654 32 and more", ["GB82 WEST 1234 5698 7654 32"]),
        ("iban: DE89370400440532013000.", ["DE89370400440532013000"]),
        ("IBAN DE89 3704 0044 0532 0130 00 12", ["DE89 3704 0044 0532 0130 00"]),
        ("account 2024-01-01 00 11", []),
        ("Account: 01.02.2024 1234", []),
        ("account 12345678", ["12345678"]),
    ],
)
def test_accounts(text, kinds):
    assert [text[a:b] for a, b, k in pii.find(text, pii.anchors()) if k == "account"] == kinds


def test_check_digits_of_accounts():
    assert pii.iban_ok("GB82WEST12345698765432") and not pii.iban_ok("GB82WEST12345698765433")
    for cue in ("Api_Key", "ApiKey", "api_key", "API_KEY"):
        assert [k for _, _, k in pii.find(f"{cue}=0123456789abcdef01", pii.anchors())] == ["secret"]


def test_personal_data_of_odd_rows(odd_docs, documents):
    rows = pii.digest(odd_docs).collect()
    assert len(rows) == len(ODD) and all(r.spans == "" and r.n_email == 0 for r in rows)
    assert {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert set(odd_docs.columns) <= set(pii.scan(odd_docs).columns)
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in pii.digest(documents).collect():
        base = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[2] == k for s in base) for k in pii.BASE_KINDS)


# --- licences -------------------------------------------------------------------------------------------------------------


def brute_licence(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    starts, labels = [], set()
    for label, phrase in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_licence_phrases_match_brute_force():
    rng, index = random.Random(3), licenses.PositionalIndex({}, 0)
    parts = ["mit", "license", " ", "\n", "MIT License", ". ", "é", "apache", "general public license", "\x85", "-"]
    for _ in range(5_000):
        text = "".join(rng.choice(parts) for _ in range(12))
        assert licenses.scan_text(index, text)[:5] == brute_licence(text)


def test_licence_scan(make_docs, odd_docs):
    texts = [
        "x\nLicensed under the Apache License, Version 2.0.\ny",
        "Licensed under CC BY-NC 4.0.",
        "the mit license is not released",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "public license of the general",
    ]
    rows = licenses.scan(make_docs(texts)).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == ["apache", "cc-by-nc", "mit", "mit", ""]
    assert [r.base_labels for r in rows] == ["apache", "", "mit", "", ""]
    assert rows[0].first_word == rows[0].last_word == 4 and rows[4].score == 0.0 and rows[4].first_word is None
    odd = licenses.scan(odd_docs).collect()
    assert len(odd) == len(ODD) and all(r.n_base == 0 and r.score == 0 for r in odd)
    assert licenses.scan(odd_docs.limit(0)).count() == 0


def test_every_notice_of_a_text_is_found():
    templates = [" ".join(t.split()) for _, _, t in licenses.TEMPLATES]
    common = {w: 900 for w in "licensed under cc by 4 0".split()}
    index = licenses.PositionalIndex(common, 1000)
    text = "\n\n".join([*templates, "and so on", "licensed under cc by 4 0"])
    found = licenses.scan_text(index, text)
    assert found[5].split(",") == sorted({label for label, _, _ in licenses.TEMPLATES})
    words = licenses.words_of(text)
    at = [i for i in range(len(words)) if words[i : i + 6] == b"licensed under cc by 4 0".split()]
    assert len(at) == 2 and {("cc-by", i, 1.0) for i in at} <= set(found[7])


# --- quality ----------------------------------------------------------------------------------------------------------------


def brute_facts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_facts_match_brute_force():
    rng = random.Random(4)
    for _ in range(1_500):
        text = "".join(rng.choice("ab  \n\x1c é#") for _ in range(rng.randint(0, 120)))
        f = quality.facts(text)
        assert brute_facts(text) == (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words)


def test_quality_keeps_prose_and_drops_junk(make_docs, odd_docs):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = [" ".join(rng.choice(vocabulary) for _ in range(80)) + "." for _ in range(300)]
    junk = [" | ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(15)] + [p.upper().replace(" ", "!! ") for p in prose[:10]]
    rows = {r.doc_id: r.kept for r in quality.rate(make_docs(prose + junk)).collect()}
    assert all(rows[i] for i in range(len(prose))) and not any(rows[i] for i in range(len(prose), len(rows)))
    odd = quality.rate(odd_docs).collect()
    assert len(odd) == len(ODD) and not any(r.kept for r in odd)
    assert quality.rate(odd_docs.limit(0)).count() == 0


def test_posteriors_do_not_depend_on_size():
    counts = {0: 3, 9841: 50, 19682: 400}
    small, large = quality.fit(counts), quality.fit({k: 1000 * n for k, n in counts.items()})
    for k in counts:
        assert (small.posterior[k] >= 0.5) == (large.posterior[k] >= 0.5)


# --- byte-pair encoding ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_encoding_equals_the_library(library):
    encode, tables, rng = bpe.encoder(tokenizer_path()), bpe.tables(tokenizer_path()), random.Random(7)
    alphabets = ["abcdefgh", "aaab", "the ing's 123 .,!", "éàüßç Σσς İ́ë", "  \x1c\x1f\x85 a b", "日本語한국😀👍🏽x"]
    special = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "a", " "]
    for i in range(4_000):
        text = "".join(rng.choice(special if i % 8 == 0 else rng.choice(alphabets)) for _ in range(rng.randint(0, 30)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert encode(text) == ids, text
        assert bpe.decode(ids, tables.names) == library.decode(ids, skip_special_tokens=False)


def test_pairs_are_compatible_as_the_library_encodes(library):
    tables = bpe.tables(tokenizer_path())
    for a, b in (("in", "to</w>"), ("th", "e</w>"), ("a", "b</w>"), ("ti", "on</w>")):
        ids = {t: i for i, t in tables.names.items()}
        x, y = ids[a], ids[b]
        whole = library.encode((a + b).removesuffix("</w>"), add_special_tokens=False).ids
        assert tables.compatible(x, y) == (whole == [x, y])


def test_encoding_of_tables(library, odd_docs, documents):
    rows = bpe.digest(odd_docs, tokenizer_path()).collect()
    assert len(rows) == len(ODD)
    for docs in (odd_docs, documents):
        texts = {(r.doc_id, r.text) for r in docs.collect()}
        want = set()
        for i, t in texts:
            ids = library.encode(t or "", add_special_tokens=False).ids
            want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert {tuple(r) for r in bpe.digest(docs, tokenizer_path()).collect()} == want
