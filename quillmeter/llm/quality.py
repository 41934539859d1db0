"""Document quality by weak supervision.

Rules vote good (+1), bad (-1) or abstain (0) on each text. Expectation-maximisation on the counts of vote
patterns estimates how each rule votes on good and on bad texts and how common good texts are; no labels are used.
The posterior probability of good, not a list of conditions that must all hold, decides.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.llm.common import SPACE, materialised, with_text_columns

WINDOW = 8
SYMBOLS = "#*$%&|<>"
TERMINAL = (".", "!", "?", '."', "。", "…", ":", ";")


@dataclass(frozen=True)
class TextFacts:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lines: int
    n_ended_lines: int
    n_upper_words: int
    n_bangs: int
    n_distinct_words: int


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.uint64, count=len(words))
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    keys = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        keys = keys * np.uint64(0x100000001B3) + mixed[k : k + n]
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    covered[at] += 1
    np.subtract.at(covered, at + window, 1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def facts(text: str) -> TextFacts:
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    seen = Counter(lines)
    return TextFacts(
        n_words=len(words),
        word_chars=len(text) - sum(map(text.count, SPACE)),
        n_symbols=sum(map(text.count, SYMBOLS)),
        n_dup_lines=len(lines) - len(seen),
        n_repeat_words=repeated_words(words),
        n_lines=len(lines),
        n_ended_lines=sum(x.rstrip(SPACE).endswith(TERMINAL) for x in lines),
        n_upper_words=sum(map(bytes.isupper, words)),
        n_bangs=text.count("!"),
        n_distinct_words=len(set(words)),
    )


def _defect(found: bool) -> int:
    """Bad if the defect is there; its absence says nothing."""
    return -1 if found else 0


#: The rules. Each looks at one property and abstains where that property says nothing.
RULES: dict[str, Callable[[TextFacts], int]] = {
    "length": lambda f: 1 if f.n_words >= 50 else -1 if f.n_words < 20 else 0,
    "word_length": lambda f: -1 if not 2 * f.n_words <= f.word_chars <= 15 * f.n_words else int(3 * f.n_words <= f.word_chars <= 10 * f.n_words),
    "line_ends": lambda f: 1 if 2 * f.n_ended_lines >= f.n_lines else -1 if 10 * f.n_ended_lines < f.n_lines else 0,
    "symbols": lambda f: _defect(f.n_symbols > 0.1 * f.n_words),
    "dup_lines": lambda f: _defect(f.n_lines > 1 and f.n_dup_lines > 0.5 * f.n_lines),
    "repeats": lambda f: _defect(f.n_repeat_words > 0.3 * f.n_words),
    "capitals": lambda f: _defect(f.n_upper_words > 0.4 * f.n_words),
    "bangs": lambda f: _defect(f.n_bangs > 0.2 * f.n_words),
    "variety": lambda f: _defect(f.n_words >= 50 and f.n_distinct_words**2 < 4 * f.n_words),
}


def pattern(f: TextFacts) -> int:
    """Votes as digits base three, the first rule first."""
    code = 0
    for rule in RULES.values():
        code = 3 * code + rule(f) + 1
    return code


def votes_of(code: int) -> list[int]:
    out = []
    for _ in RULES:
        out.append(code % 3 - 1)
        code //= 3
    return out[::-1]


def base_failed(f: TextFacts) -> bool:
    return f.n_words < 20 or 100 * f.n_repeat_words > 30 * f.n_words


@dataclass(frozen=True)
class LabelModel:
    prior: float
    accuracies: dict[str, float]  # share of right votes among the votes a rule gives
    posterior: dict[int, float]  # by pattern


def fit(counts: dict[int, int], rounds: int = 200, strength: float = 0.1, least_accuracy: float = 0.8) -> LabelModel:
    """Expectation-maximisation over at most 3^rules pattern counts.

    Each rule has a rate of good, bad and abstaining votes for either class. The prior counts say that rules seldom
    call a good text bad, which also keeps the classes from changing places; they weigh ``strength`` of the texts,
    so that results do not depend on the size of the corpus. Abstaining is no evidence, and a rule's votes for bad
    count as right at least ``least_accuracy`` of the time; a vote for good, the mere absence of a defect, is
    between 1.25 and 1.43 times as frequent on good texts. Without any texts the prior decides.
    """
    codes = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[c] for c in codes], dtype=float)
    votes = np.array([votes_of(int(c)) for c in codes], dtype=np.int64).reshape(len(codes), len(RULES))
    belief = np.array([[0.005, 0.595, 0.4], [0.3, 0.4, 0.3]])  # class good, bad; votes -1, 0, +1
    pseudo = belief * (strength * n.sum() + 1)
    # a vote for bad names a defect, a vote for good only the absence of one: so the start weighs it more
    start = 0.5 * (votes > 0).sum(axis=1) - 4.0 * (votes < 0).sum(axis=1)
    good = 1 / (1 + np.exp(-start))
    prior, rates = 0.5, np.tile(belief[:, None, :], (1, len(RULES), 1))
    onehot = (votes[:, :, None] == np.array([-1, 0, 1])).astype(float)
    for _ in range(rounds):
        for c, weight in enumerate((n * good, n * (1 - good))):
            totals = np.einsum("p,prv->rv", weight, onehot) + pseudo[c]
            rates[c] = totals / totals.sum(axis=1, keepdims=True)
        prior = float(((n * good).sum() + 1) / (n.sum() + 2))
        # a rule is right in at least this share of its votes for bad; a vote for good is weak evidence
        most = rates[1, :, 0] * (1 - prior) / prior * (1 - least_accuracy) / least_accuracy
        rates[0, :, 0] = np.minimum(rates[0, :, 0], most)
        rates[1, :, 2] = np.clip(rates[1, :, 2], 0.7 * rates[0, :, 2], 0.8 * rates[0, :, 2])
        logs = np.einsum("prv,crv->cp", onehot * np.array([1.0, 0.0, 1.0]), np.log(rates))
        odds = math.log(prior / (1 - prior)) + logs[0] - logs[1]
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if len(new) and np.abs(new - good).max() < 1e-9:
            good = new
            break
        good = new
    right = prior * rates[0, :, 2] + (1 - prior) * rates[1, :, 0]
    given = prior * (rates[0, :, 0] + rates[0, :, 2]) + (1 - prior) * (rates[1, :, 0] + rates[1, :, 2])
    return LabelModel(
        prior,
        {name: float(a) for name, a in zip(RULES, right / np.maximum(given, 1e-12), strict=True)},
        {int(c): float(p) for c, p in zip(codes, good, strict=True)},
    )


def describe(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the counted facts, the vote ``pattern`` and ``base_failed``; null texts count as empty. No shuffle."""

    def make() -> Callable[[list[str]], list]:
        def apply(texts: list[str]) -> list:
            f = [facts(t) for t in texts]
            return [
                [x.n_words for x in f],
                [x.word_chars for x in f],
                [x.n_symbols for x in f],
                [x.n_dup_lines for x in f],
                [x.n_repeat_words for x in f],
                [pattern(x) for x in f],
                [base_failed(x) for x in f],
            ]

        return apply

    new = dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "long")
    return with_text_columns(docs, text, make, new | {"pattern": "int", "base_failed": "boolean"}, keep)


def label_model(described: DataFrame) -> LabelModel:
    """Fit on the pattern counts of all rows; the driver receives at most 3^rules counts."""
    rows = described.groupBy("pattern").agg(F.count("*").alias("n")).collect()
    return fit({r["pattern"]: r["n"] for r in rows})


def judge(described: DataFrame, model: LabelModel, threshold: float = 0.5) -> DataFrame:
    """Add ``posterior`` of good and ``kept``: false where ``base_failed``, else whether it reaches ``threshold``."""
    pairs = [F.lit(x) for item in model.posterior.items() for x in item]
    posterior = F.coalesce(F.create_map(*pairs)[F.col("pattern")], F.lit(model.prior)) if pairs else F.lit(model.prior)
    return described.withColumn("posterior", posterior).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)
    )


def rate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Facts and verdict per document. The facts are written once (a few numbers a text) and read twice."""
    described = materialised(describe(docs, text, [doc_id]), "quality-facts")
    return judge(described, label_model(described))
