"""Toxic passages by maximum-scoring segment search over token log-odds.

A token's score is the log-odds of the toxic class given the token, with Dirichlet priors that back off from a word
to its 5- and 4-letter beginnings and to the base rate. Features without significant evidence cost a constant
drift. The Ruzzo-Tompa scan finds all maximal-scoring segments of a text in linear time; Karlin-Altschul
statistics turn segment scores into significances, whose sum per text is calibrated to a probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.llm.common import crc_bucket, with_text_columns

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (5, 4)


@dataclass(frozen=True)
class ToxicityModel:
    """At most ``max_terms`` feature scores, the drift of all other tokens, and the calibration."""

    scores: dict[str, float]
    drift: float
    decay: float  # lambda of the extreme-value law
    scale: float  # K of the extreme-value law
    intercept: float
    slope: float

    def token_score(self, word: str) -> float:
        known = self.scores
        if word in known:
            return known[word]
        for n in PREFIXES:
            if len(word) > n and (beginning := f"{word[:n]}*") in known:
                return known[beginning]
        return -self.drift


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a token sequence.

    ``scores`` lists the positive tokens as (position, score) in order; every token between them scores
    ``-drift``. Linear time: each candidate is pushed and merged at most once.
    """
    stack: list[list[float]] = []  # start, end, left cumulative, right cumulative
    total, at = 0.0, 0
    for position, score in scores:
        total -= drift * (position - at)
        left, right = total, total + score
        total, at = right, position + 1
        candidate = [position, position + 1, left, right]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= candidate[2]:
                j -= 1
            if j < 0 or stack[j][3] >= candidate[3]:
                break
            candidate = [stack[j][0], candidate[1], stack[j][2], candidate[3]]
            del stack[j:]
        stack.append(candidate)
    return [(int(a), int(b), right - left) for a, b, left, right in stack]


def scan(model: ToxicityModel) -> Callable[[str], tuple[float, list[tuple[int, int, float]]]]:
    """The function from a text to its evidence and its significant segments (token start, end, significance).

    The search never joins more tokens than the passage needs: a gap costs ``drift`` per token.
    """
    cache: dict[str, float] = {}

    def run(text: str) -> tuple[float, list[tuple[int, int, float]]]:
        words = WORD.findall(text.lower())
        if len(cache) > 500_000:
            cache.clear()
        for w in set(words):
            if w not in cache:
                cache[w] = model.token_score(w)
        positive = [(i, s) for i, s in enumerate(map(cache.__getitem__, words)) if s > 0]
        if not positive:
            return 0.0, []
        floor = math.log(model.scale * max(len(words), 1))
        found = [(a, b, model.decay * s - floor) for a, b, s in segments(positive, model.drift)]
        found = [x for x in found if x[2] > 0]
        return sum(x[2] for x in found), found

    return run


def _decay(values: np.ndarray, shares: np.ndarray) -> float:
    """Positive root of sum(share * exp(decay * value)) = 1; values have a negative mean and a positive maximum."""
    low, high = 1e-6, 1.0
    excess = lambda x: float(np.sum(shares * np.exp(np.minimum(x * values, 700)))) - 1
    while excess(high) < 0 and high < 1e6:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (low, mid) if excess(mid) > 0 else (mid, high)
    return high


def _logistic(x: np.ndarray, n: np.ndarray, hits: np.ndarray) -> tuple[float, float]:
    """Ridge-regularised logistic fit on grouped data; the slope stays non-negative."""
    beta = np.zeros(2)
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (hits - n * p) - 0.01 * beta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.clip(np.linalg.solve(hessian, gradient), -4, 4)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), max(float(beta[1]), 0.0)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_rows: int = 20_000,
    max_terms: int = 20_000,
    prior: float = 2.0,
    least_z: float = 2.5,
    least_odds: float = 1.0,
    drift: float = 0.25,
) -> ToxicityModel:
    """Learn from ``labels`` (doc_id, label 0/1); rows with a null id or label are no examples.

    The classifier is fitted on at most ``sample_rows`` labelled rows, taken in the order of a hash of the id; so
    the sample may be broadcast. A document labelled twice with different labels counts once per label. The driver
    receives at most ``max_terms`` features and 64 calibration bins. Without examples of both classes the model has
    no features and every text gets the base rate.
    """
    examples = (
        labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label"))
        .where("__id IS NOT NULL AND __label IN (0, 1)")
        .distinct()
        .orderBy(F.xxhash64("__id"), "__id", "__label")
        .limit(sample_rows)
    )
    labelled = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(
        F.broadcast(examples), "__id"
    )

    def distinct_features() -> Callable[[list[str]], list]:
        def run(texts: list[str]) -> list:
            out = []
            for t in texts:
                words = set(WORD.findall(t.lower()))
                out.append(sorted({f for w in words for f in features(w)} | {""}))
            return [out]

        return run

    found = with_text_columns(labelled, "__text", distinct_features, {"f": "array<string>"}, keep=["__label"])
    counts = (
        found.select("__label", F.explode("f").alias("f"))
        .groupBy("f")
        .agg(F.sum("__label").alias("bad"), F.sum(1 - F.col("__label")).alias("good"))
    )
    counts = counts.where("f = '' OR bad > 1").persist()
    total = counts.where("f = ''").first()
    n_bad, n_good = (int(total["bad"]), int(total["good"])) if total else (0, 0)
    if not n_bad or not n_good:
        counts.unpersist()
        base = (n_bad + 0.5) / (n_bad + n_good + 1)
        return ToxicityModel({}, drift, 1.0, 1.0, math.log(base / (1 - base)), 0.0)

    base = n_bad / (n_bad + n_good)
    a, b = prior * base, prior * (1 - base)
    odds = F.log((F.col("bad") + a) / (n_bad + prior - F.col("bad") - a)) - F.log(
        (F.col("good") + b) / (n_good + prior - F.col("good") - b)
    )
    z = F.col("delta") / F.sqrt(1 / (F.col("bad") + a) + 1 / (F.col("good") + b))
    strong = (
        counts.where("f <> ''")
        .where((F.col("bad") < n_bad) & (F.col("good") < n_good))
        .withColumn("delta", odds)
        .withColumn("z", z)
        .where(F.col("z") >= least_z)
        .orderBy(F.desc("z"), "f")
        .limit(max_terms)
        .collect()
    )
    counts.unpersist()
    raw = {r["f"]: (int(r["bad"]), int(r["good"])) for r in strong}

    def toxic_rate(feature: str) -> float:
        """Posterior rate, with the next shorter beginning as the centre of the Dirichlet prior."""
        centre = base
        if not feature.endswith("*"):
            for n in PREFIXES:
                if (f := f"{feature[:n]}*") in raw and len(feature) > n:
                    centre = toxic_rate(f)
                    break
        elif len(feature) > PREFIXES[-1] + 1 and (f := f"{feature[: PREFIXES[-1]]}*") in raw:
            centre = toxic_rate(f)
        bad, good = raw[feature]
        return (bad + prior * centre) / (bad + good + prior)

    logit = lambda p: math.log(p / (1 - p))
    scores = {f: s for f in raw if (s := logit(min(toxic_rate(f), 1 - 1e-9)) - logit(base)) >= least_odds}

    # background: how often clean texts show each score; every class of tokens has at least half an occurrence
    shares = np.array([(raw[f][1] + 0.5) for f in scores] or [0.5], dtype=float)
    values = np.array(list(scores.values()) or [1.0])
    tokens = float(shares.sum() + 100.0 * n_good)
    decay = _decay(np.append(values, -drift), np.append(shares / tokens, 1 - shares.sum() / tokens))
    draft = ToxicityModel(scores, drift, decay, float(shares.sum() / tokens), 0.0, 1.0)

    def evidence_bins() -> Callable[[list[str]], list]:
        run = scan(draft)
        return lambda texts: [[min(63, int(8 * math.log1p(run(t)[0]))) for t in texts]]

    bins = (
        with_text_columns(labelled, "__text", evidence_bins, {"bin": "int"}, keep=["__label"])
        .groupBy("bin")
        .agg(F.count("*").alias("n"), F.sum("__label").alias("bad"))
        .orderBy("bin")
        .collect()
    )
    intercept, slope = _logistic(
        np.array([r["bin"] / 8 for r in bins], float),
        np.array([r["n"] for r in bins], float),
        np.array([r["bad"] for r in bins], float),
    )
    return ToxicityModel(scores, drift, decay, draft.scale, intercept, slope)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (probability of the toxic class), ``evidence``, ``n_passages`` and ``passages``.

    Passages are (first token, end token, significance) over words of letters. A null or empty text has no passage
    and the score of such texts. Nothing is shuffled; texts of any length take linear time.
    """

    def make() -> Callable[[list[str]], list]:
        run = scan(model)

        def apply(texts: list[str]) -> list:
            found = [run(t) for t in texts]
            at = [model.intercept + model.slope * math.log1p(e) for e, _ in found]
            return [
                [1 / (1 + math.exp(-max(-60.0, min(60.0, x)))) for x in at],
                [e for e, _ in found],
                [len(p) for _, p in found],
                [[{"start": a, "end": b, "significance": s} for a, b, s in p] for _, p in found],
            ]

        return apply

    new = {
        "score": "double",
        "evidence": "double",
        "n_passages": "int",
        "passages": "array<struct<start:int,end:int,significance:double>>",
    }
    return with_text_columns(docs, text, make, new, keep)


def held_out(doc_id: str = "doc_id", of: int = 4, rest: int = 2):
    """True for the rows kept from training; a null id is never held out."""
    return F.coalesce(crc_bucket(doc_id, of) == rest, F.lit(False))


def train_labels(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return labels.where(~held_out(doc_id))
