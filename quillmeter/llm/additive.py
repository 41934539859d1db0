"""Text quality by a generalised additive model with pairwise interactions.

Each property of a text has a lookup table over its bins, a few pairs of properties have a table over both, and the
log-odds of good quality is the sum of the entries a text falls into. The tables are learned by cyclic boosting:
property after property, a shallow tree is fitted to what the model still gets wrong and added, scaled down, to
that property's table; then pairs that explain most of the rest are boosted likewise. Scoring is adding up entries,
and each entry can be read as the weight of one property.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.llm.common import SPACE, crc_bucket, with_text_columns

SYMBOLS = "#*$%&|<>"
ENDINGS = (".", "!", "?", "…", "。", ":", ";", '."', ".)")

#: Properties of a text, in the order of ``properties``.
PROPERTIES = (
    "log_words", "mean_letters", "longest_word", "symbols_per_word", "symbol_words", "bangs_per_word", "upper_words",
    "upper_letters", "digits", "letters", "stops_per_word", "repeated_lines", "commonest_line", "repeated_windows",
    "distinct_words", "commonest_word", "ended_lines", "words_per_line", "log_lines", "short_words", "bars_per_word",
    "title_words", "marks_per_word", "repeated_pairs",
)


def distinct_windows(words: list[str], widths: tuple[int, ...]) -> list[int]:
    """Numbers of different windows of so many consecutive words, told apart by 64-bit hashes."""
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.uint64, count=len(words))
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    out = []
    for width in widths:
        n = max(0, len(words) - width + 1)
        keys = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            keys = keys * np.uint64(0x100000001B3) + mixed[k : k + n]
        out.append(len(np.unique(keys)))
    return out


def properties(text: str) -> list[float]:
    """Shares and lengths that hold for texts of any length and language; zeros for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(PROPERTIES)
    lines = [x for x in map(lambda line: line.strip(SPACE), text.split("\n")) if x]
    counts, line_counts = Counter(words), Counter(lines)
    size = len(text)
    inner = sum(map(len, words))
    upper = sum(map(str.isupper, words))
    ascii_upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = sum(map(text.count, "0123456789"))
    symbols = sum(map(text.count, SYMBOLS))
    stops = sum(map(text.count, ".,;:"))
    marks = symbols + stops + sum(map(text.count, "!?()[]{}\"'@/\\_=+~^-`"))
    pairs, windows = distinct_windows(words, (2, 5))
    ended = sum(x.endswith(ENDINGS) for x in lines)
    return [
        float(np.log1p(n)),
        inner / n,
        float(min(200, max(map(len, counts)))),
        symbols / n,
        sum(c for w, c in counts.items() if w[-1] in SYMBOLS) / n,
        text.count("!") / n,
        upper / n,
        ascii_upper / inner,
        digits / inner,
        max(0, inner - digits - marks) / inner,
        stops / n,
        1 - len(line_counts) / len(lines),
        max(line_counts.values()) / len(lines),
        1 - windows / (n - 4) if n > 4 else 0.0,
        len(counts) / n**0.5,
        max(counts.values()) / n,
        ended / len(lines),
        n / len(lines),
        float(np.log1p(len(lines))),
        sum(c for w, c in counts.items() if len(w) <= 3) / n,
        text.count("|") / n,
        sum(c for w, c in counts.items() if w[0].isupper()) / n,
        marks / n,
        1 - pairs / (n - 1) if n > 1 else 0.0,
    ]


@dataclass
class AdditiveModel:
    intercept: float
    cuts: list[np.ndarray]  # per property: upper limits of all bins but the last
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(self.cuts)], axis=1) if len(x) else np.zeros(x.shape, int)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        codes = self.bins(x)
        out = np.full(len(x), self.intercept)
        for i, table in enumerate(self.tables):
            out += table[codes[:, i]]
        for (i, j), table in self.pairs.items():
            out += table[codes[:, i], codes[:, j]]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def cut_points(values: np.ndarray, most: int) -> np.ndarray:
    """Limits between distinct neighbouring values, at about equal shares of the rows; at most ``most`` - 1."""
    distinct, counts = np.unique(values, return_counts=True)
    if len(distinct) < 2:
        return np.zeros(0)
    middle = (distinct[1:] + distinct[:-1]) / 2
    if len(middle) < most:
        return middle
    shares = np.cumsum(counts)[:-1] / len(values)
    return np.unique(middle[np.searchsorted(shares, np.arange(1, most) / most).clip(0, len(middle) - 1)])


def tree_steps(gradient: np.ndarray, weight: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """One shallow tree over ordered bins: the Newton step of each bin's leaf; splits that gain most come first."""
    parts = [(0, len(gradient))]
    g, w = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    value = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + ridge)
    while len(parts) < leaves:
        best = (1e-12, None, 0)
        for a, b in parts:
            at = np.arange(a + 1, b)
            gain = value(a, at) + value(at, b) - value(a, b)
            gain = np.where((w[at] - w[a] >= least) & (w[b] - w[at] >= least), gain, -1.0)
            if len(at) and gain.max() > best[0]:
                best = (gain.max(), (a, b), int(at[gain.argmax()]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + ridge)
    return out


def quadrants(gradient: np.ndarray, weight: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """The best cut of a two-way table into four leaves: its gain and the step of each cell."""
    g, w = (np.pad(t.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for t in (gradient, weight))
    inside = lambda t: t[1:-1, 1:-1]
    corners = lambda t: (inside(t), t[1:-1, -1:] - inside(t), t[-1:, 1:-1] - inside(t), t[-1, -1] - t[1:-1, -1:] - t[-1:, 1:-1] + inside(t))
    gs, ws = corners(g), corners(w)
    if not inside(g).size:
        return 0.0, np.zeros_like(gradient)
    gain = sum(a**2 / (b + ridge) for a, b in zip(gs, ws, strict=True))
    gain = np.where(np.minimum.reduce(ws) >= least, gain, -1.0)
    at = np.unravel_index(gain.argmax(), gain.shape)
    if gain[at] <= 0:
        return 0.0, np.zeros_like(gradient)
    steps = [float(a[at] / (b[at] + ridge)) for a, b in zip(gs, ws, strict=True)]
    i, j = at[0] + 1, at[1] + 1
    out = np.empty_like(gradient, dtype=float)
    out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = steps
    return float(gain[at]), out


def _loss(y: np.ndarray, odds: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, odds) - y * odds)) if len(y) else 0.0


def train(
    x: np.ndarray,
    y: np.ndarray,
    bins: int = 32,
    rounds: int = 300,
    rate: float = 0.1,
    leaves: int = 3,
    n_pairs: int = 6,
    bags: int = 4,
    patience: int = 20,
    ridge: float = 1.0,
    least: float = 0.5,
    seed: int = 7,
) -> AdditiveModel:
    """Tables from ``x`` (rows x properties) and labels ``y`` in {0, 1}.

    The model is the mean of ``bags`` models. Each leaves out another part of the rows and stops when the loss on
    these has not fallen for ``patience`` rounds. Without rows of both labels all tables are zero and the intercept
    is the smoothed share of label 1.
    """
    cuts = [cut_points(x[:, i], bins) for i in range(x.shape[1])]
    sizes = [len(c) + 1 for c in cuts]
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    model = AdditiveModel(base, cuts, [np.zeros(s) for s in sizes])
    if not len(y) or y.min() == y.max():
        return model
    codes = model.bins(x)
    part = np.random.default_rng(seed).integers(0, bags, len(y))
    useful = [i for i, s in enumerate(sizes) if s > 1]
    singles = [_boost(codes, y, part == b, base, sizes, useful, [], rounds, rate, leaves, patience, ridge, least) for b in range(bags)]
    model.tables = [np.mean([tables[i] for tables, _ in singles], axis=0) for i in range(len(sizes))]

    odds = model.log_odds(x)
    chosen = _strongest_pairs(codes, y, odds, sizes, useful, n_pairs, ridge, least)
    paired = [_boost(codes, y, part == b, odds, sizes, [], chosen, rounds, rate, leaves, patience, ridge, least)[1] for b in range(bags)]
    model.pairs = {p: np.mean([tables[p] for tables in paired], axis=0) for p in chosen}

    # each table is centred over the rows, so that its entries read as differences from the mean text
    for i, table in enumerate(model.tables):
        model.intercept += (mean := float(table[codes[:, i]].mean()))
        table -= mean
    return model


def _strongest_pairs(codes, y, odds, sizes, useful, n_pairs, ridge, least) -> list[tuple[int, int]]:
    """Pairs whose best cut into four gains most beyond what the single tables explain."""
    p = 1 / (1 + np.exp(-odds))
    gains = []
    for n, i in enumerate(useful):
        for j in useful[n + 1 :]:
            gains.append((-quadrants(*_two_way(codes, i, j, sizes, y - p, p * (1 - p)), ridge, least)[0], i, j))
    return [(i, j) for gain, i, j in sorted(gains)[:n_pairs] if gain < 0]


def _two_way(codes, i, j, sizes, gradient, weight) -> tuple[np.ndarray, np.ndarray]:
    cell = codes[:, i] * sizes[j] + codes[:, j]
    return tuple(np.bincount(cell, t, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j]) for t in (gradient, weight))


def _boost(codes, y, out, base, sizes, singles, pairs, rounds, rate, leaves, patience, ridge, least):
    """Cyclic boosting on the rows not ``out``; the tables of the round with the least loss on the rows ``out``."""
    tables = [np.zeros(s) for s in sizes]
    two_way = {p: np.zeros((sizes[p[0]], sizes[p[1]])) for p in pairs}
    odds = np.zeros(len(y)) + base
    best, best_at, kept = _loss(y[out], odds[out]), 0, ([t.copy() for t in tables], {p: t.copy() for p, t in two_way.items()})
    inside = ~out
    for turn in range(1, rounds + 1):
        for i in singles:
            p = 1 / (1 + np.exp(-odds))
            g, w = (np.bincount(codes[inside, i], t[inside], sizes[i]) for t in (y - p, p * (1 - p)))
            step = rate * tree_steps(g, w, leaves, ridge, least)
            tables[i] += step
            odds += step[codes[:, i]]
        for i, j in pairs:
            p = 1 / (1 + np.exp(-odds))
            g, w = _two_way(codes[inside], i, j, sizes, (y - p)[inside], (p * (1 - p))[inside])
            step = rate * quadrants(g, w, ridge, least)[1]
            two_way[i, j] += step
            odds += step[codes[:, i], codes[:, j]]
        now = _loss(y[out], odds[out])
        if now < best - 1e-6:
            best, best_at, kept = now, turn, ([t.copy() for t in tables], {p: t.copy() for p, t in two_way.items()})
        elif turn - best_at >= patience:
            break
    return kept


def describe(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``properties``, an array in the order of ``PROPERTIES``."""
    return with_text_columns(docs, text, lambda: lambda texts: [[properties(t) for t in texts]], {"properties": "array<double>"}, keep)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = 20_000) -> AdditiveModel:
    """The model of at most ``sample_rows`` labelled rows, chosen by a hash of their ids.

    The bound holds for the labels before they meet the documents (so the labels are small enough to broadcast) and for
    the rows that meet, so that repeated ids can not exceed it. Rows without label or id teach nothing.
    """
    chosen = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("double").alias("__y")).where("__y IN (0, 1) AND __id IS NOT NULL")
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "__y").limit(sample_rows)
    rows = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__body")).join(F.broadcast(chosen), "__id")
    told = describe(rows, "__body", ["__id", "__y"]).orderBy(F.xxhash64("__id"), "__id", "__y", "properties").limit(sample_rows)
    table = told.toArrow()
    y = table.column("__y").to_numpy()
    x = np.array(table.column("properties").to_pylist(), dtype=float).reshape(len(y), len(PROPERTIES))
    return train(x, y)


def score(docs: DataFrame, model: AdditiveModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``score``, the probability of good quality. Null, empty and blank texts have zeros for all properties.

    Rows are scored where they are read, a batch at a time, and nothing is shuffled. Repeated rows score alike.
    """

    def make() -> Callable[[list[str]], list]:
        return lambda texts: [model.probability(np.array([properties(t) for t in texts], dtype=float).reshape(len(texts), len(PROPERTIES)))]

    return with_text_columns(docs, text, make, {"score": "double"}, keep)


def held_out(doc_id: str = "doc_id"):
    """True for the rows kept from training; a null id is never held out."""
    return F.coalesce(crc_bucket(doc_id, 4) == 2, F.lit(False))


def rate(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) with a model of the labels that are not held out."""
    model = fit(docs, labels.where(~held_out()))
    scored = score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
