"""Class-based n-gram scores (Brown et al.): exchange clustering, class transitions, word emissions.

Words fall into classes. ``P(word | before) = T(class | class before) * P(word | class)``, where the class
transitions are smoothed with the classes' own shares (Witten-Bell). Emissions are the smoothed unigram shares
within a class, so a text's score is its unigram score plus, per known token, the logarithm of how much more likely
its class is after the class before it. A token that training lacks keeps its unigram probability, so
that the probabilities after any word sum to one.

The ``n_words`` most frequent words are clustered one by one, all other words by their last letters. The exchange
steps see counts of pairs of such units; their number is bounded by parameters, whatever the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.llm.common import crc_bucket, materialised

END = b" "  # the token behind each text; no word can be a blank
STRIP = b".,;:!?\"'()[]{}|#$%&*<>-"
SUFFIX = 4


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, and the end."""
    out = text.encode().lower().split()
    out.append(END)
    return out


def ending(word: bytes) -> bytes:
    return b"-" + (word.strip(STRIP) or word)[-SUFFIX:]


@dataclass(frozen=True)
class Units:
    """Frequent words, then frequent endings, then one unit for all other endings."""

    number: dict[bytes, int]

    @property
    def size(self) -> int:
        return len(self.number) + 1

    def of(self, word: bytes) -> int:
        got = self.number.get(word)
        return got if got is not None else self.number.get(ending(word), len(self.number))


class UnitMemory(dict):
    """Units of words by word, filled as words come; not beyond a bound."""

    def __init__(self, units: Units, size: int = 500_000) -> None:
        super().__init__()
        self.units, self.size = units, size

    def __missing__(self, word: bytes) -> int:
        got = self.units.of(word)
        if len(self) < self.size:
            self[word] = got
        return got


@dataclass(frozen=True)
class Model:
    units: Units
    classes: np.ndarray  # class of each unit
    lift: np.ndarray  # log10 of how much likelier a class (column) is behind a class (row) than by its own share
    n_tokens: int
    n_types: int

    def log_share(self, count: np.ndarray | float):
        return np.log10((np.asarray(count, dtype=float) + 0.5) / (self.n_tokens + 0.5 * (self.n_types + 1)))


# --- counts ------------------------------------------------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts in column ``text``; counted per Arrow batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[bytes] = Counter()
            for t in batch.column(0).to_pylist():
                counts.update(tokens(t or ""))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
            )

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def choose_units(counts: DataFrame, n_words: int, n_endings: int) -> Units:
    """The most frequent words, and the most frequent endings of the others; at most ``n_words + n_endings``."""
    words = [bytes(r["word"]) for r in counts.orderBy(F.desc("n"), "word").limit(n_words).collect()]
    chosen = set(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: Counter[bytes] = Counter()
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if w not in chosen:
                    out[ending(w)] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.int64())], names=["e", "n"])

    sums = counts.mapInArrow(run, "e binary, n long").groupBy("e").agg(F.sum("n").alias("n"))
    names = words + [bytes(r["e"]) for r in sums.orderBy(F.desc("n"), "e").limit(n_endings).collect()]
    return Units({w: i for i, w in enumerate(names)})


def pair_counts(texts: DataFrame, units: Units) -> DataFrame:
    """(u, v, n): how often unit v follows unit u; the end stands before each text's first word."""
    size, end = units.size, units.of(END)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = UnitMemory(units)
        for batch in batches:
            flat: list[int] = [end]
            for t in batch.column(0).to_pylist():
                flat.extend(map(seen.__getitem__, tokens(t or "")))
            at = np.array(flat, dtype=np.int64)
            key, n = np.unique(at[:-1] * size + at[1:], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["key", "n"])

    pairs = texts.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return pairs.select(F.expr(f"cast(key div {size} as int)").alias("u"), F.expr(f"cast(key % {size} as int)").alias("v"), "n")


def unit_masses(counts: DataFrame, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, types = np.zeros(units.size, np.int64), np.zeros(units.size, np.int64)
        for batch in batches:
            at = np.fromiter((units.of(w) for w in batch.column(0).to_pylist()), np.int64, batch.num_rows)
            np.add.at(total, at, batch.column(1).to_numpy(zero_copy_only=False))
            np.add.at(types, at, 1)
        some = np.flatnonzero(types)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some]), pa.array(types[some])], names=["u", "n", "k"])

    total, types = np.zeros(units.size, np.int64), np.zeros(units.size, np.int64)
    for r in counts.mapInArrow(run, "u long, n long, k long").groupBy("u").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).collect():
        total[r["u"]], types[r["u"]] = r["n"], r["k"]
    return total, types


# --- exchange clustering ---------------------------------------------------------------------------------------------


def profiles(pairs: DataFrame, classes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each unit follows each class, and is followed by it: two matrices of bounded size."""
    size = len(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * size * k, np.int64)
        for batch in batches:
            u, v, n = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            sums += np.bincount(v * k + classes[u], n, 2 * size * k).astype(np.int64)
            sums += np.bincount(size * k + u * k + classes[v], n, 2 * size * k).astype(np.int64)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["i", "n"])

    out = np.zeros(2 * size * k, np.int64)
    got = pairs.mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("i").to_numpy()] = got.column("n").to_numpy()
    return out[: size * k].reshape(size, k), out[size * k :].reshape(size, k)


def _xlogx(a: np.ndarray) -> np.ndarray:
    return a * np.log(np.maximum(a, 1.0))


def exchange(before: np.ndarray, after: np.ndarray, classes: np.ndarray, k: int, turn: int) -> np.ndarray:
    """One sweep: each unit, the most frequent first, moves to the class with the highest likelihood of all pairs.

    Every second unit moves in a sweep, so that two neighbours do not swap on old profiles for ever.
    """
    classes = classes.copy()
    table = np.zeros((k, k))
    np.add.at(table, classes, after.astype(float))
    left, right = table.sum(axis=1), table.sum(axis=0)
    weight = after.sum(axis=1)
    for u in np.argsort(-weight, kind="stable"):
        if (u + turn) % 2 or not weight[u] and not before[u].sum():
            continue
        own, b, a = classes[u], before[u].astype(float), after[u].astype(float)
        table[:, own] -= b
        table[own, :] -= a
        np.maximum(table, 0, out=table)
        left[own] -= a.sum()
        right[own] -= b.sum()
        into = _xlogx(table + b[:, None]) - _xlogx(table)
        out = _xlogx(table + a[None, :]) - _xlogx(table)
        both = _xlogx(np.diag(table) + a + b) - _xlogx(np.diag(table))
        gain = into.sum(axis=0) - np.diag(into) + out.sum(axis=1) - np.diag(out) + both
        gain -= _xlogx(left + a.sum()) - _xlogx(left) + _xlogx(right + b.sum()) - _xlogx(right)
        best = int(np.argmax(gain))
        if gain[best] <= gain[own] + 1e-9:
            best = int(own)
        classes[u] = best
        table[:, best] += b
        table[best, :] += a
        left[best] += a.sum()
        right[best] += b.sum()
    return classes


def fit(
    texts: DataFrame, counts: DataFrame, n_words: int = 3000, n_endings: int = 2000, k: int = 48, sweeps: int = 10
) -> Model:
    """Cluster and estimate from the training ``texts`` (column text) and their word ``counts``.

    Without texts every share is that of an unknown word and no class is likelier than another.
    """
    units = choose_units(counts, n_words, n_endings)
    tokens_of, types_of = unit_masses(counts, units)
    n, v = int(tokens_of.sum()), int(types_of.sum())
    classes = np.arange(units.size) % k
    if not n:
        return Model(units, classes, np.zeros((k, k)), 0, 0)
    pairs = materialised(pair_counts(texts, units), "brown-pairs")
    for turn in range(sweeps):
        before, after = profiles(pairs, classes, k)
        moved = exchange(before, after, classes, k, turn)
        if turn and np.array_equal(moved, classes):
            break
        classes = moved
    _, after = profiles(pairs, classes, k)
    table = np.zeros((k, k))
    np.add.at(table, classes, after.astype(float))
    unknown = 0.5 / (n + 0.5 * (v + 1))
    share = np.bincount(classes, tokens_of + 0.5 * types_of, k) / (n + 0.5 * (v + 1))
    seen, kinds = table.sum(axis=1), (table > 0).sum(axis=1)
    trust = (seen / np.maximum(seen + kinds, 1))[:, None]
    ratio = (1 - unknown) * table / np.maximum(seen, 1)[:, None] / np.maximum(share, 1e-300)[None, :]
    lift = np.log10(np.where(share > 0, trust * ratio + (1 - trust), 1.0))
    return Model(units, classes, lift, n, v)


# --- scores ------------------------------------------------------------------------------------------------------------


def score(docs: DataFrame, model: Model, counts: DataFrame, keep: list[str], text: str = "text", n_frequent: int = 100_000) -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score and score (log10) to the ``keep`` columns of each row.

    The counts of the ``n_frequent`` most frequent words go to every task. Other words are joined with the counts
    by a shuffle: a row per text and rare word with its occurrences and what they gain by their classes. No rare
    word is a hot key. Null texts are the end alone.
    """
    spark = docs.sparkSession
    top = counts.orderBy(F.desc("n"), "word").limit(n_frequent)
    frequent = {bytes(r["word"]): int(r["n"]) for r in top.collect()}
    shared = spark.sparkContext.broadcast((frequent, model))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    fields = "n_tokens long, n_known long, base double, score double, words array<binary>, times array<int>, gains array<double>"
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, m = shared.value
        unit = UnitMemory(m.units)
        share = {w: float(s) for w, s in zip(known, m.log_share(np.array(list(known.values()))), strict=True)}
        classes, lift, end = m.classes, m.lift, m.units.of(END)
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for t in batch.column(len(keep)).to_pylist():
                words = tokens(t or "")
                at = classes[np.fromiter(map(unit.__getitem__, words), np.int64, len(words))]
                gains = lift[np.concatenate([[classes[end]], at[:-1]]), at]
                shares = [share.get(w) for w in words]
                rare: dict[bytes, list] = {}
                base = gain = 0.0
                for i, s in enumerate(shares):
                    if s is None:
                        entry = rare.setdefault(words[i], [0, 0.0])
                        entry[0] += 1
                        entry[1] += float(gains[i])
                        gains[i] = 0.0
                    else:
                        base += s
                gain = float(gains.sum())
                n_rare = sum(e[0] for e in rare.values())
                row = (len(words), len(words) - n_rare, base, base + gain, list(rare), [e[0] for e in rare.values()], [e[1] for e in rare.values()])
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            arrays = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.float64())), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *arrays], names=[*keep, *NAMES])

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    parts = source.mapInArrow(run, f"{kept}, {fields}").withColumn("__row", F.monotonically_increasing_id())
    parts = materialised(parts, "brown-parts")
    scale = model.n_tokens + 0.5 * (model.n_types + 1)
    rare = parts.select("__row", F.explode(F.arrays_zip("words", "times", "gains")).alias("e")).select("__row", "e.*")
    least = counts.select(F.col("word").alias("words"), F.col("n").alias("__c"))
    found = rare.join(least, "words", "left")
    own = F.log10((F.coalesce("__c", F.lit(0)) + 0.5) / F.lit(scale))
    sums = found.groupBy("__row").agg(
        F.sum(F.when(F.col("__c").isNotNull(), F.col("times")).otherwise(0)).alias("__known"),
        F.sum(F.col("times") * own).alias("__base"),
        F.sum(F.when(F.col("__c").isNotNull(), F.col("gains")).otherwise(0.0)).alias("__gain"),
    )
    base, gain = F.coalesce("__base", F.lit(0.0)), F.coalesce("__gain", F.lit(0.0))
    return parts.drop("words", "times", "gains").join(sums, "__row", "left").select(
        *[F.col(f"`{c}`") for c in keep],
        "n_tokens",
        (F.col("n_known") + F.coalesce("__known", F.lit(0))).alias("n_known"),
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + base).alias("base_score"),
        (F.col("score") + base + gain).alias("score"),
    )


NAMES = ["n_tokens", "n_known", "base", "score", "words", "times", "gains"]


def held_out(doc_id: str = "doc_id", of: int = 5, rest: int = 1):
    """True for the rows kept from training; a null id is never held out."""
    return F.coalesce(crc_bucket(doc_id, of) == rest, F.lit(False))


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the rows that are not held out and score all rows."""
    training = docs.where(~held_out(doc_id)).select(F.col(text).cast("string").alias("text"))
    counts = materialised(word_counts(training), "brown-words")
    model = fit(training, counts)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return score(rows, model, counts, ["doc_id", "held_out"])
