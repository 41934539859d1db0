"""Runs of words that repeat with a period, found by block convolution.

A run is a stretch of words that keeps its smallest period q at least three times. For every scale B = 1, 2, 4, ...
the runs with B <= q < 2 B are found as follows. A run of three periods holds an aligned block of B words together
with its copy q words later, so each block is looked for among the 2 B words behind it: the sums of squared
differences between the block and the window, at all B alignments at once, come from number-theoretic transforms,
exact in integers. A sum of zero is an occurrence, its distance a period, and the occurrence is extended word by word
to a whole stretch.

Blocks that cannot belong to such a run are left out beforehand, exactly: a block with a word that does not recur
within 2 B words, and a block whose window lies within a run of a smaller period (any period it shows is a multiple of
that one). In prose nearly all blocks fall to the first rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.llm.common import with_text_columns

#: 15 * 2^27 + 1, a prime with roots of unity for every transform up to 2^27 words, and a primitive root of it.
PRIME, GENERATOR = 2013265921, 31
#: Words that are searched, and numbers that are transformed, at a time.
WORDS_AT_A_TIME, NUMBERS_AT_A_TIME = 1 << 19, 1 << 19
NEVER = np.iinfo(np.int64).max

Run = tuple[int, int, int]  # start, length, period


class Transforms:
    """Number-theoretic transforms of the rows of a matrix, modulo ``PRIME``; the length is a power of two."""

    def __init__(self) -> None:
        self.tables: dict[tuple[int, bool], np.ndarray] = {}

    def roots(self, half: int, inverse: bool) -> np.ndarray:
        """Powers 0 to half - 1 of a root of unity of order 2 * half, by doubling."""
        if (half, inverse) not in self.tables:
            root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
            root = pow(root, -1, PRIME) if inverse else root
            powers = np.ones(1, dtype=np.uint64)
            while len(powers) < half:
                powers = np.concatenate([powers, powers * np.uint64(pow(root, len(powers), PRIME)) % PRIME])
            self.tables[half, inverse] = powers
        return self.tables[half, inverse]

    def forward(self, a: np.ndarray) -> np.ndarray:
        """Decimation in frequency: natural order in, bit-reversed order out."""
        rows, half = len(a), a.shape[1] // 2
        while half:
            v = a.reshape(rows, -1, 2, half)
            x, y = v[:, :, 0].copy(), v[:, :, 1].copy()
            v[:, :, 0] = (x + y) % PRIME
            v[:, :, 1] = (x + np.uint64(PRIME) - y) * self.roots(half, False) % PRIME
            half //= 2
        return a

    def backward(self, a: np.ndarray) -> np.ndarray:
        """Decimation in time: bit-reversed order in, natural order out."""
        rows, size, half = len(a), a.shape[1], 1
        while half < size:
            v = a.reshape(rows, -1, 2, half)
            x, y = v[:, :, 0].copy(), v[:, :, 1] * self.roots(half, True) % PRIME
            v[:, :, 0] = (x + y) % PRIME
            v[:, :, 1] = (x + np.uint64(PRIME) - y) % PRIME
            half *= 2
        return a * np.uint64(pow(size, -1, PRIME)) % PRIME


def digit_bits(bits: int, block: int) -> int:
    """Bits of a digit such that the sum of squared differences of all digits of a block stays below the prime."""
    width = max(bits, 1)
    while width > 1 and -(-bits // width) * block * (2**width - 1) ** 2 >= PRIME:
        width -= 1
    return width


def occurrences(ids: np.ndarray, starts: np.ndarray, block: int, transforms: Transforms) -> Iterator[tuple[int, int]]:
    """(start, distance) of each block found again at a distance of ``block`` to ``2 * block - 1`` words.

    ``ids`` must go on for three blocks behind the last start. Numbers too large for exact sums are compared digit by
    digit; the digits' sums add up.
    """
    size = 2 * block
    width = digit_bits(int(ids.max()).bit_length(), block)
    step = max(1, NUMBERS_AT_A_TIME // size)
    for at in range(0, len(starts), step):
        some = starts[at : at + step]
        first = ids[some[:, None] + np.arange(block)]
        behind = ids[some[:, None] + block + np.arange(size)]
        squares = np.zeros((len(some), block), dtype=np.int64)
        products = np.zeros((len(some), size), dtype=np.uint64)
        shift = 0
        while shift == 0 or (ids.max() >> shift):
            x, y = first >> shift & (1 << width) - 1, behind >> shift & (1 << width) - 1
            sums = np.cumsum(np.pad(y * y, ((0, 0), (1, 0))), axis=1)
            squares += (x * x).sum(axis=1)[:, None] + sums[:, block : 2 * block] - sums[:, :block]
            turned = np.zeros((len(some), size), dtype=np.uint64)
            turned[:, 0], turned[:, block + 1 :] = x[:, 0], x[:, :0:-1]
            products = (products + transforms.forward(turned) * transforms.forward(y.astype(np.uint64)) % PRIME) % PRIME
            shift += width
        crossed = transforms.backward(products)[:, :block].astype(np.int64)
        row, alignment = np.nonzero((squares - 2 * crossed) % PRIME == 0)
        yield from zip(some[row].tolist(), (alignment + block).tolist(), strict=True)


def stretch(ids: np.ndarray, low: int, high: int, period: int) -> tuple[int, int]:
    """The widest stretch around [low, high) that keeps the period; compared in pieces of doubling length."""
    step = 64
    while high < len(ids):
        n = min(step, len(ids) - high)
        differ = ids[high : high + n] != ids[high - period : high - period + n]
        if differ.any():
            high += int(differ.argmax())
            break
        high, step = high + n, 2 * step
    step = 64
    while low > 0:
        n = min(step, low)
        differ = ids[low - n : low] != ids[low - n + period : low + period]
        if differ.any():
            low -= int(differ[::-1].argmax())
            break
        low, step = low - n, 2 * step
    return low, high


def gaps(keys: np.ndarray) -> np.ndarray:
    """Distance of each entry to the next equal one; ``NEVER`` where there is none."""
    out = np.full(len(keys), NEVER)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def runs_of(ids: np.ndarray, gap: np.ndarray, longest: int, least: int, repeats: int = 3) -> list[Run]:
    """All runs, by start and period, of texts that lie one behind the other, each followed by one 0.

    ``gap`` is the distance to the next equal word of the same text, ``longest`` the length of the longest text.
    """
    transforms = Transforms()
    n, block, worst = len(ids), 1, gap
    ids = np.concatenate([ids, np.zeros(longest + 3, dtype=np.int64)])
    found: dict[tuple[int, int], int] = {}
    reach = np.zeros(n + 1, dtype=np.int64)  # furthest end of a run that starts here or before
    while repeats * block <= longest:
        starts = np.flatnonzero(worst < 2 * block) * block
        starts = starts[starts + repeats * block > reach[starts]]
        ends: dict[int, int] = {}
        for start, period in sorted(occurrences(ids, starts, block, transforms), key=lambda c: (c[1], c[0])) if len(starts) else ():
            if max(ends.get(period, 0), reach[start]) >= start + block + period:
                continue  # seen, or a multiple of a smaller run's period
            low, high = stretch(ids[:n], start, start + block + period, period)
            ends[period] = high
            if high - low >= repeats * period:
                found.setdefault((low, high), period)
        for (low, high) in found if ends else ():
            reach[low] = max(reach[low], high)
        reach = np.maximum.accumulate(reach) if ends else reach
        block *= 2
        pairs = len(worst) // 2
        worst = worst[: 2 * pairs].reshape(pairs, 2).max(axis=1)
    return sorted((low, high - low, q) for (low, high), q in found.items() if high - low >= least)


def runs_of_texts(texts: list[list[bytes]], least: int) -> list[list[Run]]:
    """The runs of each text, given as its words; the texts are searched together."""
    ids = np.zeros(sum(map(len, texts)) + len(texts), dtype=np.int64)
    keys = np.zeros(len(ids), dtype=np.int64)
    begins, at, base = [], 0, 1
    for words in texts:
        number: dict[bytes, int] = {}
        own = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
        begins.append(at)
        ids[at : at + len(words)] = own + 1
        keys[at : at + len(words)] = own + base
        at, base = at + len(words) + 1, base + len(number)
    keys[ids == 0] = -1 - np.arange(len(texts))  # the ends differ from all words and from each other
    out: list[list[Run]] = [[] for _ in texts]
    found = runs_of(ids, gaps(keys), max(map(len, texts), default=0), least)
    places = np.searchsorted(begins, [s for s, _, _ in found], side="right") - 1
    for place, (start, length, period) in zip(places.tolist(), found, strict=True):
        out[place].append((start - begins[place], length, period))
    return out


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period, compared exactly; ties: smallest start, then period."""
    best: Run | None = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that a run only repeats: of each run its first period stays."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)])


def portions(texts: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    """Texts in groups of about ``WORDS_AT_A_TIME`` words; a longer text is a group of its own."""
    group: list[list[bytes]] = []
    size = 0
    for words in texts:
        if group and size + len(words) > WORDS_AT_A_TIME:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words) + 1
    if group:
        yield group


def find_runs(docs: DataFrame, text: str = "text", least: int = 24, keep: list[str] | None = None) -> DataFrame:
    """Add ``n_words``, ``runs`` (start, length, period; by start, then period), ``strongest`` and ``collapsed``.

    Runs have at least ``least`` words and three periods. Null, empty and blank texts have no words, no runs and an
    empty collapsed text; ``strongest`` is null without runs. Rows stay as they are, repeated ones and null keys
    included; added columns replace kept ones of the same name. Nothing is shuffled; a task holds one Arrow batch,
    and the time grows with the length of a text times its logarithm at most.
    """

    def make() -> Callable[[list[str]], list]:
        def apply(texts: list[str]) -> list:
            counts, found, best, short = [], [], [], []
            for group in portions([t.encode().split() for t in texts]):
                for words, runs in zip(group, runs_of_texts(group, least), strict=True):
                    counts.append(len(words))
                    found.append([dict(zip(NAMES, r, strict=True)) for r in runs])
                    top = strongest(runs)
                    best.append(top and dict(zip(NAMES, top, strict=True)))
                    short.append(collapsed(words, runs).decode())
            return [counts, found, best, short]

        return apply

    new = {"n_words": "long", "runs": f"array<{RUN_TYPE}>", "strongest": RUN_TYPE, "collapsed": "string"}
    return with_text_columns(docs, text, make, new, keep)


NAMES = ("start", "length", "period")
RUN_TYPE = "struct<start:long,length:long,period:long>"


def planted(text: Column | str, doc_id: Column | str) -> Column:
    """The text of one document in ten, made periodic from some word on; other texts, and those without id, as they are."""
    text, doc_id = (F.col(c) if isinstance(c, str) else c for c in (text, doc_id))
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def periodic(a: Column) -> Column:
        w, n = a["w"], F.size(a["w"])
        start = g % n
        period = 1 + F.floor((n - start) / (3 + g % 8))
        later = lambda x, i: F.when(i >= start, F.get(w, (start + (i - start) % period).cast("int"))).otherwise(x)
        return F.when(n > 0, F.array_join(F.transform(w, later), " "))

    changed = F.get(F.transform(F.array(F.struct(words.alias("w"))), periodic), F.lit(0))
    return F.when(h % 10 == 0, F.coalesce(changed, text)).otherwise(text)


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document, some of them made periodic: number of runs, the strongest run, hashes of runs and collapsed text."""
    found = find_runs(docs.select(F.col(doc_id).alias("doc_id"), planted(text, doc_id).alias("text")), keep=["doc_id"])
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in NAMES]))
    best = {c: F.col(f"strongest.{c}") for c in NAMES}
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in NAMES],
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda s: F.concat(s, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
