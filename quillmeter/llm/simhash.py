"""SimHash near-duplicates by generalised pigeonhole search.

A fingerprint has a bit set where more than half of a text's shingle hashes have it. Fingerprints within ``differing`` bits
link. The 64 bits are grouped into parts of correlated bits. Whatever thresholds ``t_i >= -1`` with sum
``differing - parts + 1`` a fingerprint gives its parts, any partner agrees with it on some part to within that
part's threshold (-1: the part is skipped). A dynamic program per fingerprint picks the thresholds with the fewest
estimated candidates; its probes meet the index of all fingerprints by equality, and candidates are verified.

Buckets too large for comparing their members are searched exactly by another way: two fingerprints are within two
bits if and only if some point is within one bit of both, so members emit themselves and their 64 neighbours, and
fingerprints that meet on a point are linked to the least of them. That costs 65 rows a fingerprint, never a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.llm.common import materialised, portions, with_text_columns
from quillmeter.llm.components import components

BITS = 64
SEED = 42
#: Members of a bucket above which the way by common neighbours is cheaper than comparing.
LARGE_BUCKET = 200
#: Texts and shingles of a block, when texts of a bucket are compared block by block.
BLOCK_TEXTS, BLOCK_SHINGLES = 32, 50_000


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of each shingle; fewer words than ``size``: of all of them; no words: none."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) <= size:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(g, SEED) for g in grams], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint as a signed 64-bit number; no hashes give zero."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 4096):
        bits = np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * counts > n, bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``fp`` (long). Null texts count as empty; a text of any length takes linear time. No shuffle."""

    def make() -> Callable[[list[str]], list]:
        return lambda texts: [[majority(shingle_hashes(t, shingle)) for t in texts]]

    return with_text_columns(docs, text, make, {"fp": "long"}, keep)


# --- statistics of the fingerprints, all of bounded size -------------------------------------------------------


def _bits_of(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<i8").view(np.uint8), bitorder="little").reshape(-1, BITS)


def _summed(fps: DataFrame, size: int, count: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all fingerprints of an array of ``size`` numbers: one row per task, then one per position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += count(batch.column(0).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "n"])

    out = np.zeros(size, dtype=np.int64)
    for r in fps.select("fp").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r["i"]] = r["n"]
    return out


def bit_groups(fps: DataFrame, n_fps: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of almost equal width; each group grows by the bit most correlated with it."""
    both = _summed(fps, BITS * BITS, lambda v: (b := _bits_of(v).astype(np.int64)).T.dot(b).ravel()).reshape(BITS, BITS)
    share = both / max(n_fps, 1)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    strength = np.abs(share - np.outer(p, p)) / np.outer(spread, spread)
    free = list(range(BITS))
    groups = []
    for k in range(parts):
        width = len(free) // (parts - k)
        first = max(free, key=lambda b: (strength[b, [x for x in free if x != b]].max(initial=0), -b))
        group = [first]
        free.remove(first)
        while len(group) < width:
            nearest = max(free, key=lambda b: (strength[b, group].sum(), -b))
            group.append(nearest)
            free.remove(nearest)
        groups.append(sorted(group))
    return groups


def _gather(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The chosen bits of each value as a number."""
    v = values.astype(np.uint64)
    out = np.zeros(len(v), dtype=np.int64)
    for k, b in enumerate(bits):
        out |= ((v >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


class Allocation:
    """Thresholds per fingerprint by dynamic programming on estimated candidate counts.

    A part's values are split into pieces of at most 8 bits. From the histograms of the pieces, taken as
    independent, follows how many fingerprints lie within 0, 1, .. bits of a value.
    """

    def __init__(self, groups: list[list[int]], histograms: np.ndarray, n_fps: int, differing: int) -> None:
        self.groups, self.differing, self.n = groups, differing, n_fps
        self.pieces = pieces_of(groups)
        popcount = np.array([bin(i).count("1") for i in range(256)])
        distance = popcount[np.arange(256)[:, None] ^ np.arange(256)[None, :]]
        self.within: list[np.ndarray] = []  # per piece: share of fingerprints at each distance from each value
        for k in range(len(self.pieces)):
            share = histograms[k * 256 : (k + 1) * 256] / max(n_fps, 1)
            self.within.append(np.stack([(distance == d) @ share for d in range(differing + 1)], axis=1))

    def estimates(self, values: np.ndarray) -> list[np.ndarray]:
        """Per part: estimated number of fingerprints within t = 0..differing bits, one row per value."""
        out = [None] * len(self.groups)
        for k, (part, bits) in enumerate(self.pieces):
            at = self.within[k][_gather(values, bits)]
            if out[part] is None:
                out[part] = at
            else:
                mixed = np.zeros_like(at)
                for x in range(self.differing + 1):
                    for y in range(self.differing + 1 - x):
                        mixed[:, x + y] += out[part][:, x] * at[:, y]
                out[part] = mixed
        return [self.n * np.cumsum(e, axis=1) for e in out]

    def thresholds(self, values: np.ndarray) -> np.ndarray:
        """One row of thresholds per value, with sum ``differing - parts + 1``."""
        parts, top = len(self.groups), self.differing
        units = top + 1  # of threshold + 1, to be dealt to the parts
        best = np.full((len(values), units + 1), np.inf)
        best[:, 0] = 0
        choice = np.zeros((parts, len(values), units + 1), dtype=np.int8)
        for part, estimate in enumerate(self.estimates(values)):
            width = len(self.groups[part])
            new = best.copy()  # threshold -1 costs nothing
            for t in range(top + 1):
                probes = sum(_choose(width, d) for d in range(t + 1))
                cost = probes + estimate[:, t]
                for u in range(t + 1, units + 1):
                    better = best[:, u - t - 1] + cost < new[:, u]
                    new[better, u] = (best[:, u - t - 1] + cost)[better]
                    choice[part, better, u] = t + 1
            best = new
        out = np.zeros((len(values), parts), dtype=np.int8)
        left = np.full(len(values), units)
        rows = np.arange(len(values))
        for part in range(parts - 1, -1, -1):
            dealt = choice[part, rows, left]
            out[:, part] = dealt - 1
            left = left - dealt
        return out


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def pieces_of(groups: list[list[int]]) -> list[tuple[int, list[int]]]:
    return [(p, g[i : i + 8]) for p, g in enumerate(groups) for i in range(0, len(g), 8)]


def _masks(width: int, most: int) -> np.ndarray:
    """All patterns of ``width`` bits with at most ``most`` set."""
    out = [0]
    ring = [0]
    for _ in range(most):
        ring = sorted({m | 1 << b for m in ring for b in range(width) if not m >> b & 1})
        out += ring
    return np.array(sorted(set(out)), dtype=np.int64)


# --- links -----------------------------------------------------------------------------------------------------


def keys(fps: DataFrame, allocation: Allocation) -> DataFrame:
    """(key, fp, probe): index keys of all parts, and probe keys within each part's threshold."""
    groups = allocation.groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = {(len(g), t): _masks(len(g), t) for g in groups for t in range(allocation.differing + 1)}
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            wanted = allocation.thresholds(values)
            for part, group in enumerate(groups):
                base = _gather(values, group)
                tag = np.int64(part) << np.int64(58)
                yield _rows(base | tag, values, False)
                for t in range(allocation.differing + 1):
                    rows = np.flatnonzero(wanted[:, part] == t)
                    if not len(rows):
                        continue
                    near = masks[len(group), t]
                    for at in range(0, len(rows), max(1, 200_000 // len(near))):
                        some = rows[at : at + max(1, 200_000 // len(near))]
                        yield _rows(((base[some, None] ^ near[None, :]) | tag).ravel(), np.repeat(values[some], len(near)), True)

    return fps.select("fp").mapInArrow(run, "key long, fp long, probe boolean")


def _rows(key: np.ndarray, fp: np.ndarray, probe: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(fp), pa.array(np.full(len(key), probe))], names=["key", "fp", "probe"]
    )


def links(fps: DataFrame, differing: int = 2) -> DataFrame:
    """(a, b): links that connect all different fingerprints within ``differing`` (0, 1 or 2) bits of each other.

    ``fps`` holds each fingerprint once. Every returned pair is within two links' reach and really linked; pairs in
    large buckets come as links to the least fingerprint around a common neighbour. No pair is lost.
    """
    n = fps.count()
    # wide enough parts that random fingerprints seldom agree; with one or two parts more bits are probed instead
    parts = 3 if n < 1 << 24 else 2
    groups = bit_groups(fps, n, parts)
    pieces = pieces_of(groups)
    histograms = _summed(
        fps, 256 * len(pieces), lambda v: np.concatenate([np.bincount(_gather(v, bits), minlength=256) for _, bits in pieces])
    )
    found = materialised(keys(fps, Allocation(groups, histograms, n, differing)), "simhash-keys")
    n_index, n_probe = F.sum((~F.col("probe")).cast("long")), F.sum(F.col("probe").cast("long"))
    # keys that only one fingerprint has, or that nobody probes, hold no candidates
    busy = found.groupBy("key").agg(
        n_index.alias("n_index"), n_probe.alias("n_probe"), (F.min("fp") != F.max("fp")).alias("several")
    )
    large = F.col("n_index") * F.col("n_probe") > LARGE_BUCKET * LARGE_BUCKET
    busy = materialised(busy.where("several AND n_index > 0 AND n_probe > 0").select("key", large.alias("large")), "simhash-buckets")
    marked = found.join(busy, "key")
    index = marked.where("NOT probe AND NOT large").select("key", F.col("fp").alias("b"))
    probes = marked.where("probe AND NOT large").select("key", F.col("fp").alias("a"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= differing
    compared = probes.join(index, "key").where((F.col("a") != F.col("b")) & near).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    crowded = marked.where("large").select("fp").distinct()
    return compared.distinct().unionByName(links_by_neighbours(crowded, differing))


def links_by_neighbours(fps: DataFrame, differing: int) -> DataFrame:
    """Links of fingerprints that share a point within one bit of both (``differing`` 2), or are one bit apart.

    At most 65 fingerprints meet on a point, so the collected sets are bounded.
    """
    flips = [F.lit(0).cast("long")] + [F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(BITS)]
    points = fps.select(F.col("fp"), F.explode(F.array(*flips)).alias("flip")).select(
        (F.col("fp").bitwiseXOR(F.col("flip"))).alias("point"), "fp"
    )
    met = points.groupBy("point").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    hub = F.array_min("fps") if differing == 2 else F.col("point")
    out = met.select(F.explode("fps").alias("a"), hub.alias("b"), F.col("fps").alias("all")).where("a <> b")
    if differing < 2:
        out = out.where(F.array_contains("all", F.col("b")) & F.lit(differing == 1))
    return out.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def cluster(rows: DataFrame, doc_id: str, differing: int = 2) -> DataFrame:
    """Add ``component_id`` to rows of (``doc_id``, fp): the smallest id reachable over links, its own included.

    Equal fingerprints are one node, however many rows have them. Null ids take part but are never the smallest; a
    component of null ids only has a null id.
    """
    nodes = materialised(rows.groupBy("fp").agg(F.min(doc_id).alias("least")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), differing), "a", "b").select(F.col("node").alias("fp"), "root")
    placed = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = materialised(placed, "simhash-roots")
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(placed.join(names, "root").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, differing: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: 16 hexadecimal digits and the smallest id of the component.

    Texts without words have the fingerprint zero and link like any other; an empty table gives no rows.
    """
    rows = materialised(fingerprints(docs, shingle, text, [doc_id]), "simhash-fingerprints")
    out = cluster(rows, doc_id, differing)
    return out.select(doc_id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- whole corpora ---------------------------------------------------------------------------------------------------


def sample_prints(hashes: np.ndarray, views: int, size: int) -> list[int]:
    """Fingerprints of ``views`` min-wise samples: in each view the ``size`` shingles with the least mixed hash.

    ``hashes`` are those of the different shingles of a text.
    """
    if not len(hashes):
        return [0] * views
    out = []
    for v in range(views):
        mixed = (hashes ^ np.uint64(v * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(29)
        least = np.sort(np.partition(mixed, size)[:size] if len(mixed) > size else mixed)
        out.append(xxhash.xxh64_intdigest(least.tobytes(), v) - 2**63)
    return out


def similar(a: str, b: str, shingle: int) -> float:
    """Jaccard similarity of two texts' sets of shingles; of two texts without words 1."""
    x, y = set(shingle_hashes(a, shingle).tolist()), set(shingle_hashes(b, shingle).tolist())
    return len(x & y) / len(x | y) if x or y else 1.0


def keep_one_of_each_group(
    docs: DataFrame, text: str = "text", shingle: int = 5, differing: int = 2, views: int = 12, sample: int = 3, least: float = 0.8,
    doc_id: str = "doc_id",
) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the row with the least id stays (null ids last).

    Groups are the components of links between texts whose Jaccard similarity is at least ``least``, looked for in two
    ways. Texts whose SimHash fingerprints hang together within ``differing`` bits are compared. At a similarity of 0.8
    such fingerprints differ in about ten bits of 64, too many for selective probes; so each text also gets the
    fingerprints of ``views`` min-wise samples of its shingles, which copies share on some view (probability over 0.99 at
    0.8), and all texts that agree on a view are compared. Equal texts, by their SHA-256, are one node. Null texts count
    as empty, and texts without words are copies of each other. All columns stay; a repeated row is a copy.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.monotonically_increasing_id().alias("row"))

    def make() -> Callable[[list[str]], list]:
        def apply(texts: list[str]) -> list:
            hashes = [shingle_hashes(t, shingle) for t in texts]
            return [[majority(h) for h in hashes], [sample_prints(np.unique(h), views, sample) for h in hashes]]

        return apply

    new = {"fp": "long", "samples": "array<long>"}
    described = with_text_columns(rows, f"doc.{text}", make, new, ["doc", "row"])
    same = F.sha2(F.coalesce(F.col("doc").getField(text).cast("string"), F.lit("")), 256)
    rows = materialised(described.withColumn("same", same), "dedup-rows")
    # equal texts: one node, the first row
    nodes = rows.groupBy("same").agg(F.min("row").alias("node"), F.first("fp").alias("fp"), F.first("samples").alias("samples"))
    nodes = materialised(nodes, "dedup-nodes")
    prints = materialised(nodes.select("fp").distinct(), "dedup-prints")
    # fingerprints that hang together within ``differing`` bits are one more bucket of each text
    close = components(links(prints, differing), "a", "b").select(F.col("node").alias("fp"), F.col("root").alias("close"))
    placed = nodes.join(close, "fp", "left").select("node", F.array_append("samples", F.coalesce("close", "fp")).alias("samples"))
    texts = rows.select("row", F.coalesce(F.col("doc").getField(text).cast("string"), F.lit("")).alias("body"))
    roots = components(_compared(texts, materialised(placed, "dedup-placed"), shingle, least), "a", "b")
    groups = nodes.join(roots, "node", "left").select("same", F.coalesce("root", "node").alias("group"))
    ranked = rows.select("row", "same", F.col("doc").getField(doc_id).alias("id")).join(groups, "same")
    first = ranked.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("m"))
    return rows.join(first.select(F.col("m.row").alias("row")), "row", "left_semi").select("doc.*")


def _compared(texts: DataFrame, nodes: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links (a, b) that connect all texts which share a sample and are similar enough.

    Each text of a bucket (a sample of one view, or close fingerprints) meets the bucket's first text; what is not
    linked to it meets the text of the bucket with the most links so far. Both rounds only save work: then every two
    texts of a bucket that are not yet in one component are compared.
    """
    bucket = ["view", "print"]
    views = nodes.select("node", F.posexplode("samples").alias("view", "print"))
    first = views.groupBy(*bucket).agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    shared = materialised(views.join(first.select(*bucket, "b"), bucket), "dedup-views")
    by_first = _similar_pairs(texts, shared.select(F.col("node").alias("a"), "b"), shingle, least)

    linked = by_first.select(F.col("a").alias("node"), "b", F.lit(True).alias("linked"))
    met = shared.join(linked, ["node", "b"], "left").select(*bucket, "node", (F.col("linked").isNotNull() | (F.col("node") == F.col("b"))).alias("linked"))
    ends = by_first.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    open_ = met.where("NOT linked").select(*bucket).distinct()
    ranked = met.join(open_, bucket, "left_semi").join(ends, "node", "left").join(first.select(*bucket, "b"), bucket).where("node <> b")
    rank = F.struct(F.coalesce("links", F.lit(0)), -F.col("node"))
    second = ranked.groupBy(*bucket).agg(F.max_by("node", rank).alias("b"))
    by_second = _similar_pairs(texts, met.where("NOT linked").join(second, bucket).select(F.col("node").alias("a"), "b"), shingle, least)

    links = materialised(by_first.unionByName(by_second), "dedup-links")
    return links.unionByName(_rest_compared(texts, shared.select(*bucket, "node"), links, shingle, least))


def _similar_pairs(texts: DataFrame, pairs: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) of different nodes, each once, whose texts are similar enough.

    Texts travel, not their sets of shingles: these are numbers of 64 bits that do not compress.
    """
    pairs = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = materialised(pairs.distinct(), "dedup-pairs")
    with_a = pairs.join(texts.select(F.col("row").alias("a"), F.col("body").alias("x")), "a")
    with_both = with_a.join(texts.select(F.col("row").alias("b"), F.col("body").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for some in portions(whole.column(2)):
                batch = whole.slice(some.start, some.stop - some.start)
                x, y = (c.to_pylist() for c in batch.columns[2:])
                good = [i for i in range(len(x)) if similar(x[i], y[i], shingle) >= least]
                yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return materialised(with_both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "dedup-similar")


def _rest_compared(texts: DataFrame, members: DataFrame, links: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links (a, b) of all similar texts of one bucket (view, print) that ``links`` do not connect yet.

    Texts of a bucket are dealt into blocks, those of its largest component apart from the others; two blocks meet in
    one row and only similar pairs leave it. Blocks of the largest component do not meet each other.
    """
    bucket = ["view", "print"]
    roots = components(links, "a", "b")
    rooted = members.join(roots, "node", "left").select(*bucket, "node", F.coalesce("root", "node").alias("root"))
    parts = rooted.groupBy(*bucket, "root").agg(F.count("*").alias("n"))
    most = parts.groupBy(*bucket).agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.count("*").alias("parts")).where("parts > 1")
    apart = rooted.join(most.select(*bucket, "major"), bucket).withColumn("major", F.col("root") == F.col("major"))
    apart = materialised(apart, "dedup-apart")

    def make() -> Callable[[list[str]], list]:
        return lambda some: [[np.unique(shingle_hashes(t, shingle)).astype(np.int64) for t in some]]

    wanted = texts.join(apart.select(F.col("node").alias("row")).distinct(), "row", "left_semi")
    sets = with_text_columns(wanted, "body", make, {"set": "array<long>"}, ["row"]).withColumn("size", F.size("set"))
    sets = materialised(sets.withColumnRenamed("row", "node"), "dedup-sets")
    sized = apart.join(sets.select("node", "size"), "node").groupBy(*bucket, "major").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("size") / BLOCK_SHINGLES)).alias("blocks")
    )
    dealt = apart.join(sized, [*bucket, "major"]).select(*bucket, "major", F.pmod(F.xxhash64("node", F.lit(7)), "blocks").alias("block"), "node", "root")
    blocks = dealt.join(sets, "node").groupBy(*bucket, "major", "block").agg(F.collect_list(F.struct("node", "root", "size", "set")).alias("texts"))
    blocks = materialised(blocks, "dedup-blocks")
    side = lambda s: blocks.select(*bucket, *[F.col(c).alias(f"{c}_{s}") for c in ("major", "block", "texts")])
    ordered = F.when(F.col("major_x") == F.col("major_y"), F.col("block_x") <= F.col("block_y")).otherwise(F.col("major_y"))
    met = side("x").join(side("y"), bucket).where(~(F.col("major_x") & F.col("major_y")) & ordered)

    def alike(x: Column, y: Column) -> Column:
        total = x["size"] + y["size"]
        enough = F.exists(F.array(F.size(F.array_intersect(x["set"], y["set"]))), lambda n: n / (total - n) >= least)
        bound = F.least(x["size"], y["size"]) >= F.greatest(x["size"], y["size"]) * (least - 1e-9)
        return (x["root"] != y["root"]) & bound & ((total == 0) | enough)

    found = F.transform("texts_x", lambda x: F.transform(F.filter("texts_y", lambda y: alike(x, y)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"))))
    return materialised(met.select(F.explode(F.flatten(found)).alias("e")).select("e.a", "e.b"), "dedup-rest")
