"""Merkle manifest of a dataset, with proofs for all rows from one multiproof a partition.

Every row is a leaf. The leaves of one source, in order, are folded by runs of 16 into the source's subroot; the
subroots, in order of the sources, are folded likewise into the root. A node is the SHA-256, in hexadecimal digits, of
its children's digits behind each other; a run of one is hashed too, a tree of one leaf is that leaf.

Leaves are sorted by ranges, so no task holds a source, and dealt into leaf partitions of a few thousand. The nodes
that a tree has above its leaves are made in rounds of three levels: 4096 children, in one group, give all nodes
above them. Then the octopus step: per leaf partition the coordinates of all nodes that its proofs need and that it can
not derive from its own leaves are worked out level by level, once for the partition; they are fetched by one join;
the partition derives the nodes its leaves share, and each proof is put together from those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.llm.common import ascii_lower, materialised

ARITY = 16
#: Levels made at a time: a group has at most 16^3 children.
LEVELS = 3
#: Leaves whose proofs are made together.
PARTITION_LEAVES = 4096
#: Key of the tree above the subroots. Sources carry a prefix, so they never equal it.
TOP = "root"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes of UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def levels_of(size: int) -> list[int]:
    """Numbers of nodes of a tree by level, from the leaves to the single top."""
    out = [size]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def missing(places: list[int], size: int) -> list[tuple[int, int]]:
    """(level, index) of the nodes that the proofs of all ``places`` need and that follow from no leaf among them.

    ``places`` ascend. Level by level, the siblings of the known nodes are missing if they are not known themselves;
    each is named once, however many proofs need it.
    """
    out: list[tuple[int, int]] = []
    known = places
    for level, n in enumerate(levels_of(size)[:-1]):
        parents = sorted({i // ARITY for i in known})
        have = set(known)
        out += [(level, i) for p in parents for i in range(p * ARITY, min(n, (p + 1) * ARITY)) if i not in have]
        known = parents
    return out


@dataclass
class SharedNodes:
    """The nodes of one tree that a leaf partition knows: fetched ones, its leaves, and what follows from both."""

    size: int
    nodes: dict[tuple[int, int], str]

    def derive(self, places: list[int]) -> None:
        """All nodes above the leaves ``places``, each hashed once."""
        known = places
        for level, n in enumerate(levels_of(self.size)[:-1]):
            known = sorted({i // ARITY for i in known})
            for p in known:
                self.nodes[level + 1, p] = digest(*[self.nodes[level, i] for i in range(p * ARITY, min(n, (p + 1) * ARITY))])

    def siblings(self, place: int) -> list[tuple[list[str], list[str]]]:
        """Per level the nodes left and right of the path from a leaf to the top."""
        out = []
        for level, n in enumerate(levels_of(self.size)[:-1]):
            low, high = place // ARITY * ARITY, min(n, (place // ARITY + 1) * ARITY)
            out.append(([self.nodes[level, i] for i in range(low, place)], [self.nodes[level, i] for i in range(place + 1, high)]))
            place //= ARITY
        return out


def fold(leaf: str, path: list[tuple[list[str], list[str]]]) -> str:
    """The top that follows from a leaf and the siblings on its path."""
    for left, right in path:
        leaf = digest(*left, leaf, *right)
    return leaf


def _numbered(rows: DataFrame, order: list[str], tree: str, purpose: str) -> DataFrame:
    """``rows`` with ``part`` (a task's share, cut into leaf partitions) and ``place``, the rank within ``tree``.

    Rows are sorted by ranges of ``order``; each task numbers its rows per tree while it writes them, and the counts
    of earlier tasks, a table with one row per tree and task, are added afterwards.
    """
    rows = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    names = rows.columns
    key = names.index(tree)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, ahead = TaskContext.get().partitionId(), 0, 0
        last = None
        for batch in batches:
            parts, before = [], []
            for name in batch.column(key).to_pylist():
                ahead, last = (ahead if name == last else 0), name
                parts.append(task << 32 | seen // PARTITION_LEAVES)
                before.append(ahead)
                seen, ahead = seen + 1, ahead + 1
            new = [pa.array([task] * len(parts), pa.int32()), pa.array(parts, pa.int64()), pa.array(before, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, "__task", "part", "__ahead"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", __task int, part long, __ahead long"
    rows = materialised(rows.mapInArrow(number, schema), purpose)
    counts = rows.groupBy(tree, "__task").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(tree).orderBy("__task").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = counts.select(tree, "__task", (F.sum("__n").over(upto) - F.col("__n")).alias("__base"))
    return rows.join(bases, [tree, "__task"]).withColumn("place", F.col("__base") + F.col("__ahead")).drop("__task", "__base", "__ahead")


def _above(leaves: DataFrame, purpose: str) -> DataFrame:
    """(tree, level, index, hash) of all nodes over ``leaves`` (tree, place, hash, size), the tops included."""
    span = ARITY**LEVELS

    def raise_(key: tuple, group: pa.Table) -> pa.Table:
        tree, block, size = (k.as_py() for k in key)
        order = sorted(zip(group.column("place").to_pylist(), group.column("hash").to_pylist(), strict=True))
        hashes, first, out = [h for _, h in order], block * span, []
        for level in range(1, LEVELS + 1):
            if size == 1:
                break
            first, size = first // ARITY, -(-size // ARITY)
            hashes = [digest(*hashes[i : i + ARITY]) for i in range(0, len(hashes), ARITY)]
            out += [(tree, level, first + i, h, size) for i, h in enumerate(hashes)]
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.table(dict(zip(("tree", "rise", "place", "hash", "size"), map(pa.array, columns, (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64())), strict=True)))

    nodes, base = None, 0
    while True:
        grouped = leaves.where("size > 1").groupBy("tree", F.floor(F.col("place") / span).alias("block"), "size")
        made = materialised(grouped.applyInArrow(raise_, "tree string, rise int, place long, hash string, size long"), purpose)
        new = made.select("tree", (F.col("rise") + base).cast("int").alias("level"), F.col("place").alias("index"), "hash", "size")
        nodes = new if nodes is None else nodes.unionByName(new)
        base += LEVELS
        leaves = made.where(F.col("rise") == LEVELS).drop("rise")
        if leaves.where("size > 1").isEmpty():
            return nodes


def _needed(places: DataFrame) -> DataFrame:
    """(part, tree, level, index): what each leaf partition has to fetch, from its places (part, tree, place, size)."""

    def plan(key: tuple, group: pa.Table) -> pa.Table:
        part = key[0].as_py()
        by_tree: dict[tuple[str, int], set[int]] = {}
        for tree, place, size in zip(*(group.column(c).to_pylist() for c in ("tree", "place", "size")), strict=True):
            by_tree.setdefault((tree, size), set()).add(place)
        out = [(part, t, level, i) for (t, size), at in by_tree.items() for level, i in missing(sorted(at), size)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table(dict(zip(("part", "tree", "level", "index"), map(pa.array, columns, (pa.int64(), pa.string(), pa.int32(), pa.int64())), strict=True)))

    return places.groupBy("part").applyInArrow(plan, "part long, tree string, level int, index long")


def manifest(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text: str = "text", tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row of ``docs``.

    The proof of a leaf is the list of its siblings, level by level up to the root; ``folded_root`` is what the leaf and
    its proof give. Where ``tampered`` holds, ``folded_root`` starts from the leaf of the row with its text in lower case
    (A-Z), which shows in ``verified`` unless there was nothing to change. A null source is a tree of its own, before all
    others; null ids come first; rows with the same id are ordered by their leaves, so equal rows differ in their
    proofs only. An empty table has no tree and no rows.
    """
    values = [F.col(f"`{c}`") for c in columns]
    changed = [ascii_lower(F.col(f"`{c}`").cast("string")) if c == text else F.col(f"`{c}`") for c in columns]
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("s:"), F.col(f"`{source}`").cast("string")), F.lit("null")).alias("tree"),
        F.col(f"`{doc_id}`").alias("doc_id"),
        leaf_hash(*values).alias("hash"),
        F.when(F.lit(False) if tampered is None else tampered, leaf_hash(*changed)).alias("tampered"),
    )
    leaves = _numbered(leaves, ["tree", "doc_id", "hash"], "tree", "merkle-leaves")
    sizes = leaves.groupBy("tree").agg((F.max("place") + 1).alias("size"))
    leaves = materialised(leaves.join(sizes, "tree"), "merkle-places")
    nodes = _above(leaves.select("tree", "place", "hash", "size"), "merkle-nodes")

    # subroots in order of the sources are the leaves of the top tree
    single = leaves.where("size = 1").select("tree", "hash")
    subroots = nodes.where("size = 1").select("tree", "hash").unionByName(single)
    tops = subroots.select(F.lit(TOP).alias("__top"), F.col("tree").alias("source"), "hash")
    tops = _numbered(tops, ["__top", "source"], "__top", "merkle-subroots").drop("part", "__top")
    n_sources = tops.count()
    tops = materialised(tops.withColumn("size", F.lit(n_sources).cast("long")), "merkle-tops")
    upper = _above(tops.select(F.lit(TOP).alias("tree"), "place", "hash", "size"), "merkle-upper")

    top_place = tops.select(F.col("source").alias("tree"), F.col("place").alias("top_place"), F.col("hash").alias("subroot"))
    rows = leaves.join(top_place, "tree")
    level0 = [leaves.select("tree", F.lit(0).alias("level"), F.col("place").alias("index"), "hash"), tops.select(F.lit(TOP).alias("tree"), F.lit(0).alias("level"), F.col("place").alias("index"), "hash")]
    every = nodes.drop("size").unionByName(upper.drop("size")).unionByName(level0[0]).unionByName(level0[1])

    places = rows.select("part", "tree", "place", "size").unionByName(
        rows.select("part", F.lit(TOP).alias("tree"), F.col("top_place").alias("place"), F.lit(n_sources).cast("long").alias("size")).distinct()
    )
    fetched = _needed(places).join(every, ["tree", "level", "index"]).select("part", "tree", "level", "index", "hash")
    wanted = rows.select("part", "tree", "doc_id", "place", "hash", "tampered", "size", "top_place", "subroot")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def expand(rows_: pa.Table, nodes_: pa.Table) -> pa.Table:
        return _expanded(rows_, nodes_, n_sources)

    return wanted.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(expand, result)


def _expanded(rows: pa.Table, fetched: pa.Table, n_sources: int) -> pa.Table:
    """The proofs of one leaf partition from its leaves and the nodes fetched for it."""
    known: dict[str, dict[tuple[int, int], str]] = {}
    for tree, level, index, node in zip(*(fetched.column(c).to_pylist() for c in ("tree", "level", "index", "hash")), strict=True):
        known.setdefault(tree, {})[level, index] = node
    tree, place, leaf, tampered, size, top_place, subroot = (rows.column(c).to_pylist() for c in ("tree", "place", "hash", "tampered", "size", "top_place", "subroot"))
    of_tree: dict[str, list[int]] = {}
    for i, t in enumerate(tree):
        of_tree.setdefault(t, []).append(i)

    top = SharedNodes(n_sources, known.get(TOP, {}))
    trees = {}
    for t, at in of_tree.items():
        shared = SharedNodes(size[at[0]], known.get(t, {}))
        shared.nodes.update({(0, place[i]): leaf[i] for i in at})
        shared.derive(sorted(place[i] for i in at))
        trees[t] = shared
        top.nodes[0, top_place[at[0]]] = shared.nodes[len(levels_of(shared.size)) - 1, 0]
    top.derive(sorted({top_place[at[0]] for at in of_tree.values()}))
    root = top.nodes[len(levels_of(n_sources)) - 1, 0]

    proofs, folded = [], []
    upper: dict[str, list[tuple[list[str], list[str]]]] = {t: top.siblings(top_place[at[0]]) for t, at in of_tree.items()}
    for i, t in enumerate(tree):
        path = trees[t].siblings(place[i]) + upper[t]
        proofs.append(digest(*[x for left, right in path for x in (*left, *right)]))
        folded.append(fold(tampered[i] or leaf[i], path))
    return pa.table(
        {
            "doc_id": rows.column("doc_id"),
            "leaf": rows.column("hash"),
            "subroot": pa.array(subroot, pa.string()),
            "root": pa.array([root] * len(tree), pa.string()),
            "proof_sha256": pa.array(proofs, pa.string()),
            "folded_root": pa.array(folded, pa.string()),
            "verified": pa.array([f == root for f in folded], pa.bool_()),
        }
    )


def tamper_some(doc_id: str = "doc_id") -> Column:
    """Rows of the query whose text is changed: five divides the crc32 of the id as text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
