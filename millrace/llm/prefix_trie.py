"""A trie of conversation prefixes: what conversations share turn by turn, with sums over subtrees.

Every prefix of a conversation has a digest that chains those of its turns, and every distinct digest is a node. Nodes are
dealt to shards of bounded size that hold whole subtrees: the conversations' remaining turns bound a subtree's size
without looking into it, so the topmost node under a limit begins a shard. Nodes above the limit form a smaller trie
of the same kind with a limit that is a fixed factor higher, and so on up to the root. In a shard a minimal perfect hash
gives every digest a slot, and the digest found there is compared, so a digest from elsewhere has none. Counts lie in flat arrays by
slot, and sums go up through the array of parent slots, deepest nodes first; tops hand their sums to the next level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

LIMIT = 4096  # nodes of a subtree that is not divided further
FAN = 256  # a limit of the next level is so many times the one before
SHARD = 1 << 16  # nodes of a shard: many subtrees share one
PORTION = 1 << 16  # characters of conversation ids that are handed on at once
ROOT = bytes(16)
SPARE = 1.6  # places per key of a step of the perfect hash


class Slots:
    """A minimal perfect hash of distinct 16-byte digests: ``count`` digests have the slots 0 to ``count`` - 1.

    In each step the digests left are hashed to somewhat more places than they are; those that have a place
    to themselves take it, the others go on. A slot is the rank of its place among all places taken.
    """

    def __init__(self, digests: np.ndarray) -> None:
        self.steps: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, taken = digests, 0
        while len(left):
            size = int(len(left) * SPARE) + 1
            at = self._places(left, len(self.steps), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = taken + np.cumsum(alone) - 1
            self.steps.append((size, alone, rank))
            taken += int(alone.sum())
            left = left[~alone[at]]
        self.table = np.zeros_like(digests)
        self.table[self._slots(digests)] = digests

    @staticmethod
    def _places(digests: np.ndarray, step: int, size: int) -> np.ndarray:
        turned = digests[:, 0] ^ (digests[:, 1] * np.uint64(2 * step + 1)) ^ np.uint64(step * 0x9E3779B97F4A7C15 % 2**64)
        turned *= np.uint64(0xFF51AFD7ED558CCD)
        turned ^= turned >> np.uint64(32)
        return (((turned >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)

    def _slots(self, digests: np.ndarray) -> np.ndarray:
        found, left = np.full(len(digests), -1, dtype=np.int64), np.arange(len(digests))
        for step, (size, alone, rank) in enumerate(self.steps):
            at = self._places(digests[left], step, size)
            hit = alone[at]
            found[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return found

    def of(self, digests: np.ndarray) -> np.ndarray:
        """The slot of every digest, -1 for one that is not among those hashed."""
        found = self._slots(digests)
        known = found >= 0
        known[known] = (self.table[found[known]] == digests[known]).all(axis=1)
        return np.where(known, found, -1)


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, dtype=np.uint64).reshape(-1, 2).copy()


def accumulate(table: pa.Table) -> pa.Table:
    """Children, leaves and saved tokens of the nodes of a shard, with what tops further down have handed up."""
    digests, count = _digests(table["node"]), len(table)
    slots = Slots(digests)
    own = slots.of(digests)
    parents = _digests(table["parent"])
    parents[table["depth"].to_numpy() == 0] = np.uint64(2**64 - 1)  # the root has none
    up = np.empty(count, dtype=np.int64)
    up[own] = slots.of(parents)

    def flat(name: str) -> np.ndarray:
        values = np.empty(count, dtype=np.int64)
        values[own] = table[name].to_numpy()
        return values

    depth, conv = flat("depth"), flat("conv_id")
    children, leaves = flat("children"), flat("leaves")
    saved = flat("saved") + (flat("n_convs") - 1) * flat("size")
    inside = up >= 0
    children += np.bincount(up[inside], minlength=count)
    leaves += children == 0
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        level = level[inside[level]]
        np.add.at(leaves, up[level], leaves[level])
        np.add.at(saved, up[level], saved[level])
    above = pa.array(conv[up], mask=~inside)
    return pa.table({
        "node": table["node"], "parent": table["parent"], "top": pa.array(~inside[own]),
        "above": above.take(pa.array(own)), "n_children": children[own], "n_leaves": leaves[own], "saved_tokens": saved[own],
    })


def rebuilt(conversations: DataFrame, id: str, turn: str, role: str, text: str, first: Column, base: Column) -> DataFrame:
    """``(conv_id, turns)``: the first turns of the conversation ``base``, as many as ``first`` says, then the own ones after them.

    ``first`` and ``base`` are made from ``conv_id``. A turn is its digest and the bytes of its text.
    """
    known = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    digest = F.unhex(F.md5(F.concat(F.octet_length(known[0]).cast("string"), F.lit(":"), *known).cast("binary")))
    rows = conversations.select(
        F.col(f"`{id}`").cast("long").alias("conv_id"),
        F.struct(F.col(f"`{turn}`").cast("long"), digest.alias("digest"), F.octet_length(known[1]).cast("long").alias("size")).alias("t"),
    ).filter("conv_id is not null")
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size")))
    own = stage(rows.groupBy("conv_id").agg(turns.alias("turns")), "turns")
    others = own.select(F.col("conv_id").alias("_base"), F.col("turns").alias("_others"))
    joined = own.withColumns({"_first": first.cast("int"), "_base": base}).join(others.hint("merge"), "_base", "left")
    mine = F.filter("turns", lambda t, i: i >= F.col("_first"))
    theirs = F.filter(F.coalesce("_others", F.filter("turns", lambda t: F.lit(False))), lambda t, i: i < F.col("_first"))
    return joined.select("conv_id", F.concat(theirs, mine).alias("turns"))


def paths_of(convs: DataFrame) -> DataFrame:
    """``(conv_id, nodes, sizes)``, written once: digests of all prefixes of a conversation and the bytes of their last text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes = [], []
            for turns in batch.column("turns").to_pylist():
                chain = [ROOT]
                for t in turns:
                    chain.append(hashlib.blake2b(chain[-1] + t["digest"], digest_size=16).digest())
                nodes.append(chain)
                sizes.append([0, *(t["size"] for t in turns)])
            arrays = [batch.column("conv_id"), pa.array(nodes, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "nodes", "sizes"])

    return stage(convs.mapInArrow(run, "conv_id long, nodes array<binary>, sizes array<long>"), "paths")


def _shards(paths: DataFrame, nodes: DataFrame, limits: list[int]) -> DataFrame:
    """``nodes`` with ``level``, the lowest whose limit holds the node's subtree, and ``start``, the top of its part of the trie."""
    leveled = nodes.withColumn("level", sum((F.col("weight") > limit).cast("int") for limit in limits))
    large = leveled.filter("level > 0").select("node", "level")
    steps = paths.select("conv_id", F.posexplode("nodes").alias("depth", "node"))
    # the large nodes of a conversation are the first ones of its path, and levels fall along it
    levels = (
        steps.join(large.hint("merge"), "node")
        .groupBy("conv_id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "level"))), lambda x: x["level"]).alias("levels"))
    )
    known = paths.join(levels.hint("merge"), "conv_id", "left").select(
        "conv_id", "nodes", F.transform("nodes", lambda x, i: F.coalesce(F.get("levels", i), F.lit(0))).alias("levels")
    )
    starts = known.select(
        "conv_id",
        F.posexplode(F.transform("levels", lambda x: F.element_at("nodes", F.array_position("levels", x).cast("int")))).alias("depth", "start"),
    )
    # each node by the path of its smallest member
    return leveled.join(starts.hint("merge"), ["conv_id", "depth"])


def _ends(paths: DataFrame) -> DataFrame:
    """``(node, ends_sha256)`` for nodes where conversations end: ids in order, packed before they meet."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size = None, None, [], 0

        def portion() -> pa.RecordBatch:
            arrays = [pa.array([node], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(held)])]
            return pa.RecordBatch.from_arrays(arrays, names=["node", "first", "ids"])

        for batch in batches:
            for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (own != node or size > PORTION):
                    yield portion()
                    held, size = [], 0
                if not held:
                    node, first = own, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield portion()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own == node:
                    digest.update(b",")
                else:
                    done += [] if node is None else [(node, digest.hexdigest())]
                    node, digest = own, hashlib.sha256()
                digest.update(ids.encode())
            yield _named(done)
        yield _named([] if node is None else [(node, digest.hexdigest())])

    def _named(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
        arrays = [pa.array([n for n, _ in rows], pa.binary()), pa.array([d for _, d in rows], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["node", "ends_sha256"])

    last = paths.select(F.element_at("nodes", -1).alias("node"), "conv_id")
    portions = last.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(
        pack, "node binary, first long, ids string"
    )
    ordered = portions.repartition("node").sortWithinPartitions("node", "first").select("node", "ids")
    return ordered.mapInArrow(hashed, "node binary, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame, first: Column, base: Column, id: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", limit: int = LIMIT, fan: int = FAN,
) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, the empty one included.

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and
    ``ends_sha256``; see ``rebuilt`` for ``first`` and ``base``. Turns are ordered by number, null first; rows of one number are
    all turns, ordered by their digest. Null roles and texts are empty; rows without a conversation id belong to none. A text
    of any length is digested whole. Other columns are not read. Without conversations there is no node. ``limit`` and
    ``fan`` bound what a task holds and change no result. The list of a conversation's turns, 40 bytes each, is held by one task.
    """
    paths = paths_of(rebuilt(conversations, id, turn, role, text, first, base))
    sized = paths.select("conv_id", F.size("nodes").alias("length"), F.posexplode(F.arrays_zip("nodes", "sizes")).alias("depth", "x"), "nodes")
    steps = sized.select(
        "conv_id", "depth", F.col("x.nodes").alias("node"), F.col("x.sizes").alias("size"),
        F.coalesce(F.get("nodes", F.col("depth") - 1), F.lit(ROOT)).alias("parent"), (F.col("length") - 1 - F.col("depth")).alias("rest"),
    )
    nodes = stage(
        steps.groupBy("node").agg(
            F.min("conv_id").alias("conv_id"), F.min("depth").cast("int").alias("depth"), F.min("parent").alias("parent"),
            F.min("size").alias("size"), F.count(F.lit(1)).alias("n_convs"), F.sum("rest").cast("long").alias("weight"),
        ),
        "nodes",
    )
    limits = [limit]
    while limits[-1] < (nodes.agg(F.max("weight")).first()[0] or 0):
        limits.append(limits[-1] * fan)
    placed = stage(_shards(paths, nodes, limits), "placed")
    sizes = dict(placed.groupBy("level").count().collect())  # a row per level
    columns = "node binary, parent binary, top boolean, above long, n_children long, n_leaves long, saved_tokens long"
    done: DataFrame | None = None
    for level in sorted(sizes):
        own = placed.filter(F.col("level") == level)
        if done is None:
            given = own.withColumns({c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")})
        else:
            handed = done.filter("top").groupBy(F.col("parent").alias("node")).agg(
                F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
            )
            given = own.join(handed.hint("merge"), "node", "left").na.fill(0, ["children", "leaves", "saved"])
        shard = F.pmod(F.xxhash64("start"), F.lit(sizes[level] // SHARD + 1)).alias("shard")
        rows = given.select("node", "parent", "depth", "conv_id", "n_convs", "size", "children", "leaves", "saved", shard)
        found = stage(rows.groupBy("shard").applyInArrow(accumulate, columns), "sums")
        done = found if done is None else done.unionByName(found)
    if done is None:
        done = conversations.sparkSession.createDataFrame([], columns)
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    tops = done.filter("top").join(parents.hint("merge"), "parent").select("node", "parent_conv_id")
    nothing = hashlib.sha256(b"").hexdigest()
    joined = nodes.join(done.drop("parent").hint("merge"), "node").join(tops.hint("merge"), "node", "left")
    return joined.join(_ends(paths).hint("merge"), "node", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") > 0, F.coalesce("above", "parent_conv_id")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
