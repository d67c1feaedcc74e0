"""Near-duplicate vectors by a dual traversal of cover trees.

Vectors of a label with equally many components, brought to length one, form a tree: levels of nodes whose radii fall, each node
with a centre and its reach to the farthest vector below. The top of the tree is grown by Spark, level by level: a node with
more vectors than a block holds gets centres from a bounded sample of its own, and every vector goes to the nearest. The
nodes at the end are blocks; below, every block has a tree of its own, with halving radii, built once and kept beside it.
Two trees are walked together from the top: a pair of nodes is left when the distance of its centres exceeds the sum of both
reaches by more than the threshold's distance. So pairs of blocks are pruned before anything is shipped for them, and what remains
inside a pair is compared exactly by cosine, in one product where pruning further would cost more. A tile returns
how many links each vector has and a spanning forest of them, so a dense group never leaves a task as pairs.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .components import components, merge_links
from .vectors import numbered, share_of

BLOCK = 2048
RADII = (1.0, 0.5, 0.25, 0.125, 0.0625)  # below the root, which covers the whole unit sphere
SLACK = 1e-9  # above the rounding of a distance between unit vectors
CENTRES, SAMPLE = 32, 512  # children of a node of the top, and vectors among which their centres are chosen
DEEPEST = 12  # levels of the top; what is still too full then is dealt by row number
CHEAP = 32  # cells of a product that cost as much as looking at one pair of nodes
AT_ONCE = 1 << 22  # cells of a product that are held


@dataclass
class Level:
    """Nodes of one level: their centres, reach to the farthest vector below, and the places of their children."""

    centre: np.ndarray
    reach: np.ndarray
    first: np.ndarray  # children of node i are first[i] .. first[i + 1] in the next level


def build(points: np.ndarray) -> list[Level]:
    """Levels from the root to single vectors; nodes of a level are ordered by their parents."""
    everyone = np.arange(len(points))
    groups = [(0, everyone)]
    levels: list[Level] = []
    for radius in (*RADII, None):
        below: list[tuple[int, np.ndarray]] = []
        first = [0]
        for _, members in groups:
            if radius is None or len(members) == 1:
                below += [(int(m), members[i : i + 1]) for i, m in enumerate(members)]
            else:
                below += _cover(points, members, radius)
            first.append(len(below))
        levels.append(_level(points, groups, np.array(first)))
        groups = below
    levels.append(_level(points, groups, np.zeros(len(groups) + 1, dtype=np.int64)))
    return levels


def _level(points: np.ndarray, groups: list[tuple[int, np.ndarray]], first: np.ndarray) -> Level:
    reach = [
        0.0 if len(m) == 1 else float(np.sqrt(np.square(points[m] - points[c]).sum(axis=1).max())) for c, m in groups
    ]
    return Level(np.array([c for c, _ in groups], dtype=np.int64), np.array(reach), first)


def _cover(points: np.ndarray, members: np.ndarray, radius: float) -> list[tuple[int, np.ndarray]]:
    """Centres at least ``radius`` apart, the parent's own first, with what each is the first to cover."""
    found = []
    while len(members):
        centre = members[0]
        near = np.square(points[members] - points[centre]).sum(axis=1) <= radius * radius
        near[0] = True
        found.append((int(centre), members[near]))
        members = members[~near]
    return found


def ranges(levels: list[Level]) -> list[np.ndarray]:
    """For every level where the vectors of its nodes begin in the order of the lowest level; one more entry ends the last."""
    found = [np.arange(len(levels[-1].centre) + 1)]
    for level in reversed(levels[:-1]):
        found.append(found[-1][level.first])
    return found[::-1]


def traverse(
    left: np.ndarray, right: np.ndarray, cosine: float, same: bool,
    a_levels: list[Level] | None = None, b_levels: list[Level] | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked unit vectors of two blocks, in portions; of one block (``same``) each pair once."""
    limit = np.sqrt(max(2 - 2 * cosine, 0)) + SLACK
    a_levels = a_levels or build(left)
    b_levels = a_levels if same else b_levels or build(right)
    a_range, b_range = ranges(a_levels), ranges(b_levels)
    a = b = np.zeros(1, dtype=np.int64)
    for depth in range(len(a_levels)):
        one, two = a_levels[depth], b_levels[depth]
        apart = _dots(left, right, one.centre[a], two.centre[b])
        near = np.sqrt(np.maximum(2 - 2 * apart, 0)) <= limit + SLACK + one.reach[a] + two.reach[b]
        a, b = a[near], b[near]
        if not len(a):
            return
        cells = (np.diff(a_range[depth])[a] * np.diff(b_range[depth])[b]).sum()
        if depth == len(a_levels) - 1:
            break
        sizes_a, sizes_b = one.first[a + 1] - one.first[a], two.first[b + 1] - two.first[b]
        if (sizes_a * sizes_b).sum() * CHEAP > cells:
            break  # products of what is left cost less than looking at all its pairs of children
        a, b = _children(one.first[a], sizes_a, two.first[b], sizes_b)
        if same:  # nodes are ordered by parents, so a pair and its mirror are told apart at every level
            a, b = a[a <= b], b[a <= b]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    rows, columns = a_levels[-1].centre, b_levels[-1].centre
    edges = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]]))
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        first, last = (int(a_range[depth][a[i] + k]) for k in (0, 1))
        starts, ends = b_range[depth][b[i:j]], b_range[depth][b[i:j] + 1]
        others = np.concatenate([np.arange(x, y) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)])
        step = max(AT_ONCE // len(others), 1)
        for begin in range(first, last, step):
            mine = np.arange(begin, min(begin + step, last))
            linked = left[rows[mine]] @ right[columns[others]].T >= cosine
            if same:
                linked &= mine[:, None] < others[None, :]
            x, y = np.nonzero(linked)
            if len(x):
                yield rows[mine[x]], columns[others[y]]


def _dots(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of listed pairs; lists that are full rectangles are one matrix product."""
    rows, a_at = np.unique(a, return_inverse=True)
    columns, b_at = np.unique(b, return_inverse=True)
    if len(rows) * len(columns) <= 4 * len(a):
        return (left[rows] @ right[columns].T)[a_at, b_at]
    return np.einsum("ij,ij->i", left[a], right[b])


def _children(first_a, sizes_a, first_b, sizes_b) -> tuple[np.ndarray, np.ndarray]:
    total = sizes_a * sizes_b
    pair = np.repeat(np.arange(len(total)), total)
    within = np.arange(len(pair)) - np.repeat(np.cumsum(total) - total, total)
    return first_a[pair] + within // sizes_b[pair], first_b[pair] + within % sizes_b[pair]


def spread_centres(sample: np.ndarray, count: int = CENTRES) -> np.ndarray:
    """Centres of a sample, each the vector farthest from those before; equal vectors give one."""
    chosen = [0]
    apart = np.square(sample - sample[0]).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and apart.max() > 1e-12:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, np.square(sample - sample[chosen[-1]]).sum(axis=1))
    return sample[chosen]


def _units_of(rows: DataFrame) -> DataFrame:
    """Vectors of length one, without zero vectors; ``node`` is the root of each label and number of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = [np.asarray(v.values.cast(pa.float64())) for v in batch.column("vector")]
            keep = [i for i, v in enumerate(matrix) if np.any(v)]
            units = []
            for i in keep:
                scaled = matrix[i] / np.abs(matrix[i]).max()  # so that squares neither overflow nor vanish
                units.append((scaled / np.linalg.norm(scaled)).tobytes())
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.select(["row", "node"]).columns, pa.array(units, pa.binary())], names=["row", "node", "unit"])

    root = F.xxhash64(F.struct("label", "width"), F.lit(0))
    named = rows.filter("label is not null and width is not null").withColumn("node", root)
    return named.select("row", "node", "vector").mapInArrow(run, "row long, node long, unit binary")


def _grown(units: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``(row, unit, node)`` with the block of every vector, and the nodes of every level of the top.

    Nodes are ``(node, parent, centre, reach, n)``. A node that is not divided is its own only child.
    """

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """To the nearest centre of the node, with the distance to it."""
        for batch in batches:
            nodes, found, apart, centre = [], [], [], []
            known: dict[int, list[np.ndarray]] = {}
            for row, node, unit, centres in zip(*(batch.column(n) for n in ("row", "node", "unit", "centres")), strict=True):
                own = np.frombuffer(unit.as_buffer())
                at, parent = 0, node.as_py()
                if centres.is_valid:
                    if parent not in known:
                        known = {parent: np.frombuffer(centres.as_buffer()).reshape(-1, len(own))}
                    far = np.square(known[parent] - own).sum(axis=1)
                    at = int(far.argmin())
                    if len(far) == 1:  # nothing tells these vectors apart: they are dealt out
                        at = -1 - (row.as_py() * 0x9E3779B1 >> 7) % CENTRES
                    centre.append(known[parent][max(at, 0)].tobytes())
                    apart.append(float(np.sqrt(far[max(at, 0)])))
                    found.append(at)
                else:
                    centre.append(None)
                    apart.append(None)
                    found.append(None)
                nodes.append(parent)
            arrays = [batch.column("row"), batch.column("unit"), pa.array(nodes, pa.int64()), pa.array(found, pa.int64())]
            arrays += [pa.array(apart, pa.float64()), pa.array(centre, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "unit", "parent", "at", "apart", "centre"])

    def chosen(table: pa.Table) -> pa.Table:
        sample = np.stack([np.frombuffer(u.as_buffer()) for u in table["unit"]])
        count = min(CENTRES, max(2, math.ceil(2 * table["n"][0].as_py() / BLOCK)))  # blocks of half the size on the average
        return pa.table({"node": table["node"][:1], "centres": pa.array([spread_centres(sample, count).tobytes()], pa.binary())})

    levels: list[DataFrame] = []
    placed = stage(units, "units")
    for _ in range(DEEPEST):
        full = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
        if full.isEmpty():
            break
        order = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("row"), "row"))
        sample = placed.join(full.hint("merge"), "node").withColumn("place", order).filter(F.col("place") <= SAMPLE)
        centres = sample.select("node", "n", "unit").groupBy("node").applyInArrow(chosen, "node long, centres binary")
        kind = "row long, unit binary, parent long, at long, apart double, centre binary"
        near = placed.join(centres.hint("merge"), "node", "left").select("row", "node", "unit", "centres").mapInArrow(moved, kind)
        child = F.when(F.col("at").isNull(), F.col("parent")).otherwise(F.xxhash64("parent", "at"))
        placed = stage(near.withColumn("node", child), "placed")
        levels.append(placed.groupBy("node").agg(
            F.min("parent").alias("parent"), F.max("centre").alias("centre"), F.max("apart").alias("reach"), F.count(F.lit(1)).alias("n")
        ))
        placed = placed.select("row", "unit", "node")
    return placed, levels


def _written(rows: np.ndarray, units: np.ndarray, levels: list[Level]) -> bytes:
    return pickle.dumps((rows, units, [(x.centre, x.reach, x.first) for x in levels]))


def _read(block: pa.BinaryScalar) -> tuple[np.ndarray, np.ndarray, list[Level]]:
    rows, units, levels = pickle.loads(block.as_buffer())
    return rows, units, [Level(*x) for x in levels]


def _packed_blocks(placed: DataFrame, cosine: float) -> DataFrame:
    """``(node, share, shares, centre, reach, block)``: a block's rows, vectors and tree, built once."""
    sizes = placed.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("shares"))
    dealt = placed.join(sizes.hint("merge"), "node").withColumn("share", share_of(F.col("row"), F.col("shares")))

    def packed(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table["row"]), kind="stable")
        rows = np.asarray(table["row"])[order]
        units = np.stack([np.frombuffer(table["unit"][i].as_buffer()) for i in order.tolist()])
        levels = build(units)
        root = levels[0]
        return pa.table({
            "node": table["node"][:1], "share": table["share"][:1], "centre": pa.array([units[root.centre[0]].tobytes()], pa.binary()),
            "reach": pa.array([float(root.reach[0])]), "block": pa.array([_written(rows, units, levels)], pa.binary()),
        })

    schema = "node long, share long, centre binary, reach double, block binary"
    return stage(dealt.select("node", "share", "row", "unit").groupBy("node", "share").applyInArrow(packed, schema), "blocks")


def _block_pairs(blocks: DataFrame, levels: list[DataFrame], roots: DataFrame, cosine: float) -> DataFrame:
    """Pairs of blocks ``(a, a_share, b, b_share)`` that may hold links, found from the root down."""
    limit = float(np.sqrt(max(2 - 2 * cosine, 0))) + 2 * SLACK

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n) for n in ("a_centre", "b_centre", "a_reach", "b_reach")]
            stay = []
            for one, two, r, q in zip(*columns, strict=True):
                if not one.is_valid or not two.is_valid:  # a node that was not divided
                    stay.append(True)
                    continue
                apart = np.linalg.norm(np.frombuffer(one.as_buffer()) - np.frombuffer(two.as_buffer()))
                stay.append(bool(apart <= limit + r.as_py() + q.as_py()))
            yield batch.filter(pa.array(stay, pa.bool_()))

    def pruned(pairs: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
        sides = []
        for side in "ab":
            names = [F.col(c).alias(f"{side}{'' if c == 'node' else '_' + c}") for c in keys]
            sides.append(children.select(F.col("parent").alias(f"{side}_up"), *names, F.col("centre").alias(f"{side}_centre"), F.col("reach").alias(f"{side}_reach")))
        both = pairs.select(F.col("a").alias("a_up"), F.col("b").alias("b_up")).join(sides[0], "a_up").join(sides[1], "b_up")
        ends = [[f"{side}{'' if c == 'node' else '_' + c}" for c in keys] for side in "ab"]
        # of children of one node each pair comes once
        once = (F.col("a_up") != F.col("b_up")) | (F.struct(*ends[0]) <= F.struct(*ends[1]))
        kept = [*ends[0], *ends[1], "a_centre", "b_centre", "a_reach", "b_reach"]
        found = both.filter(once).select(*kept)
        return found.mapInArrow(near, found.schema).select(*ends[0], *ends[1])

    pairs = roots.select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in levels:
        pairs = pruned(pairs, level, ["node"])
    leaves = blocks.select(F.col("node").alias("parent"), "node", "share", "centre", "reach")
    return stage(pruned(pairs, leaves, ["node", "share"]), "pairs")


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.98, id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` with one row per row of ``vectors``.

    Rows are compared when their labels are equal and not null and their vectors have equally many components. Vectors that
    are null, empty, zero, or with null or non-finite components link with nothing. Every row counts for itself: repeated
    rows are linked like any others. ``component_id`` is the smallest id that links lead to, a null id last.
    """
    rows = numbered(vectors, id, vector, label)
    units = stage(_units_of(rows), "roots")
    placed, levels = _grown(units)
    blocks = _packed_blocks(placed, cosine)
    pairs = _block_pairs(blocks, levels, units.select("node").distinct(), cosine)
    linked = stage(tiles_of(blocks, pairs).mapInArrow(_compare(cosine), "row long, links long, first long"), "links")
    counts = linked.groupBy("row").agg(F.sum("links").alias("n_links"))
    groups = components(linked.select(F.col("row").alias("a"), F.col("first").alias("b")))
    named = stage(
        rows.select("row", "vec_id")
        .join(counts, "row", "left")
        .join(groups.withColumnRenamed("node", "row"), "row", "left")
        .select("row", "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                F.coalesce("component", "row").alias("component")),
        "named",
    )
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return named.join(least, "component").select(
        F.col("vec_id").alias(id), "n_links", "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def tiles_of(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """The two blocks of every pair; the second is null where a block meets itself."""
    one = blocks.select(F.col("node").alias("a"), F.col("share").alias("a_share"), F.col("block").alias("one"))
    two = blocks.select(F.col("node").alias("b"), F.col("share").alias("b_share"), F.col("block").alias("two"))
    own = (F.col("a") == F.col("b")) & (F.col("a_share") == F.col("b_share"))
    apart = pairs.filter(~own).join(one, ["a", "a_share"]).join(two, ["b", "b_share"]).select("one", "two")
    alone = pairs.filter(own).join(one, ["a", "a_share"]).select("one", F.lit(None).cast("binary").alias("two"))
    return apart.unionByName(alone)


def _compare(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column("one"), batch.column("two"), strict=True):
                rows, left, a_levels = _read(one)
                same = not two.is_valid
                more, right, b_levels = (rows, left, a_levels) if same else _read(two)
                shift = 0 if same else len(rows)
                names = rows if same else np.concatenate([rows, more])
                counts, parent = np.zeros(len(names), dtype=np.int64), np.arange(len(names))
                for a, b in traverse(left, right, cosine, same, a_levels, b_levels):
                    b = b + shift
                    counts += np.bincount(a, minlength=len(names)) + np.bincount(b, minlength=len(names))
                    parent = merge_links(parent, a, b)
                linked = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[linked]), pa.array(counts[linked]), pa.array(names[parent[linked]])],
                    names=["row", "links", "first"],
                )

    return run
