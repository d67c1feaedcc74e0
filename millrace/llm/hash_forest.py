"""Approximate nearest neighbours from a forest of hash prefixes.

Every tree gives every vector a long string of bits, the sides of random hyperplanes, and is the array of all vectors sorted by
it, cut into shelves of bounded size. A query descends in the first trees to the shelf where its own string belongs, which
holds the longest common prefixes, and learns how near its nearest vectors are at least. The nearer they are, the
likelier they share a prefix of a given length; so it then ascends in all trees together, one bit after the other, until a
vector that near would be missed with a given probability at most, and meets all vectors with such a prefix. How
many these are follows from the data: few where neighbours are near, many where they are far, and never a fixed number.

Equal vectors are one entry of the arrays, with the smallest ids of its rows, as no others can be among the nearest. For inner
products vectors get one more component that makes all equally long; it does not change their products with queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import running_totals
from .common import stage
from .vectors import numbered

TREES, BITS, SEED = 8, 62, 13
FIRST = 2  # trees in which a query descends before it ascends in all
SHELF = 4096  # vectors of a shelf
MISS = 0.04  # probability at most that a vector as near as the last one found is missed
FAN_IN = 64  # shelves whose lists are merged at once
WHOLE = 1 << BITS


def planes(width: int, tree: int) -> np.ndarray:
    """Normals of the hyperplanes of a tree; the last row belongs to the component that makes vectors equally long."""
    return np.random.default_rng([SEED, width, tree]).standard_normal((width + 1, BITS))


def strings(units: np.ndarray, rest: np.ndarray, tree: int) -> np.ndarray:
    """Bits of vectors as whole numbers, the first one highest."""
    normals = planes(units.shape[1], tree)
    sides = units @ normals[:-1] + rest[:, None] * normals[-1] > 0
    return sides @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def depths(cosine: float, miss: float = MISS) -> list[int]:
    """The length of the prefix in every tree at which a vector this near is missed with probability ``miss`` at most."""
    same = 1 - np.arccos(np.clip(cosine, -1.0, 1.0)) / np.pi  # of a bit
    for depth in range(BITS, 0, -1):
        stay, up = 1 - same**depth, 1 - same ** (depth - 1)
        for higher in range(TREES):  # the trees ascend in turn
            if stay ** (TREES - higher) * up**higher <= miss:
                return [depth - 1] * higher + [depth] * (TREES - higher)
    return [0] * TREES


def _matrix(column: pa.Array) -> np.ndarray:
    width = column.value_lengths()[0].as_py()
    return np.asarray(column.flatten().cast(pa.float64())).reshape(-1, width)


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Begins and ends of runs of equal values."""
    changed = np.logical_or.reduce([c[1:] != c[:-1] for c in columns]) if len(columns[0]) else np.zeros(0, dtype=bool)
    edges = [0, *(np.flatnonzero(changed) + 1).tolist(), len(columns[0])]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _hashed(classes: DataFrame) -> DataFrame:
    """Add ``strings``, one per tree, and ``asking``, those under which a query looks; ``longest`` is the greatest length of the width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, longest = (np.asarray(batch.column(n)) for n in ("width", "longest"))
            for a, b in _runs(widths, longest):
                part = batch.slice(a, b - a)
                vectors = _matrix(part.column("vector"))
                largest = np.abs(vectors).max(axis=1, keepdims=True)
                lengths = np.linalg.norm(vectors / largest, axis=1, keepdims=True)
                units = vectors / largest / lengths
                share = np.minimum(largest * lengths / longest[a], 1)  # of the greatest length
                rest = np.sqrt(1 - share[:, 0] ** 2)
                own = np.stack([strings(units * share, rest, t) for t in range(TREES)], axis=1)
                ask = np.stack([strings(units, np.zeros(len(units)), t) for t in range(TREES)], axis=1)
                arrays = [part.column(n) for n in ("cls", "least", "width", "vector", "asked", "longest")]
                arrays += [pa.array(largest[:, 0] * lengths[:, 0])]
                arrays += [pa.FixedSizeListArray.from_arrays(x.ravel(), TREES).cast(pa.list_(pa.int64())) for x in (own, ask)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["cls", "least", "width", "vector", "asked", "longest", "length", "strings", "asking"]
    kind = dict(classes.dtypes)["vector"]
    schema = f"cls long, least long, width int, vector {kind}, asked boolean, longest double, length double, strings array<long>, asking array<long>"
    ordered = classes.select("cls", "least", "width", "vector", "asked", "longest")
    return stage(ordered.mapInArrow(run, schema), "hashed")


def _ranks(entries: DataFrame, asked: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of ``entries`` and ``asked`` ``(width, tree, string, key)`` with ``rank``, the entries of their tree before them.

    ``asked`` has more columns, which entries leave null; a row of it comes before entries with the same string.
    """
    both = asked.withColumn("entry", F.lit(0)).unionByName(entries.withColumn("entry", F.lit(1)), allowMissingColumns=True)
    counted = running_totals(both, ["width", "tree", "string", "entry", "key"], {"through": F.col("entry").cast("long")})
    # one row per width, see vectors.py; every tree of a width has all its entries
    before = F.col("before") + F.col("tree") * F.col("n")
    return counted.join(F.broadcast(sizes), "width").withColumn("rank", F.col("through") - F.col("entry") - before)


def _scan(k: int):
    """Best ``k`` entries of a shelf for every query that visits it; rows come by shelf, entries first and sorted by string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        shelf: tuple | None = None
        current: tuple | None = None
        for batch in batches:
            keys = [np.asarray(batch.column(n)) for n in ("width", "tree", "shelf", "entry")]
            for a, b in _runs(*keys):
                part, own = batch.slice(a, b - a), tuple(int(c[a]) for c in keys)
                if own[3] == 0:
                    if own[:3] != current:
                        held, current = [], own[:3]
                    values = [np.asarray(part.column(n)) for n in ("string", "key", "least")]
                    held.append((*values, _matrix(part.column("vector"))))
                    shelf = None
                elif own[:3] == current:
                    shelf = shelf or tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    yield _visit(part, *shelf, k)

    return run


def _visit(part: pa.RecordBatch, found: np.ndarray, keys: np.ndarray, least: np.ndarray, entries: np.ndarray, k: int) -> pa.RecordBatch:
    queries, low, high = _matrix(part.column("vector")), np.asarray(part.column("low")), np.asarray(part.column("high"))
    begins, ends = np.searchsorted(found, low), np.searchsorted(found, high)
    lists: list = [[]] * len(queries)
    order = np.lexsort((ends, begins))
    for a, b in _runs(begins[order], ends[order]):
        own = order[a:b]
        first, last = int(begins[own[0]]), int(ends[own[0]])
        if first == last:
            continue
        with np.errstate(over="ignore", invalid="ignore"):
            near = np.nan_to_num(queries[own] @ entries[first:last].T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        size = last - first
        edge = np.partition(near, size - k, axis=1)[:, size - k] if size > k else np.full(len(own), -np.inf)
        edge = edge - np.abs(edge) * 1e-12 if size > k else edge  # sums in another order may differ in the last digits
        for q, scores, limit in zip(own.tolist(), near, edge, strict=True):
            at = first + np.flatnonzero(scores >= limit)
            with np.errstate(over="ignore", invalid="ignore"):
                exact = (entries[at] * queries[q]).sum(axis=1)
            best = np.lexsort((keys[at], least[at], -exact))[:k]
            at = at[best]
            lists[q] = [{"near": -s, "least": i, "cls": c} for s, i, c in zip(exact[best].tolist(), least[at].tolist(), keys[at].tolist(), strict=True)]
    arrays = [part.column("key"), part.column("tree"), part.column("shelf"), pa.array(lists, LIST)]
    return pa.RecordBatch.from_arrays(arrays, names=["query", "tree", "shelf", "found"])


LIST = pa.list_(pa.struct([("near", pa.float64()), ("least", pa.int64()), ("cls", pa.int64())]))
LIST_SQL = "array<struct<near:double,least:long,cls:long>>"


def _search(placed: DataFrame, hashed: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """``(query, tree, shelf, found)`` for every visit ``(width, tree, shelf, key, low, high)`` of a query to a shelf."""
    vectors = hashed.select(F.col("cls").alias("key"), "least", "vector")
    entries = placed.select("width", "tree", "shelf", "key", "string").join(vectors.hint("merge"), "key")
    asking = visits.join(vectors.drop("least").hint("merge"), "key")
    rows = entries.withColumn("entry", F.lit(0)).unionByName(asking.withColumn("entry", F.lit(1)), allowMissingColumns=True)
    place = ["width", "tree", "shelf"]
    columns = [*place, "entry", "string", "key", "least", "vector", "low", "high"]
    sorted_rows = rows.repartition(*place).sortWithinPartitions(*place, "entry", "string", "key").select(*columns)
    return sorted_rows.mapInArrow(_scan(k), f"query long, tree int, shelf long, found {LIST_SQL}")


def _merged(lists: DataFrame, k: int, shelves: int) -> DataFrame:
    """``(query, found)``: the best ``k`` of all lists of a query, merged a bounded number at a time."""
    best = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("found")))), 1, k).alias("found")
    while shelves > 1:
        shelves = (shelves + FAN_IN - 1) // FAN_IN
        lists = lists.withColumn("shelf", F.expr(f"shelf div {FAN_IN}")).groupBy("query", "tree", "shelf").agg(best)
    return lists.groupBy("query").agg(best)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding", miss: float = MISS
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows with the largest inner products that are found for every query row.

    ``is_query`` is a condition on ``vec_id``. A row never finds itself, but repeated rows find each other. Rows whose vector is
    null, empty, zero, or with a null or non-finite component take no part, and neither do rows with a null id. Only
    vectors with as many components as the query's are found. Ties go to the smaller id. ``score`` is the product in double
    precision; one that is no number is taken for the lowest.
    A neighbour as near as the last one found is missed with probability ``miss`` at most, nearer ones less often; a query with
    fewer than ``k`` other vectors within reach meets all. Other columns are not read, whatever their names.
    """
    rows = numbered(vectors, id, vector).filter("vec_id is not null and width is not null").filter(F.exists("vector", lambda x: x != 0))
    # of equal vectors those with the smallest ids, one more than asked for, as a query does not find itself
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id", "row"))
    members = rows.withColumn("place", place).filter(F.col("place") <= k + 1)
    grouped = members.groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("vec_id", "row"))).alias("members"), F.first("width").alias("width"))
    first = F.col("members")[0]
    classes = stage(grouped.select(first["row"].alias("cls"), first["vec_id"].alias("least"), "width", "vector", "members"), "classes")
    asked = rows.filter(is_query).select("vec_id", "row", "vector").join(classes.select("cls", "vector").hint("merge"), "vector")
    asked = stage(asked.select("vec_id", "row", "cls"), "asked")
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(x.cast("double") / F.col("largest"), 2))
    lengths = classes.withColumn("largest", largest).groupBy("width").agg(
        F.max(F.least(F.col("largest") * F.sqrt(squares), F.lit(1.7e308))).alias("longest"), F.count(F.lit(1)).alias("n")
    )
    sizes = stage(
        lengths.withColumn("before", F.coalesce(F.sum(F.col("n") * TREES).over(Window.orderBy("width").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))),
        "sizes",
    )  # a row per width
    flagged = classes.join(asked.select("cls").distinct().withColumn("asked", F.lit(True)).hint("merge"), "cls", "left")
    hashed = _hashed(flagged.na.fill(False, ["asked"]).join(F.broadcast(sizes.select("width", "longest")), "width"))

    entries = hashed.select("width", F.col("cls").alias("key"), F.posexplode("strings").alias("tree", "string"))
    queries = hashed.filter("asked")
    own = queries.select("width", F.col("cls").alias("key"), F.posexplode("asking").alias("tree", "string")).filter(F.col("tree") < FIRST)
    ranked = stage(_ranks(entries, own, sizes.select("width", "n", "before")).withColumn("shelf", F.expr(f"least(rank, n - 1) div {SHELF}")), "ranked")
    placed = ranked.filter("entry = 1")
    visits = ranked.filter("entry = 0").select("width", "tree", "shelf", "key", F.lit(0).cast("long").alias("low"), F.lit(WHOLE).alias("high"))
    shelves = (sizes.agg(F.max("n")).first()[0] or 0) // SHELF + 1
    near = stage(_merged(_search(placed.filter(F.col("tree") < FIRST), hashed, visits, k + 1), k + 1, shelves), "near")

    known = queries.join(near.withColumnRenamed("query", "cls").hint("merge"), "cls", "left")
    last = F.when(F.size("found") > k, -F.element_at("found", -1)["near"])
    bounds = known.select("width", F.col("cls").alias("key"), "asking", (last / F.col("length") / F.col("longest")).alias("cosine"))
    edges = stage(_ranks(entries, _ascended(bounds, miss), sizes.select("width", "n", "before")).filter("entry = 0"), "edges")
    ends = edges.groupBy("width", "tree", "key").agg(
        F.min("string").alias("low"), F.max("string").alias("high"), F.min("rank").alias("from"), F.max("rank").alias("to")
    )
    wide = ends.filter(F.col("from") < F.col("to")).select(
        "width", "tree", "key", "low", "high", F.explode(F.expr(f"sequence(from div {SHELF}, (to - 1) div {SHELF})")).alias("shelf")
    )
    more = _search(placed, hashed, wide, k + 1)
    lists = more.unionByName(near.select("query", F.lit(-1).alias("tree"), F.lit(0).cast("long").alias("shelf"), "found"))
    best = _merged(lists, k + 1, shelves).select("query", F.inline("found"))
    return _told(best, classes, asked, k)


def _ascended(bounds: DataFrame, miss: float) -> DataFrame:
    """``(width, tree, string, key)``: the first string of the range a query meets in every tree, and the first one behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = []
            for asking, cosine in zip(batch.column("asking").to_pylist(), batch.column("cosine").to_pylist(), strict=True):
                deep = [0] * TREES if cosine is None or cosine != cosine else depths(cosine, miss)
                low = [s >> (BITS - d) << (BITS - d) for s, d in zip(asking, deep, strict=True)]
                found += [(t, x) for t, (s, d) in enumerate(zip(low, deep, strict=True)) for x in (s, s + (1 << (BITS - d)))]
            again = [np.repeat(np.asarray(batch.column(n)), 2 * TREES) for n in ("width", "key")]
            tree, string = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
            arrays = [pa.array(again[0]), pa.array(again[1]), pa.array(tree.astype(np.int32)), pa.array(string)]
            yield pa.RecordBatch.from_arrays(arrays, names=["width", "key", "tree", "string"])

    return bounds.mapInArrow(run, "width int, key long, tree int, string long")


def _told(best: DataFrame, classes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Rows instead of classes, for every query row of a class."""
    members = classes.select("cls", "members")
    rows = best.join(members.hint("merge"), "cls").select("query", "near", F.inline("members"))
    few = rows.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("near", "vec_id", "row")))
    few = few.filter(F.col("place") <= k + 1).select(F.col("query").alias("cls"), "near", "vec_id", "row")
    own = asked.select("cls", F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"))
    met = own.join(few.hint("merge"), "cls").filter("row <> query_row")
    order = Window.partitionBy("query_row").orderBy("near", "vec_id", "row")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", (-F.col("near")).alias("score"))
