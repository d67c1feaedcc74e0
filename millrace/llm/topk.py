"""Exact search of the largest integer inner products, tile by tile.

Vectors are packed into shards, queries into blocks, both of bounded size. A tile is one matrix product of a query
block and a shard; it selects the best few per query, and these lists are merged in a tree of bounded fan-in. Vectors with
equally many components share blocks and shards, and every query meets every shard of its own number of components once: queries are a stated set and come in blocks, never row by row.
Of many shards, up to ``FAN_IN`` neighbours are a column: a block of queries is shipped once to a column, not to each of
its shards, and one list per query leaves it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_for
from .vectors import numbered, packed, share_of, unpack

SHARD, QUERIES, FAN_IN = 4096, 512, 16
SPREAD = 64  # columns that there are before any has more than one shard
EXACT = 2.0**53


def whole(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x): doubles, or Python's numbers in an array of objects where a product is beyond the doubles."""
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * vectors)
    beyond = ~np.isfinite(scaled)
    if beyond.any():
        scaled = scaled.astype(object)
        scaled[beyond] = [math.floor(Fraction(scale) * Fraction(x)) for x in vectors[beyond].tolist()]
    return scaled


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact at any size and kept within a long.

    Rows of small components are multiplied as doubles, which hold their products exactly; only pairs with another row are
    computed with Python's numbers.
    """
    small = (EXACT / max(queries.shape[1], 1)) ** 0.5 - 1
    few_q, few_c = (np.abs(x).max(axis=1, initial=0) <= small for x in (queries, candidates))
    few_q, few_c = few_q.astype(bool), few_c.astype(bool)
    found = np.zeros((len(queries), len(candidates)), dtype=np.int64)
    found[np.ix_(few_q, few_c)] = queries[few_q].astype(float) @ candidates[few_c].astype(float).T
    for q, c in ((~few_q, np.ones_like(few_c)), (few_q, ~few_c)):
        if q.any() and c.any():
            exact = np.frompyfunc(int, 1, 1)(queries[q]) @ np.frompyfunc(int, 1, 1)(candidates[c]).T
            found[np.ix_(q, c)] = np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)
    return found


def best(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
    """Per query the positions of its ``k`` best allowed candidates, ties to the smaller id."""
    for q in range(len(scores)):
        places = np.flatnonzero(allowed[q])
        if not len(places):
            continue
        own = scores[q, places]
        if len(places) > k:  # everything as good as the k-th best stays until ids decide
            places = places[own >= np.partition(own, len(own) - k)[len(own) - k]]
        order = np.lexsort((ids[places], _falling(scores[q, places])))
        for c in places[order[:k]]:
            yield q, int(c)


def _falling(scores: np.ndarray) -> np.ndarray:
    return np.bitwise_not(scores)  # reverses the order without overflow


def _best_of(held: list[tuple[np.ndarray, ...]], column: int, k: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` of every query among lists ``(query_row, query_id, row, vec_id, score)``."""
    if not held:
        return
    query_row, query_id, row, vec_id, score = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((row, vec_id, _falling(score), query_row))
    own = query_row[order]
    places = np.arange(len(own))
    first = np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1]), places, 0))
    order = order[places - first < k]
    lists = {"query_row": query_row, "query_id": query_id, "column": np.full(len(row), column), "row": row, "vec_id": vec_id, "score": score}
    yield pa.RecordBatch.from_arrays([pa.array(x[order]) for x in lists.values()], names=list(lists))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the best ``k`` other rows for every row where ``is_query`` holds.

    Components become floor(scale * x). ``is_query`` is a condition on ``vec_id``. A row never finds itself, but repeated
    rows find each other. Only vectors with as many components as the query's are found. Rows whose vector is null, empty, or
    with a null or non-finite component neither search nor are found, and neither are rows with a null id. Ties go to the
    smaller id; scores beyond a long are kept at its end.
    """
    rows = numbered(vectors, id, vector).filter("vec_id is not null and width is not null")
    sizes = rows.groupBy("width").agg(
        F.ceil(F.count(F.lit(1)) / SHARD).cast("long").alias("shards"),
        F.ceil(F.count(F.when(is_query, True)) / QUERIES).cast("long").alias("parts"),
    )
    # the lists of a block leave a column merged; few shards are columns of their own, so that they are spread
    sizes = sizes.withColumn("high", F.greatest(F.lit(1), F.least(F.lit(FAN_IN), F.expr(f"shards div {SPREAD}"))).cast("long"))
    columns = sizes.agg(F.max(F.ceil(F.col("shards") / F.col("high")))).first()[0] or 1
    # n different widths take n * n / 2 components at least, so this table is small at any size
    sized = rows.join(F.broadcast(sizes), "width")
    placed = sized.withColumn("shard", share_of(F.col("row"), F.col("shards"))).withColumn("column", F.expr("shard div high"))
    shelf = packed(placed.repartition("width", "column"), "width", "column", "shard")
    asked = sized.filter(is_query).withColumn("part", share_of(F.col("row"), F.col("parts")))
    asking = packed(asked, "width", "shards", "high", "part").select(
        "width", "part", F.explode(F.expr("sequence(0L, (shards - 1) div high)")).alias("column"), F.col("members").alias("asked")
    )
    # blocks repeated for their columns are more than Spark's size check sees, which would have the driver collect them
    tiles = asking.hint("merge").join(shelf, ["width", "column"]).select("column", "part", "asked", "members", "width")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        at = None
        for batch in batches:
            for column, part, asked, members, width in zip(*(batch.column(i) for i in range(5)), strict=True):
                if at != (now := (column.as_py(), part.as_py(), width.as_py())):
                    if at:
                        yield from _best_of(held, at[0], k)
                    held, at = [], now
                    query_rows, query_ids, queries = unpack(asked, at[2])
                    wanted = whole(queries, scale)
                rows, ids, candidates = unpack(members, at[2])
                if not len(query_rows) or not len(rows):
                    continue
                scores = products(wanted, whole(candidates, scale))
                numbers = ids.astype(np.int64)
                found = list(best(scores, query_rows[:, None] != rows[None, :], numbers, k))
                if found:
                    q, c = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
                    held.append((query_rows[q], query_ids[q].astype(np.int64), rows[c], numbers[c], scores[q, c]))
        if at:
            yield from _best_of(held, at[0], k)

    lists = tiles.mapInArrow(run, "query_row long, query_id long, column long, row long, vec_id long, score long")
    while True:
        lists = lists.withColumn("column", F.expr(f"column div {FAN_IN}"))
        order = Window.partitionBy("query_row", "column").orderBy(F.desc("score"), "vec_id", "row")
        lists = lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        columns = blocks_for(columns, FAN_IN)
        if columns == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
