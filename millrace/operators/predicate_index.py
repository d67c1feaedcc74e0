"""Very many range queries over one pass: rows meet the queries they fulfil in a join instead of trying each.

A range of whole numbers is the union of few dyadic intervals, as the nodes of a segment tree are: at most two a level, without overlap. A
value lies in one interval of each level, so it finds its queries by equality, and each of them once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOWEST, HIGHEST = -(2**63), 2**63 - 1


def dyadic(low: int, high: int) -> list[tuple[int, int]]:
    """``(level, number)`` of intervals of 2**level whole numbers that make up ``low`` to ``high``, both included."""
    found, level, end = [], 0, high + 1
    while low < end:
        if low & 1:
            found.append((level, low))
            low += 1
        if end & 1:
            end -= 1
            found.append((level, end))
        low, end, level = low >> 1, end >> 1, level + 1
    return found


def query_index(queries: DataFrame) -> DataFrame:
    """``(query_id, column, level, number)`` of queries ``(query_id, column, low, high)``; a null bound is none.

    A query without values, where ``low`` is above ``high``, has no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, levels, numbers = [], [], []
            for i, (low, high) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                for level, number in dyadic(LOWEST if low is None else low, HIGHEST if high is None else high):
                    at.append(i)
                    levels.append(level)
                    numbers.append(number)
            own = batch.select([0, 1]).take(pa.array(at, pa.int64()))
            arrays = [*own.columns, pa.array(levels, pa.int32()), pa.array(numbers, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "column", "level", "number"])

    kind = dict(queries.dtypes)["query_id"]
    narrow = queries.select("query_id", "column", F.col("low").cast("long"), F.col("high").cast("long"))
    return narrow.mapInArrow(run, f"query_id {kind}, column string, level int, number long")


def indexed_queries(df: DataFrame, queries: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``query_id`` and the ``keep`` columns, once for every row and every query whose range holds the row's value.

    ``queries`` are ``(query_id, column, low, high)`` over whole numbers in ``columns``. Rows with a null there meet none. A row is
    spread to the levels that queries use, 64 at most for each column.
    """
    index = query_index(queries)
    used: dict[str, list[int]] = {c: [] for c in columns}
    for row in index.select("column", "level").distinct().collect():  # levels of columns: 64 each at most
        if row.column in used:
            used[row.column].append(row.level)
    places = [
        F.struct(F.lit(c).alias("column"), F.lit(level).alias("level"), F.shiftright(F.col(c).cast("long"), level).alias("number"))
        for c, levels in used.items()
        for level in sorted(levels)
    ]
    if not places:
        places = [F.struct(F.lit("").alias("column"), F.lit(-1).alias("level"), F.lit(0).cast("long").alias("number"))]
    spread = df.select(*keep, F.inline(F.array(*places)))
    return spread.join(index, ["column", "level", "number"]).select("query_id", *keep)
