"""Positions and running totals over one total order of a large table.

A window without a partition would send every row to one task. Here rows are range-partitioned on
the order columns, sorted inside each partition and staged once; only one small row per partition
is summed across partitions. The order must be total: end it with a unique column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

PART, AT = "_part", "_at"
_LOW_BITS = (1 << 33) - 1  # the position inside a partition, as monotonically_increasing_id lays it out


def _place(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    placed = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    return stage(
        placed.withColumn(PART, F.spark_partition_id()).withColumn(
            AT, F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS))
        ),
        "ordered",
    )


def with_row_index(
    df: DataFrame, order_by: Sequence[str], within: Sequence[str] = (), name: str = "row_index"
) -> DataFrame:
    """Number the rows 0, 1, 2, … along ``order_by``, separately for each value of ``within``.

    A single value of ``within`` may hold any share of the rows: it simply spans more partitions.
    """
    within = list(within)
    placed = _place(df, [*within, *order_by])
    parts = placed.groupBy(PART, *within).agg(F.min(AT).alias("_from"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*within).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(
        PART, *within, (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_from")).alias("_shift")
    )
    if not within:
        # one row per partition, a number the session sets and the data does not
        shifts = F.broadcast(shifts)
    rows, moves = placed.alias("r"), shifts.alias("s")
    same = F.col(f"r.{PART}") == F.col(f"s.{PART}")
    for key in within:
        same &= F.col(f"r.{key}").eqNullSafe(F.col(f"s.{key}"))
    return rows.join(moves, same).select(
        *(F.col(f"r.{c}") for c in df.columns), (F.col(f"r.{AT}") + F.col("s._shift")).alias(name)
    )


def running_totals(
    df: DataFrame, order_by: Sequence[str], totals: dict[str, Column], keep_place: bool = False
) -> DataFrame:
    """Add inclusive running sums of ``totals`` along ``order_by`` over the whole table.

    ``keep_place`` also keeps where a row lies in the order, as ``PART`` and ``AT``; see ``following``.
    """
    placed = _place(df.select("*", *(c.alias(f"_t_{n}") for n, c in totals.items())), order_by)
    parts = placed.groupBy(PART).agg(*(F.sum(f"_t_{n}").alias(f"_s_{n}") for n in totals))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: small whatever the data
    offsets = parts.select(PART, *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals))
    inside = Window.partitionBy(PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *(F.sum(f"_t_{n}").over(inside).alias(f"_l_{n}") for n in totals))
    return local.join(F.broadcast(offsets), PART).select(
        *df.columns, *((PART, AT) if keep_place else ()), *((F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in totals)
    )


def following(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Add the ``value`` of the next row as ``name``, for rows that kept their place; drops the place."""
    inside = Window.partitionBy(PART).orderBy(AT)
    # one row per partition: the first value of the next partition that has rows
    firsts = rows.groupBy(PART).agg(F.min_by(value, AT).alias("_first"))
    later = firsts.select(PART, F.lead("_first").over(Window.orderBy(PART)).alias("_later"))
    own = rows.withColumn(name, F.lead(value).over(inside)).withColumn("_more", F.lead(F.lit(True)).over(inside))
    chosen = F.when(F.col("_more"), F.col(name)).otherwise(F.col("_later"))
    return own.join(F.broadcast(later), PART).withColumn(name, chosen).drop(PART, AT, "_more", "_later")


def with_chunks(indexed: DataFrame, index: str, length: int, halo: int) -> DataFrame:
    """Cut numbered rows into chunks that can be processed apart.

    Adds ``_chunk`` and ``_halo``; the last ``halo`` rows of a chunk also appear, marked, in front
    of the next one, so a look back of ``halo`` rows never crosses a chunk.
    """
    chunk = F.call_function("div", F.col(index), F.lit(length).cast("long"))
    near_end = F.pmod(F.col(index), F.lit(length)) >= length - halo
    home = F.struct(chunk.alias("_chunk"), F.lit(False).alias("_halo"))
    ahead = F.struct((chunk + 1).alias("_chunk"), F.lit(True).alias("_halo"))
    return indexed.select("*", F.inline(F.when(near_end, F.array(home, ahead)).otherwise(F.array(home))))
