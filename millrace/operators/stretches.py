"""Row windows over window results that are not listed: a stretch is one row, listed only inside a task.

A stretch stands for the results of consecutive windows of one key, so results outnumber stretches by the overlap of the
windows. Stretches are cut at blocks of windows and dealt to ranges of blocks and keys. How many results every range has in
every window gives, summed along the order, the number of its first result there; a task lists its own results from that number
on. What leaves a task are counts: row windows that lie in one range are finished there, only those on an edge are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .order import running_totals
from .windows import floor_div

RANGE, PLACE = "_range", "_place"
BLOCK_NUMBERS = 256  # a stretch of few windows is rarely cut, and a range spans so many that its results of one are many
LISTED_AT_ONCE = 1 << 21
EMITTED_AT_ONCE = 1 << 17


def row_window_counts(
    df: DataFrame, stretch: tuple[str, str], size: int, order_by: Sequence[str], keys: Sequence[str], name: str, complete_only: bool
) -> DataFrame:
    """``(window_index, keys, name)``: rows per key in every ``size`` of all rows listed from ``df``.

    A row of ``df`` is listed once for every number from ``stretch[0]`` up to before ``stretch[1]``. The order is that of the numbers,
    then of ``order_by``, which must not repeat for one number. Nulls come first, as Spark orders them, and are a key like any other.
    """
    order_by, keys, (begin, end) = list(order_by), list(keys), stretch
    held = [F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]
    first, last = F.col(begin).cast("long"), F.col(end).cast("long") - 1
    blocks = F.sequence(floor_div(first, BLOCK_NUMBERS), floor_div(last, BLOCK_NUMBERS))
    pieces = df.filter(first <= last).select(*df.columns, F.explode(blocks).alias("_block"))
    low, high = F.greatest(first, F.col("_block") * BLOCK_NUMBERS), F.least(last + 1, (F.col("_block") + 1) * BLOCK_NUMBERS)
    ranged = pieces.repartitionByRange("_block", *order_by).sortWithinPartitions("_block", *order_by)
    placed = stage(
        ranged.select(
            F.spark_partition_id().alias(RANGE), F.monotonically_increasing_id().alias(PLACE),
            low.alias("_from"), high.alias("_to"), *held,
        ),
        "stretches",
    )
    counted = stage(_rows_per_number(placed), "rows-per-number")
    upto = running_totals(counted, ["_from", RANGE], {"_upto": F.col("_rows")})
    # the number of a range's first row comes before its stretches, in place of one
    firsts = upto.select(
        RANGE, F.lit(-1).cast("long").alias(PLACE), "_from", (F.col("_upto") - F.col("_rows")).alias("_to"),
        *(F.lit(None).cast(df.schema[k].dataType).alias(f"_g{i}") for i, k in enumerate(keys)),
    )
    dealt = placed.unionByName(firsts).repartition(RANGE).sortWithinPartitions(RANGE, PLACE, "_from")
    fields = [T.StructField("window_index", T.LongType()), *(T.StructField(k, df.schema[k].dataType) for k in keys)]
    schema = T.StructType([*fields, T.StructField(name, T.LongType())])
    whole, edges = (dealt.mapInArrow(_counter(size, keys, name, w), schema) for w in (True, False))
    merged = edges.groupBy("window_index", *keys).agg(F.sum(name).alias(name))
    if complete_only:
        rows = counted.agg(F.sum("_rows")).scalar()
        merged = merged.filter((F.col("window_index") + 1) * size <= rows)
    return whole.unionByName(merged)


def listed(df: DataFrame, stretch: tuple[str, str], name: str) -> DataFrame:
    """A row for every number of a stretch, with the number as ``name``."""
    begin, end = stretch
    numbers = F.explode(F.sequence(F.col(begin), F.col(end) - 1))
    return df.filter(F.col(begin) < F.col(end)).withColumn(name, numbers).drop(begin, end)


def _rows_per_number(placed: DataFrame) -> DataFrame:
    """``(RANGE, _from, _rows)`` for every number that a range has rows of."""

    def mark(at: str, sign: int) -> Column:
        return F.struct(F.col(at).alias("at"), F.lit(sign).alias("sign"))

    marks = placed.select(RANGE, F.inline(F.array(mark("_from", 1), mark("_to", -1))))
    turns = marks.groupBy(RANGE, "at").agg(F.sum("sign").alias("sign"))
    along = Window.partitionBy(RANGE).orderBy("at")
    levels = turns.select(RANGE, "at", F.sum("sign").over(along).alias("_rows"), F.lead("at").over(along).alias("_until"))
    each = F.explode(F.sequence(F.col("at"), F.col("_until") - 1)).alias("_from")
    return levels.filter("_rows > 0").select(RANGE, each, "_rows")


def _counter(size: int, keys: list[str], name: str, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the row windows that are whole inside a range, or those of all others."""

    def counted(window: np.ndarray, codes: np.ndarray, different: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if whole:
            codes = np.sort(codes.reshape(-1, size), axis=1).ravel()
        else:
            both = np.sort((window - window[0]) * different + codes)
            window, codes = both // different + window[0], both % different
        changes = (codes[1:] != codes[:-1]) | (window[1:] != window[:-1])
        starts = np.flatnonzero(np.concatenate([[True], changes]))
        return window[starts], codes[starts], np.diff(np.append(starts, len(window)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _ranges(batches):
            place, start, end = (rows.column(c).to_numpy() for c in (PLACE, "_from", "_to"))
            split = int(np.searchsorted(place, 0))
            groups = [rows.column(f"_g{i}").slice(split).combine_chunks() for i in range(len(keys))]
            codes, shown = _codes(groups, len(place) - split)
            for index, row in _listed_rows(start[:split], end[:split], start[split:], end[split:]):
                window = index // size
                starts = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
                lengths = np.diff(np.append(starts, len(window)))
                chosen = np.repeat((lengths == size) == whole, lengths)
                if not chosen.any():
                    continue
                found, code, times = counted(window[chosen], codes[row[chosen]], len(shown))
                for cut in range(0, len(found), EMITTED_AT_ONCE):
                    part = slice(cut, cut + EMITTED_AT_ONCE)
                    at = pa.array(shown[code[part]])
                    columns = [pa.array(found[part]), *(g.take(at) for g in groups), pa.array(times[part])]
                    yield pa.RecordBatch.from_arrays(columns, names=["window_index", *keys, name])

    return run


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of every range, which come one after another and may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ranges = batch.column(RANGE).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]])) if len(ranges) else []
        for start, end in zip(starts, [*starts[1:], len(ranges)], strict=True):
            if held and held[0].column(RANGE)[0].as_py() != ranges[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _codes(groups: list[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for every row that tells different groups apart, and a row of each group."""
    codes, shown = np.zeros(rows, dtype=np.int64), np.zeros(min(rows, 1), dtype=np.int64)
    for group in groups:
        own = group.dictionary_encode("encode").indices.to_numpy()
        _, shown, codes = np.unique(codes * (int(own.max(initial=0)) + 1) + own, return_index=True, return_inverse=True)
    return codes, shown


def _listed_rows(
    numbers: np.ndarray, first: np.ndarray, start: np.ndarray, end: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index and stretch of all rows listed from the stretches of a range, in order, a block of numbers at a time.

    ``first`` is the index of the first row of each of the ``numbers``.
    """
    active = np.searchsorted(np.sort(start), numbers, "right") - np.searchsorted(np.sort(end), numbers, "right")
    block = np.cumsum(active) // LISTED_AT_ONCE
    cuts = [*np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])), len(numbers)]
    for a, b in zip(cuts, cuts[1:]):
        low, high = numbers[a], numbers[b - 1] + 1
        row = np.flatnonzero((start < high) & (end > low))
        begin = np.maximum(start[row], low)
        times = np.minimum(end[row], high) - begin
        listed_before = np.repeat(np.cumsum(times) - times, times)
        at = np.repeat(begin, times) + np.arange(len(listed_before)) - listed_before
        nth = at - low if high - low == b - a else np.searchsorted(numbers[a:b], at)
        # stable, as stretches come in the order of their keys; sixteen bits are sorted by their digits
        order = np.argsort(nth.astype(np.uint16) if b - a <= 1 << 16 else nth, kind="stable")
        before = np.cumsum(active[a:b]) - active[a:b]
        yield np.repeat(first[a:b] - before, active[a:b]) + np.arange(len(order)), np.repeat(row, times)[order]
