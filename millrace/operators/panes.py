"""Overlapping windows from panes.

Rows are aggregated once per pane (a slice of gcd(size, slide)), so the work per row does not
depend on how many windows overlap. The compact panes are then turned into windows in one of three
ways:

* when few windows overlap, each pane is simply repeated for its windows;
* totals that can be subtracted exactly (counts, whole numbers, decimals) become an entry and an
  exit mark on the axis of windows, and a running sum between the marks gives every window: two
  rows per pane whatever the overlap;
* other aggregates (min, max, floating sums) are running aggregates inside blocks of one window's
  length: a window that does not begin with a block is the end of one block and the begin of the next, so it
  merges two rows, whatever the overlap.

The axis of windows is cut into chunks of bounded length, so no task holds more than one chunk of
one key, even when there is a single key for all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.aggregates import Agg, Partial
from .windows import floor_div

ROWS = "_pane_rows"
CHUNK_WINDOWS = 4096
FEW_WINDOWS = 8
BLOCK_WINDOWS = 16


def pane_aggregate(df: DataFrame, pane: Column, keys: list[str], aggs: list[Agg], name: str) -> DataFrame:
    """One row per (keys, pane) with the partial columns of every aggregate."""
    folds = [p.fold.alias(p.name) for a in aggs for p in a.partials()]
    return df.withColumn(name, pane).groupBy(*keys, name).agg(F.count(F.lit(1)).alias(ROWS), *folds)


def windows_from_panes(
    panes: DataFrame,
    keys: list[str],
    pane: str,
    aggs: list[Agg],
    size: int,
    slide: int,
    exact: bool,
    window: str = "window_index",
) -> DataFrame:
    """Merge panes into windows ``[index * slide, index * slide + size)``, counted in panes.

    Keeps the partial columns; only windows that hold a row are returned. ``exact`` says that the
    partials are additive and free of rounding.
    """
    spans = spans_of_panes(panes, pane, size, slide)
    if slide > size:
        spans = spans.filter("_first <= _last")
    if size == slide == 1:
        return spans.withColumn(window, F.col("_last")).drop("_first", "_last", pane)
    merges = [F.sum(ROWS).alias(ROWS), *(p.merge() for a in aggs for p in a.partials())]
    if -(-size // slide) <= FEW_WINDOWS:
        repeated = spans.withColumn(window, F.explode(F.sequence("_first", "_last")))
        return repeated.groupBy(*keys, window).agg(*merges)
    if exact:
        return windows_from_marks(spans, keys, partial_names(aggs), -(-size // slide), window)
    return windows_from_two_sides(panes, keys, pane, [p for a in aggs for p in a.partials()], size, slide, window)


def spans_of_panes(panes: DataFrame, pane: str, size: int, slide: int) -> DataFrame:
    """Panes with the first and the last window they lie in."""
    return panes.withColumn("_first", floor_div(F.col(pane) - size, slide) + 1).withColumn(
        "_last", floor_div(F.col(pane), slide)
    )


def partial_names(aggs: list[Agg]) -> list[str]:
    return [ROWS, *(p.name for a in aggs for p in a.partials())]


def windows_from_marks(
    spans: DataFrame, keys: list[str], totals: list[str], overlap: int, window: str
) -> DataFrame:
    """Windows ``_first`` … ``_last`` of every span receive its ``totals``; returns the sums.

    ``totals[0]`` counts rows and tells empty windows from filled ones.
    """
    return _each_window(stretches_from_marks(spans, keys, totals, overlap), window)


def stretches_from_marks(spans: DataFrame, keys: list[str], totals: list[str], overlap: int) -> DataFrame:
    """The same sums before windows are listed one by one, a row for windows ``_at`` … ``_until - 1`` of a key."""
    return _levels(spans, keys, totals, chunk_length(overlap)).drop("_chunk")


def highest_from_marks(spans: DataFrame, keys: list[str], totals: list[str], overlap: int, window: str) -> DataFrame:
    """As ``windows_from_marks``, but only windows and keys whose row count can be the highest of all keys.

    The axis is cut into blocks of windows. A key that has rows in every window of a block has at least its lowest count
    there in each of them, so the best of these lowest counts is a bound below which nothing in the block can win.
    The bounds are found before windows are listed one by one; there is one per block, whatever the number of keys.
    """
    length = -(-chunk_length(overlap) // BLOCK_WINDOWS) * BLOCK_WINDOWS  # no block lies in two chunks
    levels = _levels(spans, keys, totals, length)
    block = floor_div(F.col("_at"), BLOCK_WINDOWS), floor_div(F.col("_until") - 1, BLOCK_WINDOWS)
    cut = levels.withColumn("_block", F.explode(F.sequence(*block)))
    pieces = cut.withColumn("_at", F.greatest("_at", F.col("_block") * BLOCK_WINDOWS)).withColumn(
        "_until", F.least("_until", (F.col("_block") + 1) * BLOCK_WINDOWS)
    )
    # first by single stretches as long as a block, which takes no table of keys and blocks: few pieces are above that bound
    whole = pieces.filter(F.col("_until") - F.col("_at") == BLOCK_WINDOWS).groupBy("_block").agg(F.max(totals[0]).alias("_bound"))
    above = _reaching(pieces, whole, totals[0], more=1)
    per_key = above.groupBy(*keys, "_chunk", "_block").agg(
        F.sum(F.col("_until") - F.col("_at")).alias("_covered"), F.min(totals[0]).alias("_low")
    )
    joint = per_key.filter(F.col("_covered") == BLOCK_WINDOWS).groupBy("_block").agg(F.max("_low").alias("_bound"))
    bounds = whole.unionByName(joint).groupBy("_block").agg(F.max("_bound").alias("_bound"))
    able = _reaching(pieces, bounds, totals[0])
    return _each_window(able.drop("_block", "_chunk"), window)


def _reaching(pieces: DataFrame, bounds: DataFrame, count: str, more: int = 0) -> DataFrame:
    # one row per block: sent to all tasks, as there are few blocks for the many pieces that each would draw to one task
    known = pieces.join(F.broadcast(bounds), "_block", "left")
    return known.filter(F.col(count) >= F.coalesce(F.col("_bound") + more, F.lit(0))).drop("_bound")


def chunk_length(overlap: int) -> int:
    return max(CHUNK_WINDOWS, 4 * overlap)


def _each_window(levels: DataFrame, window: str) -> DataFrame:
    listed = levels.withColumn(window, F.explode(F.sequence("_at", F.col("_until") - 1)))
    return listed.drop("_at", "_until")


def _levels(spans: DataFrame, keys: list[str], totals: list[str], length: int) -> DataFrame:
    """Stretches ``_at`` … ``_until`` of windows with the same totals, cut at chunks of ``length`` windows."""
    chunks = spans.withColumn(
        "_chunk",
        F.explode(F.sequence(floor_div(F.col("_first"), length), floor_div(F.col("_last"), length))),
    )
    # spans are shuffled, not the two marks of each
    chunks = chunks.repartition(*keys, "_chunk")
    entry = F.greatest(F.col("_first"), F.col("_chunk") * length)
    leave = F.least(F.col("_last") + 1, (F.col("_chunk") + 1) * length)
    marks = chunks.select(
        *keys,
        "_chunk",
        *totals,
        F.explode(
            F.array(
                F.struct(entry.alias("at"), F.lit(1).alias("sign")),
                F.struct(leave.alias("at"), F.lit(-1).alias("sign")),
            )
        ).alias("_mark"),
    ).select(
        *keys,
        "_chunk",
        F.col("_mark.at").alias("_at"),
        *((F.coalesce(F.col(t), F.lit(0)) * F.col("_mark.sign")).alias(t) for t in totals),
    )
    ordered = Window.partitionBy(*keys, "_chunk").orderBy("_at")
    running = ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    levels = marks.select(
        *keys,
        "_chunk",
        "_at",
        *(F.sum(t).over(running).alias(t) for t in totals),
        F.lead("_at").over(ordered).alias("_until"),
    )
    return levels.filter((F.col(totals[0]) > 0) & (F.col("_until") > F.col("_at")))


def windows_from_two_sides(
    panes: DataFrame,
    keys: list[str],
    pane: str,
    partials: list[Partial],
    size: int | Column,
    slide: int | Column,
    window: str,
    by: list[str] | None = None,
    name: Column | None = None,
) -> DataFrame:
    """Windows from running aggregates towards both ends of blocks of ``size`` panes.

    A window begins in one block and ends in the next, so it is a suffix of the one merged with a prefix of the other. The
    suffix that a window takes is that of the first pane at or after its begin, the prefix that of the last pane before its
    end; panes without rows are none, so a pane stands for the windows that begin (or end) behind the pane before (or before
    the next one). A block of a key is sorted in one task: it has at most ``size`` rows. Sizes and slides may be columns that
    ``keys`` tell apart; ``by`` and ``name`` then say under which keys and which number windows meet.
    """
    block = floor_div(F.col(pane), size)
    here = panes.withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy(pane)
    onwards = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begin, end = F.col("_block") * size, (F.col("_block") + 1) * size
    sides = here.select(
        *keys, "_block", pane, F.coalesce(F.lag(pane).over(inside) + 1, begin).alias("_behind"),
        F.coalesce(F.lead(pane).over(inside), end - 1).alias("_ahead"),
        F.struct(*_running(partials, onwards)).alias("_rest"), F.struct(*_running(partials, so_far)).alias("_begun"),
    )

    def indexes(first: Column, last: Column) -> Column:
        """Windows that begin at the panes ``first`` to ``last``."""
        low, high = floor_div(first + slide - 1, slide), floor_div(last, slide)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    # a window that begins with a block is that block: its suffix is whole and it takes no prefix
    suffixes = F.transform(indexes(F.col("_behind"), F.col(pane)), lambda w: F.struct(w.alias(window), F.col("_rest").alias("_part")))
    last_begins = F.col("_ahead") - size
    prefixes = F.transform(indexes(F.col(pane) + 1 - size, last_begins), lambda w: F.struct(w.alias(window), F.col("_begun").alias("_part")))
    halves = sides.select(*keys, F.inline(F.concat(suffixes, prefixes))).select(*keys, window, "_part.*")
    if name is not None:
        halves = halves.withColumn(window, name)
    return halves.groupBy(*(keys if by is None else by), window).agg(F.sum(ROWS).alias(ROWS), *(p.merge() for p in partials))


def _running(partials: list[Partial], frame: WindowSpec) -> list[Column]:
    """Row counts and partial columns merged over a window frame."""
    return [F.sum(ROWS).over(frame).alias(ROWS), *(p.combine(F.col(p.name)).over(frame).alias(p.name) for p in partials)]
