"""The keys with the highest value of each window, ties included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import count
from .panes import FEW_WINDOWS, ROWS, highest_from_marks
from .time_windows import END, PANE, START, bounds, panes_of, window_aggregate
from .windows import WindowSpec, floor_div


def top_with_ties(results: DataFrame, value: str, within: Sequence[str] = (START, END)) -> DataFrame:
    """Keep the rows whose ``value`` equals the maximum of their group.

    The maximum is a partial aggregate and comes back through a join with one row per window, so a window with very
    many keys is neither sorted nor gathered in one task. Where that side is too large to broadcast, adaptive
    execution splits a window in which very many keys tie, as only the side of the maxima is repeated then. A stream
    applies this to each batch of closed windows (``run_batches``), where every key of a window arrives together.
    """
    if results.isStreaming:
        raise ValueError("apply top_with_ties in run_batches, on the windows a batch has closed")
    within = list(within)
    best = results.groupBy(*within).agg(F.max(value).alias(value))
    return results.join(best, [*within, value], "left_semi").select(*results.columns)


def most_frequent(df: DataFrame, spec: WindowSpec, keys: Sequence[str], name: str = "n", ts: str = "ts") -> DataFrame:
    """The keys with the most rows of each time window of a table, ties included, and how many rows they have.

    Answers as ``window_aggregate`` with ``count`` and ``top_with_ties`` do. Where many windows overlap, keys that cannot
    win are left out before their windows are listed, so the work does not grow with the overlap for most keys.
    """
    keys = list(keys)
    if spec.measure != "time" or spec.is_session or spec.ratio <= FEW_WINDOWS:
        return window_aggregate(df, spec, keys, [count(name)], ts, post=lambda counts: top_with_ties(counts, name))
    size, slide = spec.size // spec.pane, spec.slide // spec.pane
    # the rows of a pane are the counts: marks without aggregates of their own are sorted in less memory
    spans = panes_of(df, spec, keys, [], ts).select(
        *keys,
        ROWS,
        (floor_div(F.col(PANE) - size, slide) + 1).alias("_first"),
        floor_div(F.col(PANE), slide).alias("_last"),
    )
    able = highest_from_marks(spans, keys, [ROWS], -(-size // slide), "window_index")
    counts = able.select(*bounds(F.col("window_index") * spec.slide, spec.size), *keys, F.col(ROWS).alias(name))
    return top_with_ties(counts, name)
