"""Windowed aggregates over event time, for tables and for streams."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import Agg
from .panes import (
    CHUNK_WINDOWS,
    ROWS,
    pane_aggregate,
    partial_names,
    spans_of_panes,
    stretches_from_marks,
    windows_from_marks,
    windows_from_panes,
)
from .window_lattice import own_windows
from .windows import WindowSpec, floor_div, interval, time_slot

START, END, PANE = "window_start", "window_end", "_pane"


def window_aggregate(
    df: DataFrame,
    spec: WindowSpec,
    keys: Sequence[str] = (),
    aggs: Sequence[Agg] = (),
    ts: str = "ts",
    having: Column | None = None,
    post: Callable[[DataFrame], DataFrame] | None = None,
    complete_only: bool = False,
) -> DataFrame:
    """Aggregate ``df`` per window and key.

    Returns ``window_start``, ``window_end``, the keys and one column per aggregate. ``having``
    filters result rows, ``post`` transforms the whole result (for instance top with ties).
    ``complete_only`` drops windows that no later event has closed; a stream in append mode does
    that by its watermark.
    """
    keys, aggs = list(keys), list(aggs)
    if spec.measure != "time":
        raise ValueError("row windows are built by row_window_aggregate")
    if spec.is_session:
        out = _stream_sessions(df, spec, keys, aggs, ts) if df.isStreaming else sessions(df, spec, keys, aggs, ts)
    elif spec.is_tumbling:
        out = _flat(df.groupBy(F.window(ts, interval(spec.size)), *keys).agg(*(a.direct() for a in aggs)), keys, aggs)
    elif df.isStreaming:
        out = _stream_sliding(df, spec, keys, aggs, ts)
    else:
        out = sliding(df, spec, keys, aggs, ts)
    if complete_only and not df.isStreaming:
        out = out.filter(F.col(END) <= df.agg(F.max(ts)).scalar())
    if having is not None:
        out = out.filter(having)
    return post(out) if post else out


def _flat(df: DataFrame, keys: list[str], aggs: list[Agg], window: str = "window") -> DataFrame:
    return df.select(
        F.col(f"{window}.start").alias(START), F.col(f"{window}.end").alias(END), *keys, *(a.name for a in aggs)
    )


def sliding(df: DataFrame, spec: WindowSpec, keys: list[str], aggs: list[Agg], ts: str = "ts") -> DataFrame:
    """Overlapping windows of a table, through panes."""
    exact = all(a.invertible(df) for a in aggs)
    return windows_of_panes(panes_of(df, spec, keys, aggs, ts), spec, keys, aggs, exact)


def window_stretches(
    df: DataFrame, spec: WindowSpec, keys: Sequence[str], aggs: Sequence[Agg], ts: str = "ts"
) -> DataFrame:
    """The windows of ``window_aggregate`` before they are listed: one row for consecutive windows of a key with equal results.

    Windows ``_at`` … ``_until - 1`` have them, where window ``i`` begins at ``i`` slides from 1970. Stretches of a key do not
    overlap. Their number is bounded by twice the panes with rows, however many windows overlap; the aggregates must subtract exactly.
    """
    keys, aggs = list(keys), list(aggs)
    if spec.measure != "time" or spec.is_session or df.isStreaming or not all(a.invertible(df) for a in aggs):
        raise ValueError("stretches need sliding windows of a table and aggregates that subtract exactly")
    size, slide = spec.size // spec.pane, spec.slide // spec.pane
    spans = spans_of_panes(panes_of(df, spec, keys, aggs, ts), PANE, size, slide).filter("_first <= _last")
    stretches = stretches_from_marks(spans, keys, partial_names(aggs), spec.ratio)
    return stretches.select("_at", "_until", *keys, *(a.finish() for a in aggs))


def panes_of(df: DataFrame, spec: WindowSpec, keys: list[str], aggs: list[Agg], ts: str = "ts") -> DataFrame:
    """One row of partial results per pane and key; for a stream, of the panes the watermark has closed.

    A stream of long overlapping windows appends these to a table, and ``windows_of_panes`` answers
    from that table: the state of the stream holds open panes only.
    """
    if not df.isStreaming:
        return pane_aggregate(df.filter(F.col(ts).isNotNull()), time_slot(ts, spec.pane), keys, aggs, PANE)
    folds = [p.fold.alias(p.name) for a in aggs for p in a.partials()]
    slices = df.groupBy(F.window(ts, interval(spec.pane)), *keys).agg(F.count(F.lit(1)).alias(ROWS), *folds)
    slot = floor_div(F.unix_micros("window.start"), spec.pane).alias(PANE)
    return slices.select(*keys, slot, *partial_names(aggs))


def windows_of_panes(
    panes: DataFrame, spec: WindowSpec, keys: list[str], aggs: list[Agg], exact: bool
) -> DataFrame:
    """The windows over a table of panes; ``exact`` as in ``windows_from_panes``."""
    size, slide = spec.size // spec.pane, spec.slide // spec.pane
    merged = windows_from_panes(panes, keys, PANE, aggs, size, slide, exact)
    return merged.select(*bounds(F.col("window_index") * spec.slide, spec.size), *keys, *(a.finish() for a in aggs))


def bounds(start: Column, size: int | Column) -> list[Column]:
    return [F.timestamp_micros(start).alias(START), F.timestamp_micros(start + size).alias(END)]


def _stream_sliding(df: DataFrame, spec: WindowSpec, keys: list[str], aggs: list[Agg], ts: str) -> DataFrame:
    """Panes first, then windows over closed panes: state holds one row per pane and key."""
    folds = [p.fold.alias(p.name) for a in aggs for p in a.partials()]
    panes = df.groupBy(F.window(ts, interval(spec.pane)).alias("_pane"), *keys).agg(*folds)
    slices = F.window(F.window_time("_pane"), interval(spec.size), interval(spec.slide))
    merged = panes.groupBy(slices, *keys).agg(*(p.merge() for a in aggs for p in a.partials()))
    return merged.select(
        F.col("window.start").alias(START), F.col("window.end").alias(END), *keys, *(a.finish() for a in aggs)
    )


def _stream_sessions(df: DataFrame, spec: WindowSpec, keys: list[str], aggs: list[Agg], ts: str) -> DataFrame:
    grouped = df.groupBy(F.session_window(ts, interval(spec.gap)), *keys)
    return _flat(grouped.agg(*(a.direct() for a in aggs)), keys, aggs, "session_window")


def sessions(df: DataFrame, spec: WindowSpec, keys: list[str], aggs: list[Agg], ts: str = "ts") -> DataFrame:
    """Session windows of a table.

    Two rows in one slot of the gap's length always belong to one session, so rows are first
    folded into slots. Slots are linked inside chunks of slots, and across chunks by one row per chunk, so even a single
    key is spread over many tasks. A session ends one gap after its last row.
    """
    slots = (
        df.filter(F.col(ts).isNotNull())
        .groupBy(*keys, time_slot(ts, spec.gap).alias("_slot"))
        .agg(
            F.min(F.unix_micros(ts)).alias("_from"),
            F.max(F.unix_micros(ts)).alias("_to"),
            *(p.fold.alias(p.name) for a in aggs for p in a.partials()),
        )
    )
    slots = slots.withColumn("_chunk", floor_div(F.col("_slot"), CHUNK_WINDOWS))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_slot")
    # the first slot of a chunk is decided with the chunk before it
    opens = F.coalesce((F.col("_from") - F.lag("_to").over(inside) > spec.gap).cast("long"), F.lit(0))
    linked = slots.withColumn("_opens", opens)
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    chunks = linked.groupBy(*keys, "_chunk").agg(
        F.min("_from").alias("_first"), F.max("_to").alias("_last"), F.sum("_opens").alias("_inner")
    )
    new = F.coalesce((F.col("_first") - F.lag("_last").over(by_chunk) > spec.gap).cast("long"), F.lit(1))
    chunks = chunks.withColumn("_new", new)
    earlier = F.coalesce(F.sum(F.col("_inner") + F.col("_new")).over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = chunks.select(*keys, "_chunk", (earlier + F.col("_new")).alias("_start")).alias("c")
    same = F.col("s._chunk") == F.col("c._chunk")
    for key in keys:
        same &= F.col(f"s.{key}").eqNullSafe(F.col(f"c.{key}"))
    so_far = F.sum("_opens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    numbered = linked.withColumn("_so_far", so_far).alias("s").join(starts, same).select(
        "s.*", (F.col("c._start") + F.col("s._so_far")).alias("_session")
    )
    merged = numbered.groupBy(*keys, "_session").agg(
        F.min("_from").alias("_from"), F.max("_to").alias("_to"), *(p.merge() for a in aggs for p in a.partials())
    )
    return merged.select(
        F.timestamp_micros("_from").alias(START),
        F.timestamp_micros(F.col("_to") + spec.gap).alias(END),
        *keys,
        *(a.finish() for a in aggs),
    )


def shared_windows(
    df: DataFrame,
    specs: Mapping[str, WindowSpec | tuple[WindowSpec, Sequence[Agg]]],
    keys: Sequence[str],
    aggs: Sequence[Agg] = (),
    ts: str = "ts",
) -> DataFrame:
    """Several time windows over one pass; ``window_id`` names the window a row belongs to.

    A window may come with aggregates of its own, ``(spec, aggs)``, instead of those of all. The pane is the greatest common
    divisor of all sizes and slides. Where all windows have the same aggregates and these subtract exactly, every pane is spread
    to all windows at once; otherwise longer windows are answered from shorter ones where they fit, see ``window_lattice``.
    """
    keys, aggs = list(keys), list(aggs)
    own = {name: s if isinstance(s, tuple) else (s, aggs) for name, s in specs.items()}
    if any(isinstance(s, tuple) for s in specs.values()) or not all(a.invertible(df) for a in aggs):
        return own_windows(df, own, keys, ts)
    pane = math.gcd(*(n for s in specs.values() for n in (s.size, s.slide)))
    panes = pane_aggregate(df.filter(F.col(ts).isNotNull()), time_slot(ts, pane), keys, aggs, PANE)
    position = F.col(PANE)
    choices = F.array(
        *(
            F.struct(
                F.lit(name).alias("window_id"),
                F.lit(s.size).alias("_size"),
                F.lit(s.slide).alias("_slide"),
                (floor_div(position - s.size // pane, s.slide // pane) + 1).alias("_first"),
                floor_div(position, s.slide // pane).alias("_last"),
            )
            for name, s in specs.items()
        )
    )
    spans = panes.select(*keys, *partial_names(aggs), F.inline(choices)).filter("_first <= _last")
    overlap = max(s.ratio for s in specs.values())
    merged = windows_from_marks(
        spans, ["window_id", "_size", "_slide", *keys], partial_names(aggs), overlap, "window_index"
    )
    start = F.col("window_index") * F.col("_slide")
    return merged.select("window_id", *bounds(start, F.col("_size")), *keys, *(a.finish() for a in aggs))


def fill_gaps(
    windows: DataFrame, spec: WindowSpec, keys: Sequence[str] = (), zero: Sequence[str] = ("n",)
) -> DataFrame:
    """Add a row for every empty window between the first and last window (of a key, if given).

    Each window row emits itself and the empty windows up to the next row, so a gap costs only its
    own output rows. The next row is looked up inside a chunk of windows; across chunks only one
    row per chunk is ordered.
    """
    keys, zero = list(keys), list(zero)
    index = floor_div(F.unix_micros(START), spec.slide)
    numbered = windows.withColumn("_index", index).withColumn("_chunk", floor_div(F.col("_index"), CHUNK_WINDOWS))
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    following = (
        numbered.groupBy(*keys, "_chunk")
        # whole rows, so that both uses of the windows need the same columns and share one shuffle
        .agg(F.min(F.struct("_index", *windows.columns)).alias("_opens"))
        .select(*keys, "_chunk", F.lead("_opens._index").over(by_chunk).alias("_later"))
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_index")
    linked = numbered.withColumn("_next", F.lead("_index").over(inside)).alias("w")
    same = F.col("w._chunk").eqNullSafe(F.col("f._chunk"))
    for key in keys:
        same &= F.col(f"w.{key}").eqNullSafe(F.col(f"f.{key}"))
    until = F.coalesce(F.col("w._next"), F.col("f._later"), F.col("w._index") + 1) - 1
    # chunk by chunk, so that no array is longer than a chunk or than the number of chunks of a gap
    chunks = F.sequence(floor_div(F.col("w._index"), CHUNK_WINDOWS), floor_div(until, CHUNK_WINDOWS))
    spread = linked.join(following.alias("f"), same).select(
        *(F.col(f"w.{c}") for c in [*windows.columns, "_index"]), until.alias("_until"), F.explode(chunks).alias("_part")
    )
    first = F.greatest(F.col("_index"), F.col("_part") * CHUNK_WINDOWS)
    last = F.least(F.col("_until"), F.col("_part") * CHUNK_WINDOWS + (CHUNK_WINDOWS - 1))
    spread = spread.select(*windows.columns, "_index", F.explode(F.sequence(first, last)).alias("_slot"))
    own = F.col("_slot") == F.col("_index")
    rest = [c for c in windows.columns if c not in (START, END, *keys)]
    filled = [F.when(own, F.col(c)).otherwise(F.lit(0) if c in zero else F.lit(None)).alias(c) for c in rest]
    return spread.select(*bounds(F.col("_slot") * spec.slide, spec.size), *keys, *filled)
