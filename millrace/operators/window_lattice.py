"""Several windows in one pass, each with aggregates of its own.

Every partial result (a sum, a count, a minimum) that any window needs is computed once per pane. A window whose results
lie end to end is itself a source of longer panes, so for each partial of each window the longest source that fits is taken: base panes, or the results
of a window that has the partial, as far as its size divides size and slide. Windows that wait for the same sources are
one level, and all windows of a level are answered by the same two shuffles, however many they are.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import Agg, Partial
from .panes import ROWS, pane_aggregate, windows_from_two_sides
from .windows import WindowSpec, floor_div, time_slot

BASE = ""  # in place of the name of a window: the panes themselves


@dataclass
class Cover:
    """Where a window's partials come from, by source; its level is one above that of its sources."""

    spec: WindowSpec
    partials: list[str]
    level: int = 0
    sources: dict[str, list[str]] = field(default_factory=dict)

    @property
    def is_source(self) -> bool:
        """Whether its results at multiples of its size are all there."""
        return self.spec.size % self.spec.slide == 0


def covers(windows: Mapping[str, tuple[WindowSpec, Sequence[str]]], pane: int) -> dict[str, Cover]:
    """The cheapest cover of every window: for each partial the source with the longest panes, which has the fewest rows."""
    planned: dict[str, Cover] = {}
    for name, (spec, partials) in sorted(windows.items(), key=lambda w: (w[1][0].size, w[1][0].slide, w[0])):
        cover = Cover(spec, list(partials))
        for partial in (ROWS, *partials):
            best, unit = BASE, pane
            for other, known in planned.items():
                fits = known.is_source and spec.size % known.spec.size == 0 and spec.slide % known.spec.size == 0
                if fits and known.spec.size > unit and spec.size > known.spec.size and partial in (ROWS, *known.partials):
                    best, unit = other, known.spec.size
            cover.sources.setdefault(best, []).append(partial)
        cover.level = 1 + max(planned[s].level if s else 0 for s in cover.sources)
        planned[name] = cover
    return planned


def own_windows(
    df: DataFrame, windows: Mapping[str, tuple[WindowSpec, Sequence[Agg]]], keys: Sequence[str], ts: str = "ts"
) -> DataFrame:
    """Rows of all ``windows``, told apart by ``window_id``; a window has nulls for aggregates it does not ask for.

    Windows are built where there are rows. Rows without a time are left out. The same name may stand for different aggregates of
    different windows as long as their types agree.
    """
    keys = list(keys)
    if any(s.measure != "time" or s.is_session for s, _ in windows.values()):
        raise ValueError("windows with a size and a slide in time are asked for")
    needed: dict[str, Partial] = {}
    lists = {name: [p for a in aggs for p in a.partials()] for name, (_, aggs) in windows.items()}
    ids = {}  # equal partials of different aggregates are one column
    for partials in lists.values():
        for p in partials:
            known = ids.setdefault(str(p.fold), f"_p{len(ids)}{'_min' if p.name.endswith('min') else ''}")
            needed[known] = Partial(known, p.fold, p.additive, p.sketch)
    pane = math.gcd(*(n for s, _ in windows.values() for n in (s.size, s.slide)))
    plan = covers({n: (s, list(dict.fromkeys(ids[str(p.fold)] for p in lists[n]))) for n, (s, _) in windows.items()}, pane)
    folded = pane_aggregate(df.filter(F.col(ts).isNotNull()), time_slot(ts, pane), keys, [_Whole(needed)], "_pane")
    columns = [ROWS, *needed]
    done: dict[int, DataFrame] = {}
    for level in range(1, max(c.level for c in plan.values()) + 1):
        own = {n: c for n, c in plan.items() if c.level == level}
        given = []
        if any(BASE in c.sources for c in own.values()):
            given.append(_feed(folded, own, [BASE], F.lit(BASE), F.lit(pane), keys, columns))
        sources = {s for c in own.values() for s in c.sources} - {BASE}
        for lower in sorted({plan[s].level for s in sources}):
            names = sorted(s for s in sources if plan[s].level == lower)
            # results that lie end to end are panes of their size
            whole = done[lower].filter(F.col("window_id").isin(*names) & (F.pmod(F.col("_start"), F.col("_size")) == 0))
            panes = whole.withColumn("_pane", F.expr("_start div _size"))
            given.append(_feed(panes, own, names, F.col("window_id"), F.col("_size"), keys, columns))
        marks = ["window_id", "_unit", "_size", "_slide"]
        done[level] = windows_from_two_sides(
            reduce(DataFrame.unionByName, given), [*marks, *keys], "_pane", list(needed.values()),
            F.expr("_size div _unit"), F.expr("_slide div _unit"), "_start", by=["window_id", "_size", "_slide", *keys],
            name=F.col("_start") * F.col("_slide"),
        )
    found = reduce(DataFrame.unionByName, done.values())
    return _shown(found, windows, ids, keys)


class _Whole:
    """All partials together, as ``pane_aggregate`` takes them."""

    def __init__(self, needed: dict[str, Partial]) -> None:
        self.needed = needed

    def partials(self) -> list[Partial]:
        return list(self.needed.values())


def _feed(
    panes: DataFrame, own: dict[str, Cover], sources: list[str], source: Column, unit: Column, keys: list[str], columns: list[str]
) -> DataFrame:
    """A row of ``panes`` for every window that takes partials from their ``source``, with just these partials."""
    kind = "array<struct<id:string,size:bigint,slide:bigint," + ",".join(f"{p}:boolean" for p in columns) + ">>"
    takers = F.lit(None).cast(kind)
    for name in sources:
        choice = F.array(
            *(
                F.struct(F.lit(n), F.lit(c.spec.size), F.lit(c.spec.slide), *(F.lit(p in c.sources[name]) for p in columns))
                for n, c in own.items()
                if name in c.sources
            )
        )
        takers = F.when(source == name, choice.cast(kind)).otherwise(takers)
    spread = panes.withColumn("_unit", unit.cast("long")).drop("_size", "_slide").withColumn("_w", F.explode(takers))
    return spread.select(
        F.col("_w.id").alias("window_id"), "_unit", F.col("_w.size").alias("_size"), F.col("_w.slide").alias("_slide"),
        *keys, "_pane", *(F.when(F.col("_w")[p], F.col(p)).alias(p) for p in columns),
    )


def _shown(
    found: DataFrame, windows: Mapping[str, tuple[WindowSpec, Sequence[Agg]]], ids: dict[str, str], keys: list[str]
) -> DataFrame:
    """Aggregates from partials, each for the windows that ask for it."""
    results: dict[str, Column] = {}
    for name, (_, aggs) in windows.items():
        for agg in aggs:
            # the expression of the aggregate over its own partial names, read from the shared columns
            value = agg.finish({p.name: ids[str(p.fold)] for p in agg.partials()})
            so_far = results.get(agg.name)
            mine = F.col("window_id") == name
            results[agg.name] = F.when(mine, value) if so_far is None else so_far.when(mine, value)
    start = F.col("_start")
    return found.select(
        "window_id", F.timestamp_micros(start).alias("window_start"), F.timestamp_micros(start + F.col("_size")).alias("window_end"),
        *keys, *(c.alias(n) for n, c in results.items()),
    )
