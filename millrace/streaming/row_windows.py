"""Row windows of a stream from built-in aggregates, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import Agg
from ..operators.order import with_row_index
from ..operators.windows import WindowSpec, floor_div
from .runner import forget_batch

_PANE, _FILLED, _BEFORE, _AFTER = "_pane", "_filled", "_before", "_after"
_PASSED = -1  # the pane that stands for all rows no open window can reach
COMPACT_EVERY = 16


def row_window_batches(
    path: str, size: int, keys: Sequence[str], aggs: Sequence[Agg], order_by: Sequence[str], slide: int | None = None,
    compact_every: int = COMPACT_EVERY,
) -> Callable[[DataFrame, int], None]:
    """A ``write`` for ``run_batches`` that aggregates ``size`` rows of a key, every ``slide`` rows (``size`` if not given).

    Only full windows are answered: window ``i`` of a key holds its rows ``i * slide`` … ``i * slide + size - 1``. Rows of a
    batch are numbered in a distributed order, so a key may hold any share of them; across batches the stream must arrive in
    order. Rows are folded into panes of gcd(size, slide) rows; a pane counts towards size / slide windows.

    Windows (the keys, ``window_index`` and the aggregates) are kept under ``path/windows`` (see ``read_batches``). Under
    ``path/open`` a batch writes what its own rows add to panes, so keys without rows cost nothing to write; batches read
    only what concerns their keys. Every ``compact_every`` batches the additions are merged: of each key the panes of open
    windows stay, and the number of rows before them. A repeated batch starts from the same panes and replaces its results.
    """
    keys, aggs = list(keys), list(aggs)
    spec = WindowSpec.rows(size, slide or size)
    per_window, per_slide = spec.size // spec.pane, spec.slide // spec.pane
    partials = [p for a in aggs for p in a.partials()]

    def place(batch: int) -> str:
        return f"{path}/open/epoch={batch // compact_every}"

    def same(a: str, b: str) -> Column:
        return reduce(Column.__and__, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys), F.lit(True))

    def merged(panes: DataFrame, *more: str) -> DataFrame:
        columns = (F.sum(_FILLED).alias(_FILLED), *(p.merge() for p in partials))
        return panes.groupBy(*keys, _PANE, *more).agg(*columns)

    def compacted(panes: DataFrame) -> DataFrame:
        """Panes before the first open window of their key become one that only says how many rows they had."""
        rows = panes.groupBy(*keys).agg(F.sum(_FILLED).alias(_BEFORE))
        reach = F.greatest(floor_div(F.col(_BEFORE) - size, spec.slide) + 1, F.lit(0)) * per_slide
        passed = F.col(_PANE) < reach
        met = panes.alias("p").join(rows.alias("r"), same("p", "r")).select(
            *(F.col(f"p.{k}").alias(k) for k in keys),
            F.when(passed, F.lit(_PASSED).cast("long")).otherwise(F.col(_PANE)).alias(_PANE),
            _FILLED,
            *(F.when(~passed, F.col(p.name)).alias(p.name) for p in partials),
        )
        return merged(met)

    def earlier(rows: DataFrame, batch: int) -> DataFrame | None:
        """All additions before ``batch``."""
        spark, start = rows.sparkSession, batch // compact_every * compact_every
        if not batch:
            return None
        if batch == start:
            last = batch - compact_every
            parts = [f"{place(last)}/batch={b}" for b in range(last, batch)] + ([f"{place(last)}/base"] if last else [])
            compacted(spark.read.parquet(*parts)).write.mode("overwrite").parquet(f"{place(batch)}/base")
            return spark.read.parquet(f"{place(batch)}/base")
        parts = [f"{place(batch)}/batch={b}" for b in range(start, batch)] + ([f"{place(batch)}/base"] if start else [])
        return spark.read.parquet(*parts)

    def write(rows: DataFrame, batch: int) -> None:
        spark, own = rows.sparkSession, f"{place(batch)}/batch={batch}"
        known = earlier(rows, batch)
        numbered = with_row_index(rows, order_by, within=keys, name="_i")
        if known is not None:
            touched = rows.select(*keys).distinct()
            known = known.alias("k").join(touched.alias("t"), same("k", "t"), "left_semi")
            seen = known.groupBy(*keys).agg(F.sum(_FILLED).alias(_BEFORE))
            index = F.col("_i") + F.coalesce(_BEFORE, F.lit(0))
            numbered = numbered.alias("n").join(seen.alias("s"), same("n", "s"), "left").select(
                *(F.col(f"n.{c}").alias(c) for c in rows.columns), index.alias("_i")
            )
        folded = numbered.groupBy(*keys, floor_div(F.col("_i"), spec.pane).alias(_PANE)).agg(
            F.count(F.lit(1)).alias(_FILLED), *(p.fold.alias(p.name) for p in partials)
        )
        folded.write.mode("overwrite").parquet(own)
        added = spark.read.schema(folded.schema).parquet(own).withColumn("_new", F.lit(True))
        panes = added if known is None else added.unionByName(known.withColumn("_new", F.lit(False)))
        rows_of = panes.groupBy(*keys).agg(
            F.coalesce(F.sum(F.when(~F.col("_new"), F.col(_FILLED))), F.lit(0)).alias(_BEFORE), F.sum(_FILLED).alias(_AFTER)
        )
        # the windows that are full now and were not before
        first = F.greatest(floor_div(F.col(_BEFORE) - size, spec.slide) + 1, F.lit(0))
        last = floor_div(F.col(_AFTER) - size, spec.slide)
        low = F.greatest(first, floor_div(F.col(_PANE) - per_window, per_slide) + 1)
        high = F.least(last, floor_div(F.col(_PANE), per_slide))
        reached = F.when(low <= high, F.sequence(low, high))
        full = (
            merged(panes).filter(F.col(_PANE) >= 0).alias("p").join(rows_of.alias("r"), same("p", "r"))
            .select(*(F.col(f"p.{k}").alias(k) for k in keys), F.explode(reached).alias("window_index"), *(p.name for p in partials))
            .groupBy(*keys, "window_index").agg(*(p.merge() for p in partials))
        )
        done = full.select(*keys, "window_index", *(a.finish() for a in aggs))
        done.write.mode("overwrite").parquet(f"{path}/windows/batch={batch}")
        if batch % compact_every == 0 and batch >= 2 * compact_every:
            forget_batch(spark, f"{path}/open", batch // compact_every - 2, "epoch")

    return write
