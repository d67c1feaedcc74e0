"""Rows that come behind the watermark: kept in a table of their own, and turned into corrections of closed windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import Agg
from ..operators.time_windows import END, START, bounds
from ..operators.windows import WindowSpec, time_slot
from .runner import forget_batch


def late_row_batches(path: str, spec: WindowSpec, delay: int, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """A ``write`` for ``run_batches`` that appends the rows whose tumbling window the watermark had closed before they came.

    ``delay`` is that of the watermark, in microseconds. Rows are kept under ``path/late`` with the bounds of their window and ``behind``,
    the microseconds from their time to the watermark. What the watermark needs, the latest time so far, is one row per
    batch under ``path/marks``; a repeated batch replaces its own files.
    """

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        latest = rows.agg(F.max(F.expr(f"unix_micros({ts}) div 1000")).alias("ms"))
        if batch:
            before = spark.read.schema("ms BIGINT").parquet(f"{path}/marks/batch={batch - 1}")
            mark = before.first().ms
            latest = latest.unionByName(before).agg(F.max("ms").alias("ms"))
        else:
            mark = None
        latest.write.mode("overwrite").parquet(f"{path}/marks/batch={batch}")
        passed = F.lit(mark).cast("long") * 1000 - delay // 1000 * 1000
        start = time_slot(ts, spec.size) * spec.size
        shown = rows.select("*", *bounds(start, spec.size), (passed - F.unix_micros(ts)).alias("behind"))
        shown.filter(start + spec.size <= passed).write.mode("overwrite").parquet(f"{path}/late/batch={batch}")
        if batch > 1:
            forget_batch(spark, f"{path}/marks", batch - 2)

    return write


def corrections(windows: DataFrame, late: DataFrame, keys: Sequence[str], aggs: Sequence[Agg]) -> DataFrame:
    """What ``late`` rows change in closed ``windows``: a ``retract`` row with the old and an ``add`` row with the new values.

    Aggregates must merge from their results: counts, sums, minima and maxima. A window that had no row before is only added.
    """
    keys = list(keys)
    if any(a.kind not in ("count", "sum", "min", "max") for a in aggs):
        raise ValueError("only counts, sums, minima and maxima merge with the results of closed windows")
    more = late.groupBy(START, END, *keys).agg(*(a.direct().alias(f"_{a.name}") for a in aggs))
    old, new = windows.alias("o"), more.alias("n")
    same = F.lit(True)
    for key in (START, END, *keys):
        same &= F.col(f"o.{key}").eqNullSafe(F.col(f"n.{key}"))
    merge = {"count": lambda x, y: x + y, "sum": lambda x, y: x + y, "min": F.least, "max": F.greatest}
    values = []
    for a in aggs:
        was, adds = F.col(f"o.{a.name}"), F.col(f"n._{a.name}")
        values.append(F.coalesce(merge[a.kind](was, adds), was, adds).cast(windows.schema[a.name].dataType).alias(a.name))
    names = [START, END, *keys]
    joined = new.join(old, same, "left")
    add = joined.select(*(F.col(f"n.{c}") for c in names), *values, F.lit("add").alias("change"))
    retract = joined.filter(F.col(f"o.{START}").isNotNull()).select(
        *(F.col(f"o.{c}") for c in [*names, *(a.name for a in aggs)]), F.lit("retract").alias("change")
    )
    return retract.unionByName(add)


def corrected(windows: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``windows`` without what is retracted and with what is added."""
    names = [START, END, *keys]
    gone = changes.filter("change = 'retract'").select(*(F.col(c).alias(f"_{c}") for c in names))
    same = F.lit(True)
    for c in names:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return windows.join(gone, same, "left_anti").unionByName(changes.filter("change = 'add'").select(*windows.columns))
