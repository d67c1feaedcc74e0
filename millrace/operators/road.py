"""Linear-road logic: stopped vehicles, accidents, segment averages and tolls.

A report has ``ts``, ``report_id`` (unique), ``vehicle``, ``speed``, ``highway``, ``position`` and
``segment``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import count, sum_of
from .order import following, running_totals, with_chunks, with_row_index
from .time_windows import window_aggregate
from .windows import WindowSpec, floor_div

STOP_REPORTS = 4
CHUNK_ROWS = 100_000
_AFTER_ALL = "9999-01-01"


def stopped_vehicles(reports: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per stop: four reports in a row with speed 0 at one position.

    Returns vehicle, highway, position, segment, ``first_ts`` (the first of the four),
    ``stopped_at`` (the fourth) and ``cleared_at`` (the next report that moves on; null if none).

    Reports are numbered per vehicle and cut into chunks of ``chunk_rows`` with a look back of four
    rows, so one vehicle with a large share of all reports is spread over many tasks. Only stops
    and the report that ends each of them leave a chunk.
    """
    place = ["highway", "position"]
    columns = ["vehicle", *place, "segment", "speed", "ts", "report_id"]
    indexed = with_row_index(reports.select(*columns), ["ts", "report_id"], within=["vehicle"])
    chunks = with_chunks(indexed, "row_index", chunk_rows, STOP_REPORTS)
    local = Window.partitionBy("vehicle", "_chunk").orderBy("row_index")

    # the report kept the place of the one before it, both standing
    same = (F.col("speed") == 0) & (F.lag("speed").over(local) == 0)
    for c in place:
        same &= F.lag(c).over(local) == F.col(c)
    held = [F.col("_held"), *(F.lag("_held", back).over(local) for back in range(1, STOP_REPORTS))]
    fourth = ~F.coalesce(held.pop(), F.lit(False))
    for earlier in held:
        fourth &= F.coalesce(earlier, F.lit(False))
    marked = chunks.withColumn("_held", F.coalesce(same, F.lit(False))).select(
        "*", fourth.alias("_fourth"), F.lag("ts", STOP_REPORTS - 1).over(local).alias("first_ts")
    )
    kind = F.when(F.col("_fourth"), "stop").when(~F.col("_held"), "move")
    events = marked.filter(~F.col("_halo")).withColumn("_kind", kind).filter(F.col("_kind").isNotNull())
    # of the moves, only the first after a stop, or the first of a chunk, can end a stop
    useful = events.withColumn("_last", F.lag("_kind").over(local)).filter(
        (F.col("_kind") == "stop") | F.col("_last").isNull() | (F.col("_last") == "stop")
    )
    per_vehicle = Window.partitionBy("vehicle").orderBy("row_index")
    ended = useful.withColumn("cleared_at", F.lead("ts").over(per_vehicle))
    return ended.filter(F.col("_kind") == "stop").select(
        "vehicle", *place, "segment", "first_ts", F.col("ts").alias("stopped_at"), "cleared_at"
    )


def accidents(stops: DataFrame) -> DataFrame:
    """Spans of time in which at least two vehicles stand at one (highway, position).

    Stops become +1 and -1 marks and a running count finds the spans, so vehicles at one place are
    never paired with each other. The count runs over all places in one order: every place ends at
    zero, as stops that never end get a mark after all times. That way a place with most of the
    stops is cut like any other stretch of the order.
    """
    place = ["highway", "position", "segment"]
    never = F.lit(_AFTER_ALL).cast("timestamp")
    start = F.struct(F.col("stopped_at").alias("at"), F.lit(1).alias("step"))
    end = F.struct(F.coalesce("cleared_at", never).alias("at"), F.lit(-1).alias("step"))
    marks = stops.select(*place, F.inline(F.array(start, end)))
    # one mark per instant: who leaves and who arrives at once cancel out
    marks = marks.groupBy(*place, "at").agg(F.sum("step").alias("step")).filter("step != 0")
    counted = running_totals(marks, [*place, "at"], {"_now": F.col("step")}, keep_place=True)
    turns = counted.filter((F.col("_now") >= 2) != (F.col("_now") - F.col("step") >= 2))
    # begin and end take turns within every place, so the row after a begin is its end
    spans = following(turns, "at", "_until").filter(F.col("_now") >= 2)
    return spans.select(*place, F.col("at").alias("started_at"), F.when(F.col("_until") < never, F.col("_until")).alias("ended_at"))


def segment_averages(reports: DataFrame, every: WindowSpec, keys: Sequence[str] = ("highway", "segment")) -> DataFrame:
    """The average speed and report count of each segment from the start up to each mark.

    Reports are aggregated per ``every`` first; only those rows are accumulated.
    """
    keys = list(keys)
    parts = window_aggregate(reports, every, keys, [count("_rows"), sum_of("speed", "_total")])
    upto = Window.partitionBy(*keys).orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    rows, total = F.sum("_rows").over(upto), F.sum("_total").over(upto)
    return parts.select(
        "window_start", "window_end", *keys, rows.alias("reports"), (total.cast("double") / rows).alias("avg_speed")
    )


def tolls(reports: DataFrame, every: WindowSpec, threshold: float = 40.0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The toll of each segment at each mark where its average speed exceeds ``threshold``.

    The toll is ``(2 * reports) ** 2``, or 0 when an accident stood in the segment at some time of
    the window before the mark.
    """
    averages = segment_averages(reports, every).filter(F.col("avg_speed") > threshold)
    spans = accidents(stopped_vehicles(reports, chunk_rows))
    first = floor_div(F.unix_micros("started_at"), every.size)
    # an open accident lasts to the end of the data; one that ends on a mark is over at that mark
    open_end = F.unix_micros(reports.agg(F.max("ts")).scalar())
    last = floor_div(F.coalesce(F.unix_micros("ended_at") - 1, open_end), every.size)
    blocked = spans.select("highway", "segment", F.explode(F.sequence(first, F.greatest(first, last))).alias("_slot"))
    blocked = blocked.distinct().withColumn("_blocked", F.lit(True))
    slotted = averages.withColumn("_slot", floor_div(F.unix_micros("window_start"), every.size))
    joined = slotted.join(blocked, ["highway", "segment", "_slot"], "left_outer")
    fee = F.pow(2 * F.col("reports"), F.lit(2)).cast("double")
    return joined.select(
        "window_start",
        "window_end",
        "highway",
        "segment",
        "reports",
        "avg_speed",
        F.when(F.col("_blocked"), F.lit(0.0)).otherwise(fee).alias("toll"),
    )


