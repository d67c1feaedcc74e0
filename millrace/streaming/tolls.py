"""Tolls of a road as a periodic report over a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.windows import WindowSpec, floor_div
from .runner import forget_batch

_SUMS = ["_rows", "_total"]


SPANS = "highway LONG, position LONG, segment LONG, started_at TIMESTAMP, ended_at TIMESTAMP"
NewEvents = Callable[[int], "tuple[DataFrame | None, int]"]


def accident_spans(events: DataFrame) -> DataFrame:
    """The rows of ``accidents_stream`` as spans ``SPANS``; an accident that goes on has no end."""
    place = Window.partitionBy("highway", "position").orderBy("at")
    turns = events.withColumn("ended_at", F.lead("at").over(place)).filter("kind = 'started'")
    return turns.select("highway", "position", "segment", F.col("at").alias("started_at"), "ended_at")


def _spans_so_far(spark: SparkSession, path: str, batch: int, events: NewEvents) -> DataFrame:
    """Spans that the last batch has kept, carried on with the events that are new since; written as those of this batch.

    Only spans that have not ended before the windows of the last batch did are kept, so what is read does not grow with time.
    """
    kept, after = spark.createDataFrame([], SPANS), -1
    if batch:
        kept = spark.read.schema(SPANS).parquet(f"{path}/spans/batch={batch - 1}")
        after = spark.read.schema("after INT").parquet(f"{path}/after/batch={batch - 1}").first().after
    rows, upto = events(after)
    if rows is not None:
        going_on = kept.filter("ended_at IS NULL").select("highway", "position", "segment", F.col("started_at").alias("at"), F.lit("started").alias("kind"))
        new = rows.select("highway", "position", "segment", "at", "kind")
        kept = kept.filter("ended_at IS NOT NULL").unionByName(accident_spans(going_on.unionByName(new)))
    kept.write.mode("overwrite").parquet(f"{path}/known/batch={batch}")
    spark.range(1).select(F.lit(upto).alias("after")).write.mode("overwrite").parquet(f"{path}/after/batch={batch}")
    return spark.read.schema(SPANS).parquet(f"{path}/known/batch={batch}")


def toll_batches(path: str, every: WindowSpec, events: NewEvents, threshold: float = 40.0) -> Callable[[DataFrame, int], None]:
    """A ``write`` for ``run_batches`` over closed windows of the reports, that charges as ``tolls`` does on a table.

    Each row has ``window_start``, ``window_end``, ``highway``, ``segment``, ``_rows`` (reports) and ``_total`` (the sum of
    their speeds). ``events(after)`` gives the rows of ``accidents_stream`` from batches later than ``after`` and the number of
    the last one (see ``new_batches``); that stream runs ahead of this one over the same reports, so every accident that touches a
    closed window is known. Reports are kept under ``path/tolls`` (see ``read_batches``); the sums of each segment and the spans of
    accidents that can still matter are kept for the last two batches. A repeated batch replaces its own results.
    """
    keys = ["highway", "segment"]

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        parts = rows.select("window_start", "window_end", *keys, *_SUMS)
        if batch:
            # sums so far come first in the order of a segment
            earlier = spark.read.schema(parts.select(*keys, *_SUMS).schema).parquet(f"{path}/sums/batch={batch - 1}")
            parts = parts.unionByName(earlier, allowMissingColumns=True)
        sums = parts.groupBy(*keys).agg(*(F.sum(c).cast(parts.schema[c].dataType).alias(c) for c in _SUMS))
        sums.write.mode("overwrite").parquet(f"{path}/sums/batch={batch}")
        upto = Window.partitionBy(*keys).orderBy(F.col("window_start").asc_nulls_first())
        upto = upto.rowsBetween(Window.unboundedPreceding, 0)
        reports, total = F.sum("_rows").over(upto), F.sum("_total").over(upto)
        averages = parts.select(
            "window_start", "window_end", *keys, reports.alias("reports"), (total.cast("double") / reports).alias("avg_speed")
        ).filter(F.col("window_start").isNotNull() & (F.col("avg_speed") > threshold))
        slot = floor_div(F.unix_micros("window_start"), every.size)
        # spans are cut to the windows of this batch before they are spread over them
        low, high = rows.agg(F.min(slot), F.max(slot)).first()
        first = F.greatest(floor_div(F.unix_micros("started_at"), every.size), F.lit(low).cast("long"))
        until = floor_div(F.unix_micros("ended_at") - 1, every.size)
        last = F.least(F.coalesce(until, F.lit(high).cast("long")), F.lit(high).cast("long"))
        known = _spans_so_far(spark, path, batch, events)
        touched = known.withColumn("_first", first).withColumn("_last", last).filter("_first <= _last")
        blocked = touched.select(*keys, F.explode(F.sequence("_first", "_last")).alias("_slot")).distinct()
        joined = averages.withColumn("_slot", slot).join(blocked.withColumn("_blocked", F.lit(True)), [*keys, "_slot"], "left")
        fee = F.pow(2 * F.col("reports"), F.lit(2)).cast("double")
        joined.select(
            "window_start", "window_end", *keys, "reports", "avg_speed",
            F.when(F.col("_blocked"), F.lit(0.0)).otherwise(fee).alias("toll"),
        ).write.mode("overwrite").parquet(f"{path}/tolls/batch={batch}")
        # an accident that ended before the next windows begin touches none of them
        closed = rows.agg(F.max("window_end")).first()[0]
        rest = known if closed is None else known.filter(F.col("ended_at").isNull() | (F.col("ended_at") > F.lit(closed)))
        rest.write.mode("overwrite").parquet(f"{path}/spans/batch={batch}")
        forget_batch(spark, f"{path}/known", batch)
        if batch > 1:
            for name in ("sums", "spans", "after"):
                forget_batch(spark, f"{path}/{name}", batch - 2)

    return write
