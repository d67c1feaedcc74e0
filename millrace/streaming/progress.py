"""A log of what running streams report about their batches."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.listener import (
    QueryIdleEvent,
    QueryProgressEvent,
    QueryStartedEvent,
    QueryTerminatedEvent,
)

SCHEMA = (
    "query STRING, run STRING, name STRING, batch LONG, at STRING, rows LONG, rows_in_per_second DOUBLE, "
    "rows_per_second DOUBLE, millis LONG"
)
HELD = 50


class ProgressLog(StreamingQueryListener):
    """Appends a row per batch of the streams started while it listens to the Parquet files under ``path``.

    Rows are written ``held`` at a time and when a stream ends, so a query's own list of recent batches may be as short as it
    likes. Streams that were running before are not logged.
    """

    def __init__(self, spark: SparkSession, path: str, held: int = HELD) -> None:
        self.spark, self.path, self.limit = spark, path, held
        self.rows: list[tuple] = []
        self.running: set[str] = set()
        self.changed = threading.Condition()

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        with self.changed:
            self.running.add(str(event.runId))

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        if str(p.runId) not in self.running:
            return
        rates = (float(p.inputRowsPerSecond), float(p.processedRowsPerSecond))
        self.rows.append((str(p.id), str(p.runId), p.name, p.batchId, p.timestamp, p.numInputRows, *rates, p.batchDuration))
        if len(self.rows) >= self.limit:
            self.flush()

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        try:
            self.flush()
        finally:
            with self.changed:
                self.running.discard(str(event.runId))
                self.changed.notify_all()

    def flush(self) -> None:
        if self.rows:
            self.spark.createDataFrame(self.rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
            self.rows = []

    def wait(self, timeout: float) -> None:
        """Wait until the streams that have ended are logged to their last batch: reports come after the batch itself."""
        with self.changed:
            if not self.changed.wait_for(lambda: not self.running, timeout):
                raise TimeoutError("a stream is still running or has not reported its end")


@contextmanager
def progress_log(spark: SparkSession, path: str, held: int = HELD, timeout: float = 600) -> Iterator[ProgressLog]:
    """Log the streams that start inside; leave once they have ended."""
    log = ProgressLog(spark, path, held)
    spark.streams.addListener(log)
    try:
        yield log
        log.wait(timeout)
    finally:
        spark.streams.removeListener(log)


def throughput_of(log: DataFrame) -> DataFrame:
    """Batches, rows, busy time and rows per second of every query of a log, over all its batches and restarts."""
    totals = log.groupBy("query").agg(F.count(F.lit(1)).alias("batches"), F.sum("rows").alias("rows"), F.sum("millis").alias("millis"))
    return totals.withColumn("rows_per_second", F.when(F.col("millis") > 0, 1000.0 * F.col("rows") / F.col("millis")))
