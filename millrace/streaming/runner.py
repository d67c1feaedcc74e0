"""Run streams to files or to a function, restartable from their checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_table(spark: SparkSession, path: str, schema: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files under ``path`` (a folder or one file); the schema is read once if not given."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    path = path.rstrip("/")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        path = f"{path[:-1]}[{path[-1]}]"  # a file source takes a single file only through a pattern
    return reader.parquet(path)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, as timers and lists need; the session keeps its setting."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def start_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a stream that appends what is available to the Parquet files under ``path``."""
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint).start(path)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, timeout: float | None = None) -> DataFrame:
    """Process what is available in append mode, then return the table written so far.

    The file sink records its batches, so a run that starts again from the checkpoint neither loses
    nor repeats rows.
    """
    _finish(start_to_table(stream, path, checkpoint), timeout)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_batches(
    stream: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    timeout: float | None = None,
) -> None:
    """Hand each micro-batch of what is available to ``write(rows, batch_id)``.

    A batch may be handed over again after a failure: ``write`` should replace what it wrote for
    the same id. The rows are kept for the time of the call, so ``write`` may use them more than
    once without running the stream's state again.
    """

    def kept(rows: DataFrame, batch: int) -> None:
        rows.persist()
        try:
            write(rows, batch)
        finally:
            rows.unpersist()

    query = (
        stream.writeStream.foreachBatch(kept)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    _finish(query, timeout)


def _finish(query: StreamingQuery, timeout: float | None) -> None:
    try:
        if timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout):
            raise TimeoutError("the stream did not finish in time")
    finally:
        if query.isActive:
            query.stop()


def replace_batch(
    path: str, transform: Callable[[DataFrame], DataFrame] | None = None
) -> Callable[[DataFrame, int], None]:
    """A ``write`` that keeps each batch in its own folder, so that a repeated batch replaces itself.

    ``transform`` is applied to the batch first, for instance ``top_with_ties`` to closed windows.
    """

    def write(rows: DataFrame, batch: int) -> None:
        (transform(rows) if transform else rows).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def forget_batch(spark: SparkSession, path: str, batch: int, unit: str = "batch") -> None:
    """Remove what a batch has left under ``path`` for its successor, once the successor's successor runs."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{unit}={batch}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def progress_rates(query: StreamingQuery) -> list[tuple[int, int, float]]:
    """(batch, rows, rows per second) of the recent micro-batches of a running or finished stream."""
    return [(p.batchId, p.numInputRows, p.processedRowsPerSecond) for p in query.recentProgress]


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches written by ``replace_batch``."""
    return spark.read.parquet(path).drop("batch")


def new_batches(spark: SparkSession, path: str, after: int) -> tuple[DataFrame | None, int]:
    """The batches that ``replace_batch`` has written since batch ``after``, and the number of the last one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(place)] if system.exists(place) else []
    found = sorted(n for n in (int(x.partition("=")[2]) for x in names if x.startswith("batch=")) if n > after)
    rows = spark.read.parquet(*(f"{path}/batch={n}" for n in found)) if found else None
    return rows, max(found, default=after)


def peek(df: DataFrame, name: str | Observation, **counters: Column) -> DataFrame:
    """Count rows as they pass; rows are unchanged.

    A stream reports the counts under ``name`` in its progress; a table fills an ``Observation``.
    """
    measures = [F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in counters.items())]
    return df.observe(name, *measures)


def shared_queries(df: DataFrame, predicates: dict[str, Column], keep: Sequence[str]) -> DataFrame:
    """One pass for many queries: each row is emitted once per query whose predicate it meets.

    The result has ``query_id`` and the ``keep`` columns; group by ``query_id`` as well as the keys.
    """
    ids = F.array_compact(F.array(*(F.when(p, F.lit(q)) for q, p in predicates.items())))
    return df.select(F.explode(ids).alias("query_id"), *keep)


def arrival_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Stamp rows with the time they are processed, for windows by arrival."""
    return df.withColumn(ts, F.current_timestamp())
