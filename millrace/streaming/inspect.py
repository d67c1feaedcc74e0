"""Looking into the checkpoint of a stream: its operators, what their state holds, and how it came there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def state_operators(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``operatorId``, ``operatorName`` and the range of batches of every operator that keeps state."""
    return spark.read.format("state-metadata").load(checkpoint)


def state_rows(spark: SparkSession, checkpoint: str, operator: int = 0, batch: int | None = None) -> DataFrame:
    """Keys and values of an operator after its last batch, or after ``batch``."""
    reader = spark.read.format("statestore").option("operatorId", operator)
    return (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)


def open_windows(spark: SparkSession, checkpoint: str, operator: int = 0, batch: int | None = None) -> DataFrame:
    """Windows that a stopped stream still holds: their bounds, their keys, and the partial results in the order of the aggregates."""
    rows = state_rows(spark, checkpoint, operator, batch)
    keys = [f.name for f in rows.schema["key"].dataType if f.name != "window"]
    return rows.select(
        F.col("key.window.start").alias("window_start"), F.col("key.window.end").alias("window_end"),
        *(F.col("key")[k].alias(k) for k in keys), "value.*",
    )


def state_changes(spark: SparkSession, checkpoint: str, first: int, last: int, operator: int = 0) -> DataFrame:
    """``batch_id``, ``change_type`` (update or delete), keys and values, change by change."""
    reader = spark.read.format("statestore").option("operatorId", operator).option("readChangeFeed", True)
    return reader.option("changeStartBatchId", first).option("changeEndBatchId", last).load(checkpoint)
