"""Topics as source and sink (needs the Kafka connector on the class path)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from .frames import Layout, decode_frames, encode_frames


def read_topic(spark: SparkSession, servers: str, topic: str, starting: str = "latest") -> DataFrame:
    """The messages of a topic as a stream; ``value`` is binary."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return reader.option("subscribe", topic).option("startingOffsets", starting).load()


def read_frames(spark: SparkSession, servers: str, topic: str, layout: Layout) -> DataFrame:
    """The records inside the frames of a topic."""
    return decode_frames(read_topic(spark, servers, topic), layout)


def messages(df: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Rows as messages, column ``value``: frames of a layout, or else a JSON text each. Works on tables and on streams."""
    return encode_frames(df, layout) if layout else df.selectExpr("to_json(struct(*)) AS value")


def write_topic(
    df: DataFrame, servers: str, topic: str, checkpoint: str, layout: Layout | None = None
) -> DataStreamWriter:
    """A writer of rows as ``messages``; start it to run."""
    writer = messages(df, layout).writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return writer.option("topic", topic).option("checkpointLocation", checkpoint)
