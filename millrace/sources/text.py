"""Delimited text sources with declared schemas, for files and for streams of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the text layouts, in the order of a line.
CLUSTER = (
    "ts BIGINT, job_id BIGINT, task_id BIGINT, machine_id BIGINT, event_type INT, user_id INT, category INT, "
    "priority INT, cpu FLOAT, ram FLOAT, disk FLOAT, constraints INT"
)
GRID = "ts BIGINT, value FLOAT, property INT, plug INT, household INT, house INT"
ROAD = "ts BIGINT, vehicle INT, speed FLOAT, highway INT, lane INT, direction INT, position INT"
EQUIPMENT = (
    "iso_time STRING, message_index BIGINT, mf01 INT, mf02 INT, mf03 INT, pc13 INT, pc14 INT, pc15 INT, "
    "pc25 INT, pc26 INT, pc27 INT, res INT, bm05 INT, bm06 INT"
)
ROAD_INPUT = (
    "type INT, time INT, vid INT, speed INT, xway INT, lane INT, dir INT, seg INT, pos INT, qid INT, "
    "s_init INT, s_end INT, dow INT, tod INT, day INT"
)


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = " ", streaming: bool = False) -> DataFrame:
    """Typed rows of delimited text lines."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).option("sep", sep).csv(path)


def normalise_time(df: DataFrame, ts: str = "ts", origin: int | None = None) -> DataFrame:
    """Count time from the first row; a stream cannot know it and needs a fixed ``origin``."""
    if origin is not None:
        first: Column = F.lit(origin)
    elif df.isStreaming:
        raise ValueError("a stream needs a fixed origin")
    else:
        first = df.agg(F.min(ts)).scalar()
    return df.withColumn(ts, F.col(ts) - first)


def read_equipment(spark: SparkSession, path: str, epoch: str, streaming: bool = False) -> DataFrame:
    """Tab-separated equipment lines; ISO time becomes whole seconds since ``epoch``."""
    rows = read_delimited(spark, path, EQUIPMENT, sep="\t", streaming=streaming)
    seconds = F.call_function(
        "div", F.unix_micros(F.to_timestamp("iso_time")) - F.unix_micros(F.to_timestamp(F.lit(epoch))), F.lit(1_000_000)
    )
    return rows.withColumn("ts", seconds).select("ts", *(c for c in rows.columns if c != "iso_time"))


def read_road_reports(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Position reports (type 0) of the full road input."""
    rows = read_delimited(spark, path, ROAD_INPUT, sep=",", streaming=streaming)
    return rows.filter("type = 0").select("time", "vid", "speed", "xway", "seg", "pos")
