"""The list of runnable queries and, next to each, SQL with the same meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` answers it on the same tables."""

    def add(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return present(build(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return build

    return add


def present(df: DataFrame) -> DataFrame:
    """Plain output types: times without a zone, decimals as doubles."""
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz").alias(field.name)
        elif isinstance(field.dataType, T.DecimalType):
            column = column.cast("double").alias(field.name)
        columns.append(column)
    return df.select(*columns)
