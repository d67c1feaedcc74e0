"""Cluster-monitoring queries: processor use per category and per job (60/1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.aggregates import sum_of
from ..operators.time_windows import window_aggregate
from ..operators.windows import WindowSpec
from . import sqltext as sql
from .campaign import minutes
from .registry import query
from .views import CLUSTER

# one time unit of the workload is ten minutes of the event table
_SPEC = WindowSpec.sliding(minutes(600), minutes(10))


@query("cluster_cpu_by_category", sql.sliding(CLUSTER.sql, 600, 10, ["category"], sql.total("cpu", "cpu")))
def cluster_cpu_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_aggregate(CLUSTER.frame(spark, sf_dir), _SPEC, ["category"], [sum_of("cpu", "cpu")])


@query("cluster_cpu_by_job", sql.sliding(CLUSTER.sql, 600, 10, ["job_id"], sql.total("cpu", "cpu"), "event_code = 3"))
def cluster_cpu_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    submitted = CLUSTER.frame(spark, sf_dir).filter("event_code = 3")
    return window_aggregate(submitted, _SPEC, ["job_id"], [sum_of("cpu", "cpu")])


@query("cluster_cpu_total", sql.tumbling(CLUSTER.sql, 60, [], sql.total("cpu", "cpu")))
def cluster_cpu_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ungrouped 60/60 form."""
    return window_aggregate(CLUSTER.frame(spark, sf_dir), WindowSpec.tumbling(minutes(60)), [], [sum_of("cpu", "cpu")])
