"""Measurements: rates, latencies, log summaries, column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import measure
from ..session import shared_path
from .registry import query
from .views import EVENTS, View

_WORKERS = View("events", {"event_id": "event_id", "ts": "CAST(ts AS TIMESTAMP)", "worker": "user_id % 8"})


@query(
    "metric_throughput",
    "SELECT worker, report, millis, CASE WHEN millis > 0 THEN 50.0::DOUBLE * 1000 / millis END AS elements_per_second "
    "FROM (SELECT worker, i // 50 AS report, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY worker ORDER BY i) AS "
    "millis FROM (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY ts, event_id) AS i FROM "
    f"{_WORKERS.sql}) WHERE i % 50 = 0) WHERE millis IS NOT NULL",
)
def metric_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.throughput(_WORKERS.frame(spark, sf_dir), 50, "worker", ["ts", "event_id"])


def _percentile(p: int) -> str:
    position = f"({p} * (n + 1) / 100.0)"
    low = f"list[greatest(floor({position})::INT, 1)]"
    high = f"list[least(floor({position})::INT + 1, n)]"
    return (
        f"CASE WHEN {position} < 1 THEN list[1] WHEN {position} >= n THEN list[n] ELSE {low} + ({position} - "
        f"floor({position})) * ({high} - {low}) END AS p{p}"
    )


@query(
    "metric_latency",
    "SELECT n, mean, list[1] AS low, list[n] AS high, "
    + ", ".join(_percentile(p) for p in measure.PERCENTILES)
    + " FROM (SELECT count(*) AS n, CAST(sum(value) AS DOUBLE) / count(*) AS mean, list(value::DOUBLE ORDER BY value) "
    f"AS list FROM {EVENTS.sql})",
)
def metric_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.latency(EVENTS.frame(spark, sf_dir).select("value"), "value")


# the log lines are written out from the events: a third kind of line carries no rate
_RATE = "(event_id % 1000 + 1) / CAST(4 AS DOUBLE)"
_LOGS = View(
    "events",
    {"worker": "user_id % 8", "query_id": "event_id % 3", "rate": f"CAST({_RATE} AS DECIMAL(18,2))", "kind": "event_type"},
)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _LOGS.frame(spark, sf_dir).selectExpr(
        "CASE WHEN kind = 'error' THEN concat('Worker: ', worker, ' was restarted. Query ', query_id) "
        "ELSE concat('INFO Worker: ', worker, ' During the last 1000 ms, we received 500 elements. That\\'s ', rate, "
        "' elements/second/core. 1.5 MB/sec/core. GB received 3. Query ', query_id) END AS value"
    )
    path = shared_path(spark, "logs")
    lines.write.text(path)
    return spark.read.text(path)


def _log_sql(keys: str) -> str:
    return (
        f"SELECT *, CAST(sum(CAST(mean_rate AS DECIMAL(38,9))) OVER () AS DOUBLE) AS sum_of_means FROM (SELECT {keys}, count(*) AS entries, "
        f"CAST(sum(rate) AS DOUBLE) / count(*) AS mean_rate FROM {_LOGS.sql} WHERE kind <> 'error' GROUP BY ALL)"
    )


@query("logs_throughput", _log_sql("CAST(worker AS VARCHAR) AS worker"))
def logs_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.log_rates(log_lines(spark, sf_dir))


@query("logs_throughput_by_query", _log_sql("CAST(worker AS VARCHAR) AS worker, CAST(query_id AS VARCHAR) AS query"))
def logs_throughput_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.log_rates(log_lines(spark, sf_dir), by_query=True)


_PROFILED = View(
    "events",
    {
        "event_id": "event_id",
        "ts": "CAST(ts AS TIMESTAMP)",
        "block": "CAST(floor(event_id / 9) AS BIGINT)",
        "user_id": "user_id",
        "price": "CAST(value AS DOUBLE)",
    },
)


def _bits(value: str) -> str:
    return (
        f"CASE WHEN {value} >= 0 AND floor({value}) = {value} THEN "
        f"CASE WHEN {value} = 0 THEN 1 ELSE floor(log2({value}))::INT + 1 END END"
    )


@query(
    "profile_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, low, high, {_bits('high')} AS value_bits, {_bits('(high - low)')} AS range_bits, "
        "n / runs AS mean_run, ceil(n / runs) - 1 >= 5 AS use_rle FROM (SELECT min(v)::DOUBLE AS low, max(v)::DOUBLE AS "
        "high, count(*)::DOUBLE AS n, sum(CASE WHEN v = p THEN 0 ELSE 1 END)::DOUBLE AS runs FROM (SELECT "
        f"{c} AS v, lag({c}) OVER (ORDER BY ts, event_id) AS p FROM {_PROFILED.sql}))"
        for c in ("block", "user_id", "price")
    ),
)
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.profile_columns(_PROFILED.frame(spark, sf_dir), ["block", "user_id", "price"], ["ts", "event_id"])
