"""Ad-campaign queries: counts and sums per campaign and window."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggregates import avg_of, count, max_of, sum_of
from ..functions.expressions import composite_key, hash_bucket
from ..operators.joins import join_static
from ..operators.predicate_index import indexed_queries
from ..operators.time_windows import window_aggregate
from ..operators.windows import WindowSpec
from ..streaming.runner import shared_queries
from . import sqltext as sql
from .registry import query
from .views import ADS, CAMPAIGN


def minutes(n: int) -> timedelta:
    return timedelta(minutes=n)


@query("campaign_view_count", sql.tumbling(CAMPAIGN.sql, 10, ["campaign_id"], "count(*) AS n", "event_type = 'view'"))
def campaign_view_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = CAMPAIGN.frame(spark, sf_dir).filter("event_type = 'view'")
    return window_aggregate(views, WindowSpec.tumbling(minutes(10)), ["campaign_id"], [count()])


@query(
    "campaign_sum_tumbling",
    sql.tumbling(CAMPAIGN.sql, 1, ["campaign_id"], sql.total("user_id", "sum_user", "BIGINT"), "event_code = 2"),
)
def campaign_sum_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = CAMPAIGN.frame(spark, sf_dir).filter("event_code = 2")
    narrow = kept.select("ts", "campaign_id", F.col("user_id").cast("int").alias("user_id"))
    return window_aggregate(narrow, WindowSpec.tumbling(minutes(1)), ["campaign_id"], [sum_of("user_id", "sum_user")])


@query(
    "campaign_window_2s",
    sql.tumbling(CAMPAIGN.sql, 2, ["campaign_id"], sql.total("user_id", "sum_user", "BIGINT")),
)
def campaign_window_2s(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = WindowSpec.tumbling(minutes(2))
    return window_aggregate(CAMPAIGN.frame(spark, sf_dir), spec, ["campaign_id"], [sum_of("user_id", "sum_user")])


_JOINED = (
    f"(SELECT c.ts, a.campaign_id FROM {CAMPAIGN.sql} c JOIN {ADS.sql} a ON c.ad_id = a.ad_id WHERE c.event_code = 0)"
)


@query(
    "campaign_static_join_count",
    sql.tumbling(_JOINED, 100, ["campaign_id"], "count(*) AS n, max(ts) AS last_ts"),
)
def campaign_static_join_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = CAMPAIGN.frame(spark, sf_dir).filter("event_code = 0").select("ts", "ad_id")
    joined = join_static(stream, ADS.frame(spark, sf_dir), "ad_id")
    spec = WindowSpec.tumbling(minutes(100))
    return window_aggregate(joined, spec, ["campaign_id"], [count(), max_of("ts", "last_ts")])


@query(
    "campaign_avg_10000",
    sql.tumbling(CAMPAIGN.sql, 10_000, ["ad_id"], sql.average("user_id", "avg_user"), "event_code = 0"),
)
def campaign_avg_10000(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = CAMPAIGN.frame(spark, sf_dir).filter("event_code = 0")
    return window_aggregate(kept, WindowSpec.tumbling(minutes(10_000)), ["ad_id"], [avg_of("user_id", "avg_user")])


@query(
    "campaign_count_batch",
    f"SELECT campaign_id, count(*) AS n FROM {CAMPAIGN.sql} WHERE event_type = 'view' GROUP BY campaign_id",
)
def campaign_count_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = CAMPAIGN.frame(spark, sf_dir).filter("event_type = 'view'")
    return views.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "campaign_bucket_count",
    f"SELECT (campaign_id * 789 + 321) % 16 AS bucket, count(*) AS n FROM {CAMPAIGN.sql} GROUP BY 1",
)
def campaign_bucket_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucketed = CAMPAIGN.frame(spark, sf_dir).select(hash_bucket("campaign_id", 789, 321, 16).alias("bucket"))
    return bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(
    "campaign_composite_key",
    f"SELECT CAST(campaign_id AS VARCHAR) || '-' || CAST(page_id AS VARCHAR) AS campaign_key, count(*) AS n "
    f"FROM {CAMPAIGN.sql} GROUP BY 1",
)
def campaign_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = CAMPAIGN.frame(spark, sf_dir).select(composite_key("campaign_id", "page_id").alias("campaign_key"))
    return keyed.groupBy("campaign_key").agg(F.count(F.lit(1)).alias("n"))


_SHARED = " UNION ALL ".join(
    f"SELECT 'q{code}' AS query_id, * FROM ("
    + sql.tumbling(
        CAMPAIGN.sql, 60, ["campaign_id"], "count(*) AS n, " + sql.total("user_id", "sum_user", "BIGINT"),
        f"event_code {test}",
    )
    + ")"
    for code, test in enumerate(("= 2", "= 2", "= 0", ">= 1"))
)


@query("multi_query_shared", _SHARED)
def multi_query_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four campaign queries, two of them equal, over one scan and one shuffle."""
    code = F.col("event_code")
    predicates = {"q0": code == 2, "q1": code == 2, "q2": code == 0, "q3": code >= 1}
    rows = shared_queries(CAMPAIGN.frame(spark, sf_dir), predicates, ["ts", "campaign_id", "user_id"])
    spec = WindowSpec.tumbling(minutes(60))
    return window_aggregate(rows, spec, ["query_id", "campaign_id"], [count(), sum_of("user_id", "sum_user")])


_RANGES = """SELECT id AS query_id, CASE WHEN id % 2 = 0 THEN 'user_id' ELSE 'event_id' END AS col,
    CASE WHEN id % 2 = 0 THEN id * 37 % 500 ELSE id * 7919 % 20000 END AS low,
    CASE WHEN id % 2 = 0 THEN id * 37 % 500 + id % 50 ELSE id * 7919 % 20000 + id * 3 END AS high FROM range(1000)"""


@query(
    "multi_query_indexed",
    f"WITH q AS ({_RANGES.replace('range(1000)', 'range(1000) r(id)')}), e AS (SELECT * FROM {CAMPAIGN.sql}), "
    f"met AS (SELECT query_id, ts FROM q JOIN e ON (col = 'user_id' AND user_id BETWEEN low AND high) OR "
    f"(col = 'event_id' AND event_id BETWEEN low AND high)) {sql.tumbling('met', sql.DAY, ['query_id'], 'count(*) AS n')}",
)
def multi_query_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand queries, each a range of users or of events, counted per day; rows find their queries by equality."""
    queries = spark.sql(_RANGES).withColumnRenamed("col", "column")
    rows = indexed_queries(CAMPAIGN.frame(spark, sf_dir), queries, ["user_id", "event_id"], ["ts"])
    return window_aggregate(rows, WindowSpec.tumbling(minutes(sql.DAY)), ["query_id"], [count()])
