"""Workload streams as views over the given tables.

Every column is one SQL expression that means the same in Spark and in the checking SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


@dataclass(frozen=True)
class View:
    source: str
    columns: dict[str, str]

    def project(self, df: DataFrame) -> DataFrame:
        return df.selectExpr(*self._columns())

    def _columns(self) -> list[str]:
        return [name if expr == name else f"{expr} AS {name}" for name, expr in self.columns.items()]

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.project(table(spark, sf_dir, self.source))

    @property
    def sql(self) -> str:
        return f"(SELECT {', '.join(self._columns())} FROM {self.source})"


_TIME = "CAST(ts AS TIMESTAMP)"
_SHIPPED = "CAST(l_shipdate AS TIMESTAMP)"
_CODE = (
    "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"
)
_VALUE = "CAST(value AS DECIMAL(18,2))"

EVENTS = View(
    "events",
    {"event_id": "event_id", "ts": _TIME, "user_id": "user_id", "event_type": "event_type", "value": _VALUE},
)
CAMPAIGN = View(
    "events",
    {
        "event_id": "event_id",
        "ts": _TIME,
        "user_id": "user_id",
        "page_id": "event_id % 100",
        "ad_id": "event_id % 1000",
        "campaign_id": "event_id % 50",
        "event_type": "event_type",
        "event_code": _CODE,
    },
)
ADS = View("part", {"ad_id": "p_partkey", "campaign_id": "CAST(p_size AS BIGINT)"})
CLUSTER = View(
    "events",
    {"ts": _TIME, "job_id": "user_id", "category": "user_id % 7", "event_code": _CODE, "cpu": _VALUE},
)
GRID = View(
    "events",
    {
        "ts": _TIME,
        "value": _VALUE,
        "plug": "event_id % 4",
        "household": "event_id % 5",
        "house": "user_id % 10",
    },
)
ROAD = View(
    "lineitem",
    {
        "ts": _SHIPPED,
        "vehicle": "l_suppkey",
        "speed": "CAST(l_quantity AS BIGINT) * 3",
        "highway": "l_linenumber",
        "direction": "l_returnflag",
        "position": "l_partkey * 264",
        "order_key": "l_orderkey",
        "price": "CAST(l_extendedprice AS DECIMAL(18,2))",
        "discount": "CAST(l_discount AS DECIMAL(18,2))",
        "tax": "CAST(l_tax AS DECIMAL(18,2))",
        "status": "l_linestatus",
    },
)
# vehicles stand still in every other stretch of 2000 reports, except where a purchase moves them
TRAFFIC = View(
    "events",
    {
        "ts": _TIME,
        "report_id": "event_id",
        "vehicle": "user_id % 50",
        "highway": "user_id % 5",
        "speed": "CASE WHEN event_type <> 'purchase' AND event_id % 4000 < 2000 THEN CAST(0 AS DECIMAL(18,2)) "
        "ELSE CAST(value * 4 AS DECIMAL(18,2)) END",
        "position": "CAST(floor(event_id / 4000) AS BIGINT) * 2640",
        "segment": "CAST(floor(event_id / 8000) AS BIGINT)",
    },
)
EQUIPMENT = View(
    "events",
    {
        "ts": _TIME,
        "idx": "event_id",
        "mf01": "CAST(floor(value) AS BIGINT)",
        "mf02": "user_id",
        "mf03": "event_id % 97",
    },
)
BIDS = View(
    "lineitem",
    {"ts": _SHIPPED, "auction": "l_partkey", "bidder": "l_suppkey", "price": "l_extendedprice"},
)
AUCTIONS = View(
    "orders",
    {
        "auction_ts": "CAST(o_orderdate AS TIMESTAMP)",
        "auction_id": "o_orderkey",
        "seller": "o_custkey",
        "reserve": "CAST(o_totalprice AS DECIMAL(18,2))",
    },
)
