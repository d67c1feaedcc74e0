"""Auction queries: currency, selection, hot items, new sellers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import one_of, project_at
from ..operators.joins import window_join
from ..operators.ranking import most_frequent
from ..operators.windows import WindowSpec
from . import sqltext as sql
from .campaign import minutes
from .registry import query
from .views import AUCTIONS, BIDS, table

# The auctions the selection query asks for.
CHOSEN_AUCTIONS = (1007, 1020, 2001, 2019, 2087)


@query("auction_q1_currency", f"SELECT auction, price * 89 / 100 AS price, ts FROM {BIDS.sql}")
def auction_q1_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    bids = BIDS.frame(spark, sf_dir).select("auction", "bidder", "price", "ts")
    return project_at(bids.withColumn("price", F.col("price") * 89 / 100), [0, 2, 3])


@query("auction_q2_filter", f"SELECT auction, price FROM {BIDS.sql} WHERE auction IN (1007, 1020, 2001, 2019, 2087)")
def auction_q2_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BIDS.frame(spark, sf_dir).filter(one_of("auction", CHOSEN_AUCTIONS)).select("auction", "price")


@query(
    "auction_q5_hot_items",
    "SELECT window_start, window_end, auction, n FROM (SELECT *, rank() OVER (PARTITION BY window_start ORDER BY n "
    f"DESC) AS r FROM ({sql.sliding(BIDS.sql, 60 * sql.DAY, sql.DAY, ['auction'], 'count(*) AS n')})) WHERE r = 1",
)
def auction_q5_hot_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60/1 count per auction, the most bid-on ones of each window."""
    spec = WindowSpec.sliding(minutes(60 * sql.DAY), minutes(sql.DAY))
    return most_frequent(BIDS.frame(spark, sf_dir), spec, ["auction"])


_PERSONS = (
    "(SELECT o_custkey AS person_id, c_name AS name, min(CAST(o_orderdate AS TIMESTAMP)) AS person_ts FROM orders "
    "JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"
)


@query(
    "auction_q8_window_join",
    "SELECT make_timestamp(epoch_us(person_ts) // 43200000000 * 43200000000) AS window_start, person_id, name, "
    f"auction_id, CAST(reserve AS DOUBLE) AS reserve FROM {_PERSONS} p JOIN {AUCTIONS.sql} a ON a.seller = p.person_id "
    "AND epoch_us(person_ts) // 43200000000 = epoch_us(auction_ts) // 43200000000",
)
def auction_q8_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons and the auctions they opened within the same 12 hours as they came."""
    auctions = AUCTIONS.frame(spark, sf_dir)
    first = auctions.groupBy("seller").agg(F.min("auction_ts").alias("person_ts"))
    names = table(spark, sf_dir, "customer").selectExpr("c_custkey AS person_id", "c_name AS name")
    persons = first.withColumnRenamed("seller", "person_id").join(names, "person_id")
    spec = WindowSpec.tumbling(minutes(12 * 60))
    pairs = window_join(persons, auctions, spec, [("person_id", "seller")], "person_ts", "auction_ts")
    return pairs.select("window_start", "person_id", "name", "auction_id", "reserve")
