"""Smart-grid queries: average load in long sliding windows, and plugs above the global average."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggregates import avg_of, count
from ..operators.panes import partial_names
from ..operators.time_windows import PANE, panes_of, window_aggregate, windows_of_panes
from ..operators.windows import WindowSpec
from . import sqltext as sql
from .campaign import minutes
from .registry import query
from .views import GRID

PLUG = ["plug", "household", "house"]
_AVG = sql.average("value", "load")


@query("grid_global_load", sql.sliding(GRID.sql, 3600, 1, [], _AVG))
def grid_global_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3600/1 over all plugs."""
    spec = WindowSpec.sliding(minutes(3600), minutes(1))
    return window_aggregate(GRID.frame(spark, sf_dir), spec, [], [avg_of("value", "load")])


# one time unit of the per-plug queries is an hour of the event table
_LOCAL = WindowSpec.sliding(minutes(128 * 60), minutes(60))


@query("grid_plug_load", sql.sliding(GRID.sql, 128 * 60, 60, PLUG, _AVG))
def grid_plug_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """128/1 per plug."""
    return window_aggregate(GRID.frame(spark, sf_dir), _LOCAL, PLUG, [avg_of("value", "load")])


@query("grid_household_filtered", sql.sliding(GRID.sql, 3600 * 60, 60, PLUG, _AVG, "household = 3"))
def grid_household_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The load of one household over 3600/1."""
    spec = WindowSpec.sliding(minutes(3600 * 60), minutes(60))
    kept = GRID.frame(spark, sf_dir).filter("household = 3")
    return window_aggregate(kept, spec, PLUG, [avg_of("value", "load")])


@query(
    "grid_outliers",
    "SELECT l.*, g.global_load FROM ("
    + sql.sliding(GRID.sql, 128 * 60, 60, PLUG, sql.average("value", "local_load") + ", count(*) AS n")
    + ") l JOIN ("
    + sql.sliding(GRID.sql, 128 * 60, 60, [], sql.average("value", "global_load"))
    + ") g ON l.window_start = g.window_start WHERE g.global_load < l.local_load",
)
def grid_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plugs whose average lies above the global average of the same window.

    The events are read once: the global panes are merged from the panes of the plugs.
    """
    local_aggs, global_aggs = [avg_of("value", "local_load"), count()], [avg_of("value", "global_load")]
    panes = panes_of(GRID.frame(spark, sf_dir), _LOCAL, PLUG, [*local_aggs, *global_aggs])
    merges = [F.sum(c).alias(c) for c in partial_names(global_aggs)]
    overall = windows_of_panes(panes.groupBy(PANE).agg(*merges), _LOCAL, [], global_aggs, exact=True)
    local = windows_of_panes(panes, _LOCAL, PLUG, local_aggs, exact=True)
    joined = local.join(overall.drop("window_end"), "window_start")
    return joined.filter(F.col("global_load") < F.col("local_load"))
