"""Manufacturing-equipment queries: three averages in a 60/1 window, as columns and as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggregates import avg_of
from ..operators.time_windows import window_aggregate
from ..operators.windows import WindowSpec
from . import sqltext as sql
from .campaign import minutes
from .registry import query
from .views import EQUIPMENT

_SENSORS = ("mf01", "mf02", "mf03")
_SPEC = WindowSpec.sliding(minutes(60), minutes(1))
_AVERAGES = ", ".join(sql.average(s, f"avg_{s}") for s in _SENSORS)


@query("equipment_three_avgs", sql.sliding(EQUIPMENT.sql, 60, 1, [], _AVERAGES))
def equipment_three_avgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass for all three."""
    return window_aggregate(EQUIPMENT.frame(spark, sf_dir), _SPEC, [], [avg_of(s, f"avg_{s}") for s in _SENSORS])


@query(
    "equipment_union_avgs",
    " UNION ALL ".join(
        f"SELECT '{s}' AS sensor, * FROM ({sql.sliding(EQUIPMENT.sql, 60, 1, [], sql.average(s, 'average'))})"
        for s in _SENSORS
    ),
)
def equipment_union_avgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three averages merged into one stream: computed once, then turned into rows."""
    wide = equipment_three_avgs(spark, sf_dir)
    rows = F.array(*(F.struct(F.lit(s).alias("sensor"), F.col(f"avg_{s}").alias("average")) for s in _SENSORS))
    return wide.select("window_start", "window_end", F.inline(rows))
