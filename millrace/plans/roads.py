"""Road queries: slow segments, vehicles per segment, stops, accidents, tolls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggregates import avg_of, count
from ..functions.expressions import int_div
from ..operators import road
from ..operators.row_windows import row_window_aggregate
from ..operators.time_windows import window_aggregate, window_stretches
from ..operators.windows import WindowSpec
from . import sqltext as sql
from .campaign import minutes
from .registry import query
from .views import ROAD, TRAFFIC

# one time unit of the road queries is ten days of the line items
UNIT = sql.DAY
FEET_PER_SEGMENT = 5280
SEGMENT = ["highway", "direction", "segment"]
_ROAD = f"(SELECT *, position // {FEET_PER_SEGMENT} AS segment FROM {ROAD.sql})"


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ROAD.frame(spark, sf_dir).withColumn("segment", int_div("position", FEET_PER_SEGMENT))


@query(
    "road_slow_segments",
    "SELECT * FROM ("
    + sql.sliding(_ROAD, 300 * UNIT, UNIT, SEGMENT, sql.average("speed", "avg_speed"))
    + ") WHERE avg_speed < 40",
)
def road_slow_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average speed per segment over 300/1, only the slow ones."""
    spec = WindowSpec.sliding(minutes(300 * UNIT), minutes(UNIT))
    slow = F.col("avg_speed") < 40
    return window_aggregate(segmented(spark, sf_dir), spec, SEGMENT, [avg_of("speed", "avg_speed")], having=slow)


_THIRTY = WindowSpec.sliding(minutes(30 * UNIT), minutes(UNIT))
_VEHICLES = sql.sliding(_ROAD, 30 * UNIT, UNIT, ["vehicle", *SEGMENT], "count(*) AS n")


@query("road_vehicle_segments", _VEHICLES)
def road_vehicle_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports per vehicle and segment over 30/1."""
    return window_aggregate(segmented(spark, sf_dir), _THIRTY, ["vehicle", *SEGMENT], [count()])


_CASCADE_KEYS = ["vehicle", *SEGMENT]
_CASCADE_ORDER = ["window_start", *_CASCADE_KEYS]


@query(
    "road_vehicle_cascade",
    "SELECT window_index, highway, direction, segment, count(*) AS n FROM ("
    f"SELECT *, (row_number() OVER (ORDER BY {', '.join(_CASCADE_ORDER)}) - 1) // 1024 AS window_index, "
    f"count(*) OVER () AS total FROM ({_VEHICLES})) WHERE (window_index + 1) * 1024 <= total GROUP BY 1, 2, 3, 4",
)
def road_vehicle_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vehicles of the query above, counted per segment in every 1024 result rows."""
    vehicles = window_stretches(segmented(spark, sf_dir), _THIRTY, _CASCADE_KEYS, [count()])
    return row_window_aggregate(vehicles, WindowSpec.rows(1024), _CASCADE_KEYS, SEGMENT, [count()], stretch=("_at", "_until"))


STOPS_SQL = f"""
WITH r AS (SELECT * FROM {TRAFFIC.sql}),
seq AS (SELECT *, row_number() OVER v AS i,
    coalesce(speed = 0 AND lag(speed) OVER v = 0 AND lag(position) OVER v = position
             AND lag(highway) OVER v = highway, false) AS held
    FROM r WINDOW v AS (PARTITION BY vehicle ORDER BY ts, report_id)),
runs AS (SELECT *, sum(CASE WHEN held THEN 0 ELSE 1 END) OVER (PARTITION BY vehicle ORDER BY i) AS run FROM seq),
places AS (SELECT vehicle, run, min(highway) AS highway, min(position) AS position, min(ts) AS first_ts,
    arg_min(segment, i) AS first_segment, count(*) AS len FROM runs GROUP BY vehicle, run),
fourth AS (SELECT vehicle, run, ts AS stopped_at, segment FROM (SELECT *, row_number() OVER (PARTITION BY vehicle, run
    ORDER BY i) AS nth FROM runs) WHERE nth = 4),
stops AS (SELECT p.vehicle, p.highway, p.position, f.segment, p.first_ts, f.stopped_at, n.first_ts AS cleared_at
    FROM places p JOIN fourth f USING (vehicle, run) LEFT JOIN places n ON n.vehicle = p.vehicle AND n.run = p.run + 1
    WHERE p.len >= 4)
"""


@query("road_stopped_vehicles", STOPS_SQL + "SELECT * FROM stops")
def road_stopped_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return road.stopped_vehicles(TRAFFIC.frame(spark, sf_dir))


# an accident begins where the number of standing vehicles, recounted at every instant, reaches two
ACCIDENTS_SQL = (
    STOPS_SQL
    + """,
instants AS (SELECT DISTINCT highway, position, segment, moment FROM (
    SELECT highway, position, segment, stopped_at AS moment FROM stops UNION ALL
    SELECT highway, position, segment, cleared_at FROM stops WHERE cleared_at IS NOT NULL)),
counted AS (SELECT t.highway, t.position, t.segment, t.moment, count(s.vehicle) AS standing FROM instants t
    LEFT JOIN stops s ON s.highway = t.highway AND s.position = t.position AND s.segment = t.segment
    AND s.stopped_at <= t.moment AND (s.cleared_at IS NULL OR s.cleared_at > t.moment) GROUP BY 1, 2, 3, 4),
turns AS (SELECT * FROM (SELECT *, coalesce(lag(standing) OVER w, 0) AS before FROM counted
    WINDOW w AS (PARTITION BY highway, position, segment ORDER BY moment)) WHERE (standing >= 2) <> (before >= 2)),
accidents AS (SELECT highway, position, segment, moment AS started_at, ended_at FROM (SELECT *, lead(moment) OVER
    (PARTITION BY highway, position, segment ORDER BY moment) AS ended_at FROM turns) WHERE standing >= 2)
"""
)


@query("road_accidents", ACCIDENTS_SQL + "SELECT * FROM accidents")
def road_accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return road.accidents(road.stopped_vehicles(TRAFFIC.frame(spark, sf_dir)))


def _averages(source: str, width: int) -> str:
    parts = sql.tumbling(source, width, ["highway", "segment"], "count(*) AS c, sum(speed) AS s")
    upto = "(PARTITION BY highway, segment ORDER BY window_start)"
    return (
        f"SELECT window_start, window_end, highway, segment, CAST(sum(c) OVER {upto} AS BIGINT) AS reports, "
        f"CAST(sum(s) OVER {upto} AS DOUBLE) / sum(c) OVER {upto} AS avg_speed FROM ({parts})"
    )


@query("road_segment_avg", _averages(_ROAD, 30 * UNIT))
def road_segment_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return road.segment_averages(segmented(spark, sf_dir), WindowSpec.tumbling(minutes(30 * UNIT)))


TOLLS_SQL = (
    ACCIDENTS_SQL
    + f", averages AS ({_averages(TRAFFIC.sql, 300)}) SELECT a.*, CASE WHEN EXISTS (SELECT 1 FROM accidents x WHERE "
    "x.highway = a.highway AND x.segment = a.segment AND x.started_at < a.window_end AND (x.ended_at IS NULL OR "
    "x.ended_at > a.window_start)) THEN 0.0 ELSE CAST(4 * reports * reports AS DOUBLE) END AS toll FROM averages a "
    "WHERE avg_speed > 40"
)


@query("road_tolls", TOLLS_SQL)
def road_tolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of tolls at every 300 minutes."""
    return road.tolls(TRAFFIC.frame(spark, sf_dir), WindowSpec.tumbling(minutes(300)))
