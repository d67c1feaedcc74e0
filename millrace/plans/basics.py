"""One query per basic operator: filters, projections, joins, aggregates, windows, user code."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions import table_functions, udf
from ..functions.expressions import all_of, any_of, int_div, project_at
from ..operators.joins import join_selectivity, join_static, theta_join_rows, theta_join_time
from ..operators.panes import pane_aggregate
from ..operators.row_windows import row_window_aggregate
from ..operators.time_windows import fill_gaps, shared_windows, window_aggregate
from ..operators.windows import MICROS, WindowSpec, time_slot
from ..streaming.runner import arrival_time
from . import sqltext as sql
from .campaign import minutes
from .registry import query
from .views import ADS, CAMPAIGN, EVENTS, ROAD, View

HOUR = WindowSpec.tumbling(minutes(60))
TYPE = ["event_type"]


# filters and projections


@query("filter_eq", f"SELECT event_id, user_id FROM {EVENTS.sql} WHERE user_id = 3")
def filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EVENTS.frame(spark, sf_dir).filter(F.col("user_id") == 3).select("event_id", "user_id")


@query(
    "filter_comparisons",
    "SELECT sum((user_id = 3)::INT)::BIGINT AS eq, sum((user_id <> 3)::INT)::BIGINT AS ne, sum((user_id < "
    "3)::INT)::BIGINT AS lt, sum((user_id >= 3)::INT)::BIGINT AS ge, sum((user_id > 3)::INT)::BIGINT AS gt, "
    f"sum((user_id <= 3)::INT)::BIGINT AS le FROM {EVENTS.sql}",
)
def filter_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    tests = {"eq": user == 3, "ne": user != 3, "lt": user < 3, "ge": user >= 3, "gt": user > 3, "le": user <= 3}
    return EVENTS.frame(spark, sf_dir).agg(*(F.count(F.when(t, 1)).alias(name) for name, t in tests.items()))


@query(
    "filter_and_or",
    f"SELECT event_id, user_id, event_type FROM {EVENTS.sql} WHERE (event_type = 'view' OR event_type = 'click') AND "
    "user_id < 20 AND value > 10",
)
def filter_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = any_of(F.col("event_type") == "view", F.col("event_type") == "click")
    kept = EVENTS.frame(spark, sf_dir).filter(all_of(kind, F.col("user_id") < 20, F.col("value") > 10))
    return kept.select("event_id", "user_id", "event_type")


@query(
    "filter_string",
    f"SELECT event_id, event_type FROM {EVENTS.sql} WHERE event_type = 'purchase' OR event_type LIKE 'view%'",
)
def filter_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return EVENTS.frame(spark, sf_dir).filter((kind == "purchase") | kind.startswith("view")).select("event_id", kind)


@query("project_columns", f"SELECT ts, user_id, 7 AS seven FROM {EVENTS.sql}")
def project_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EVENTS.frame(spark, sf_dir).select("ts", "user_id", F.lit(7).alias("seven"))


@query(
    "project_arith",
    f"SELECT order_key, (speed + 10) * 2 - vehicle AS mixed, speed / 4.0::DOUBLE AS quarter FROM {ROAD.sql}",
)
def project_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    speed = F.col("speed")
    mixed = (speed + 10) * 2 - F.col("vehicle")
    return ROAD.frame(spark, sf_dir).select("order_key", mixed.alias("mixed"), (speed / 4.0).alias("quarter"))


@query("project_int_div", f"SELECT order_key, position // 5280 AS segment FROM {ROAD.sql}")
def project_int_div(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ROAD.frame(spark, sf_dir).select("order_key", int_div("position", 5280).alias("segment"))


# joins


@query(
    "join_stream_static",
    f"SELECT c.event_id, c.ad_id, a.campaign_id FROM {CAMPAIGN.sql} c JOIN {ADS.sql} a ON c.ad_id = a.ad_id",
)
def join_stream_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = CAMPAIGN.frame(spark, sf_dir).select("event_id", "ad_id")
    return join_static(stream, ADS.frame(spark, sf_dir), "ad_id").select("event_id", "ad_id", "campaign_id")


def side(prefix: str, kind: str) -> View:
    """The events of one type with their own column names."""
    columns = {f"{prefix}_{name}": expr for name, expr in EVENTS.columns.items() if name != "event_type"}
    return View(f"(SELECT * FROM events WHERE event_type = '{kind}')", columns)


def _frame(spark: SparkSession, sf_dir: str, prefix: str, kind: str) -> DataFrame:
    kept = EVENTS.frame(spark, sf_dir).filter(F.col("event_type") == kind)
    return kept.select(*(F.col(c).alias(f"{prefix}_{c}") for c in kept.columns if c != "event_type"))


_PAIR = "l_event_id, r_event_id"
_NEAR = (
    f"SELECT * FROM {side('l', 'purchase').sql} l JOIN {side('r', 'view').sql} r "
    "ON r_ts >= l_ts - INTERVAL 40 MINUTE AND r_ts <= l_ts + INTERVAL 20 MINUTE"
)


@query("join_theta_time", f"SELECT {_PAIR} FROM ({_NEAR}) WHERE l_value < r_value")
def join_theta_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _frame(spark, sf_dir, "l", "purchase"), _frame(spark, sf_dir, "r", "view")
    cheaper = F.col("l_value") < F.col("r_value")
    pairs = theta_join_time(left, right, cheaper, 2400 * MICROS, 1200 * MICROS, "l_ts", "r_ts")
    return pairs.select("l_event_id", "r_event_id")


_COARSE = f"SELECT date_trunc('hour', ts) AS ts, CAST(floor(value / 10) AS BIGINT) AS level FROM {EVENTS.sql} WHERE event_type"


@query(
    "join_theta_copies",
    f"SELECT l.ts AS hour, count(*) AS pairs FROM ({_COARSE} = 'purchase') l JOIN ({_COARSE} = 'view') r ON r.ts >= l.ts - "
    "INTERVAL 4 HOUR AND r.ts <= l.ts + INTERVAL 2 HOUR AND l.level <= r.level GROUP BY 1",
)
def join_theta_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an id, many of them equal: copies meet folded, bins of more than 16 different rows are grids of cells."""

    def coarse(prefix: str, kind: str) -> DataFrame:
        kept = EVENTS.frame(spark, sf_dir).filter(F.col("event_type") == kind)
        level = F.floor(F.col("value") / 10).cast("long")
        return kept.select(F.date_trunc("hour", "ts").alias(f"{prefix}_ts"), level.alias(f"{prefix}_level"))

    reach = (4 * 3600 * MICROS, 2 * 3600 * MICROS)
    fits = F.col("l_level") <= F.col("r_level")
    pairs = theta_join_time(coarse("l", "purchase"), coarse("r", "view"), fits, *reach, "l_ts", "r_ts", hot_rows=16, copies="n")
    return pairs.groupBy(F.col("l_ts").alias("hour")).agg(F.sum("n").alias("pairs"))


@query(
    "join_selectivity",
    "SELECT probed, matched, 100.0::DOUBLE * matched / probed AS percent FROM (SELECT count(*) AS probed, "
    f"count(*) FILTER (l_value < r_value) AS matched FROM ({_NEAR}))",
)
def join_selectivity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _frame(spark, sf_dir, "l", "purchase"), _frame(spark, sf_dir, "r", "view")
    cheaper = F.col("l_value") < F.col("r_value")
    return join_selectivity(left, right, cheaper, 2400 * MICROS, 1200 * MICROS, "l_ts", "r_ts")


def row_join_sql(left: str, right: str, left_rows: int, right_rows: int, condition: str) -> str:
    upto = "OVER (ORDER BY ts, event_id)"
    both = (
        f"SELECT *, count(*) FILTER (event_type = '{left}') {upto} AS lefts, count(*) FILTER (event_type = '{right}') "
        f"{upto} AS rights FROM (SELECT * FROM {EVENTS.sql} WHERE event_type IN ('{left}', '{right}'))"
    )
    return (
        f"WITH b AS ({both}) SELECT l.event_id AS l_event_id, r.event_id AS r_event_id FROM b l, b r WHERE "
        f"l.event_type = '{left}' AND r.event_type = '{right}' AND {condition} AND ((r.rights <= l.rights AND r.rights "
        f"> l.rights - {right_rows}) OR (l.lefts <= r.lefts AND l.lefts > r.lefts - {left_rows}))"
    )


ARRIVAL = [("l_ts", "r_ts"), ("l_event_id", "r_event_id")]


@query("join_theta_rows", row_join_sql("purchase", "click", 6, 9, "l.value > r.value"))
def join_theta_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _frame(spark, sf_dir, "l", "purchase"), _frame(spark, sf_dir, "r", "click")
    dearer = F.col("l_value") > F.col("r_value")
    return theta_join_rows(left, right, dearer, 6, 9, ARRIVAL).select("l_event_id", "r_event_id")


@query("join_equi_rows", row_join_sql("view", "click", 1024, 1024, "l.user_id = r.user_id"))
def join_equi_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _frame(spark, sf_dir, "l", "view"), _frame(spark, sf_dir, "r", "click")
    same = [("l_user_id", "r_user_id")]
    return theta_join_rows(left, right, F.lit(True), 1024, 1024, ARRIVAL, on=same).select("l_event_id", "r_event_id")


# aggregates


def _hourly(spark: SparkSession, sf_dir: str, *aggs: agg.Agg) -> DataFrame:
    return window_aggregate(EVENTS.frame(spark, sf_dir), HOUR, TYPE, aggs)


@query("agg_sum", sql.tumbling(EVENTS.sql, 60, TYPE, sql.total("value", "total")))
def agg_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hourly(spark, sf_dir, agg.sum_of("value", "total"))


@query("agg_count", sql.tumbling(EVENTS.sql, 60, TYPE, "count(*) AS n"))
def agg_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hourly(spark, sf_dir, agg.count())


@query(
    "agg_min_max",
    sql.tumbling(EVENTS.sql, 60, TYPE, "-max(value)::DOUBLE AS low, -min(value)::DOUBLE AS high"),
)
def agg_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of negative values, so that a maximum below zero shows."""
    negative = -F.col("value")
    return _hourly(spark, sf_dir, agg.min_of(negative, "low"), agg.max_of(negative, "high"))


@query("agg_avg", sql.tumbling(EVENTS.sql, 60, TYPE, sql.average("value", "average")))
def agg_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hourly(spark, sf_dir, agg.avg_of("value", "average"))


@query(
    "agg_weighted_avg",
    sql.tumbling(
        EVENTS.sql, 60, TYPE, "CAST(sum(value * (user_id + 1)) AS DOUBLE) / CAST(sum(user_id + 1) AS DOUBLE) AS average"
    ),
)
def agg_weighted_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hourly(spark, sf_dir, agg.weighted_avg_of("value", F.col("user_id") + 1, "average"))


@query(
    "agg_two_phase",
    sql.tumbling(
        EVENTS.sql, sql.DAY, TYPE, "count(*) AS n, max(value)::DOUBLE AS high, " + sql.average("value", "average")
    ),
)
def agg_two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial results per hour, merged per day."""
    aggs = [agg.count(), agg.max_of("value", "high"), agg.avg_of("value", "average")]
    hours = pane_aggregate(EVENTS.frame(spark, sf_dir), time_slot("ts", 3600 * MICROS), TYPE, aggs, "hour")
    start = F.timestamp_micros(int_div("hour", 24) * 86_400 * MICROS)
    merges = [p.merge() for a in aggs for p in a.partials()]
    days = hours.groupBy(start.alias("window_start"), *TYPE).agg(*merges)
    end = F.col("window_start") + F.expr("INTERVAL 1 DAY")
    return days.select("window_start", end.alias("window_end"), *TYPE, *(a.finish() for a in aggs))


# windows


@query("win_tumbling_time", sql.tumbling(EVENTS.sql, 45, [], "count(*) AS n, max(value)::DOUBLE AS high"))
def win_tumbling_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = WindowSpec.tumbling(minutes(45))
    return window_aggregate(EVENTS.frame(spark, sf_dir), spec, [], [agg.count(), agg.max_of("value", "high")])


@query("win_sliding_time", sql.sliding(EVENTS.sql, 60, 10, TYPE, sql.total("value", "total")))
def win_sliding_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = WindowSpec.sliding(minutes(60), minutes(10))
    return window_aggregate(EVENTS.frame(spark, sf_dir), spec, TYPE, [agg.sum_of("value", "total")])


_NUMBERED = f"(SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS rows FROM {EVENTS.sql})"


@query(
    "win_tumbling_rows",
    "SELECT i // 100 AS window_index, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total, min(ts) AS first_ts FROM "
    f"{_NUMBERED} WHERE (i // 100 + 1) * 100 <= rows GROUP BY 1",
)
def win_tumbling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = [agg.count(), agg.sum_of("value", "total"), agg.min_of("ts", "first_ts")]
    return row_window_aggregate(EVENTS.frame(spark, sf_dir), WindowSpec.rows(100), ["ts", "event_id"], [], aggs)


@query(
    "win_sliding_rows",
    "SELECT k AS window_index, event_type, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total FROM (SELECT *, "
    f"unnest(generate_series(greatest((i - 1024 + 32) // 32, 0), i // 32)) AS k FROM {_NUMBERED}) "
    "WHERE k * 32 <= i AND i < k * 32 + 1024 AND k * 32 + 1024 <= rows AND user_id < 100 GROUP BY 1, 2",
)
def win_sliding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1024 rows every 32 rows; the filter acts after the rows were numbered."""
    aggs = [agg.count(), agg.sum_of("value", "total")]
    kept = F.col("user_id") < 100
    spec = WindowSpec.rows(1024, 32)
    return row_window_aggregate(EVENTS.frame(spark, sf_dir), spec, ["ts", "event_id"], TYPE, aggs, where=kept)


@query(
    "win_session",
    "SELECT min(ts) AS window_start, max(ts) + INTERVAL 4 HOUR AS window_end, user_id, count(*) AS n, "
    "CAST(sum(value) AS DOUBLE) AS total FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) "
    "AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 4 HOUR "
    f"THEN 0 ELSE 1 END AS opens FROM {EVENTS.sql})) GROUP BY user_id, s",
)
def win_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = WindowSpec.session(minutes(240))
    aggs = [agg.count(), agg.sum_of("value", "total")]
    return window_aggregate(EVENTS.frame(spark, sf_dir), spec, ["user_id"], aggs)


@query(
    "win_panes",
    sql.sliding(EVENTS.sql, 1280, 10, TYPE, "min(value)::DOUBLE AS low, max(value)::DOUBLE AS high, count(*) AS n"),
)
def win_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """128/1 of aggregates that cannot be subtracted."""
    aggs = [agg.min_of("value", "low"), agg.max_of("value", "high"), agg.count()]
    spec = WindowSpec.sliding(minutes(1280), minutes(10))
    return window_aggregate(EVENTS.frame(spark, sf_dir), spec, TYPE, aggs)


_SHARED = {"short": (30, 30), "hour": (60, 20), "long": (480, 60)}


@query(
    "win_multi_shared",
    " UNION ALL ".join(
        f"SELECT '{name}' AS window_id, * FROM ("
        + sql.sliding(EVENTS.sql, size, slide, TYPE, "count(*) AS n, " + sql.total("value", "total"))
        + ")"
        for name, (size, slide) in _SHARED.items()
    ),
)
def win_multi_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = {name: WindowSpec.sliding(minutes(size), minutes(slide)) for name, (size, slide) in _SHARED.items()}
    return shared_windows(EVENTS.frame(spark, sf_dir), specs, TYPE, [agg.count(), agg.sum_of("value", "total")])


_OWN = {
    "quarter": (15, 15, "max(value)::DOUBLE AS high, count(*) AS n", ("high", "n")),
    "short": (30, 30, "max(value)::DOUBLE AS high, " + sql.total("value", "total"), ("high", "total")),
    "hour": (60, 20, "min(value)::DOUBLE AS low", ("low",)),
    "long": (480, 60, "max(value)::DOUBLE AS high, " + sql.average("value", "mean"), ("high", "mean")),
    "shift": (720, 360, "count(*) AS n, " + sql.total("value", "total"), ("n", "total")),
    "day": (sql.DAY, sql.DAY, "min(value)::DOUBLE AS low, max(value)::DOUBLE AS high, count(*) AS n", ("low", "high", "n")),
    "week": (7 * sql.DAY, sql.DAY, "max(value)::DOUBLE AS high, " + sql.average("value", "mean"), ("high", "mean")),
}
_OWN_TYPES = {"n": "BIGINT", "high": "DOUBLE", "total": "DOUBLE", "low": "DOUBLE", "mean": "DOUBLE"}


@query(
    "win_multi_own_aggs",
    " UNION ALL ".join(
        f"SELECT '{name}' AS window_id, window_start, window_end, event_type, "
        + ", ".join(c if c in asked else f"CAST(NULL AS {t}) AS {c}" for c, t in _OWN_TYPES.items())
        + f" FROM ({sql.sliding(EVENTS.sql, size, slide, TYPE, aggs)})"
        for name, (size, slide, aggs, asked) in _OWN.items()
    ),
)
def win_multi_own_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven windows, each with its own aggregates; longer ones are answered from shorter ones."""
    every = {
        "n": agg.count(), "high": agg.max_of("value", "high"), "total": agg.sum_of("value", "total"),
        "low": agg.min_of("value", "low"), "mean": agg.avg_of("value", "mean"),
    }
    windows = {
        name: (WindowSpec.sliding(minutes(size), minutes(slide)), [every[c] for c in asked])
        for name, (size, slide, _, asked) in _OWN.items()
    }
    return shared_windows(EVENTS.frame(spark, sf_dir), windows, TYPE)


@query("win_long_max", sql.sliding(EVENTS.sql, 3600, 1, ["user_id % 3 AS part"], "max(value)::DOUBLE AS high", "user_id < 150").replace("GROUP BY k, user_id % 3 AS part", "GROUP BY k, part"))
def win_long_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3600/1 of an aggregate that cannot be subtracted: every window is a suffix of a block and a prefix of the next."""
    events = EVENTS.frame(spark, sf_dir).filter("user_id < 150").withColumn("part", F.col("user_id") % 3)
    spec = WindowSpec.sliding(minutes(3600), minutes(1))
    return window_aggregate(events, spec, ["part"], [agg.max_of("value", "high")])


@query(
    "win_fill_gaps",
    "SELECT make_timestamp(k * 60000000) AS window_start, make_timestamp((k + 1) * 60000000) AS window_end, "
    "count(ts) AS n FROM (SELECT unnest(generate_series(min(epoch_us(ts)) // 60000000, max(epoch_us(ts)) // 60000000)) "
    f"AS k FROM {EVENTS.sql}) LEFT JOIN {EVENTS.sql} ON epoch_us(ts) // 60000000 = k GROUP BY k",
)
def win_fill_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = WindowSpec.tumbling(minutes(1))
    return fill_gaps(window_aggregate(EVENTS.frame(spark, sf_dir), spec, [], [agg.count()]), spec)


@query(
    "win_complete_only",
    f"SELECT * FROM ({sql.tumbling(EVENTS.sql, sql.DAY, TYPE, 'count(*) AS n')}) WHERE window_end <= "
    f"(SELECT max(ts) FROM {EVENTS.sql})",
)
def win_complete_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = WindowSpec.tumbling(minutes(sql.DAY))
    return window_aggregate(EVENTS.frame(spark, sf_dir), spec, TYPE, [agg.count()], complete_only=True)


@query("win_processing_time", f"SELECT event_type, count(*) AS n, 3600 AS seconds FROM {EVENTS.sql} GROUP BY event_type")
def win_processing_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by arrival: a table arrives at one instant, so its rows share a window; when that starts is left out."""
    windows = window_aggregate(arrival_time(EVENTS.frame(spark, sf_dir)), HOUR, TYPE, [agg.count()])
    seconds = (F.unix_seconds("window_end") - F.unix_seconds("window_start")).cast("int")
    return windows.select("event_type", "n", seconds.alias("seconds"))


# random micro data is stood in for by the events: attributes 1 and 2 are user and event id


@query(
    "micro_random_sum",
    "SELECT i // 1000 AS window_index, CAST(sum(user_id) AS BIGINT) AS total FROM "
    f"{_NUMBERED} WHERE (i // 1000 + 1) * 1000 <= rows GROUP BY 1",
)
def micro_random_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = WindowSpec.rows(1000)
    aggs = [agg.sum_of("user_id", "total")]
    return row_window_aggregate(EVENTS.frame(spark, sf_dir), spec, ["ts", "event_id"], [], aggs)


@query("micro_select", f"SELECT ts, user_id, event_id FROM {EVENTS.sql} WHERE user_id = 3")
def micro_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EVENTS.frame(spark, sf_dir).select("ts", "user_id", "event_id").filter("user_id = 3")


@query("micro_project", f"SELECT ts, user_id FROM {EVENTS.sql}")
def micro_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_at(EVENTS.frame(spark, sf_dir).select("ts", "user_id", "event_id"), [0, 1])


# user code


@query("udf_scalar", f"SELECT event_id, CAST(value AS DOUBLE) * 0.5 + user_id AS score FROM {EVENTS.sql}")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = udf.scalar(lambda value, user: value * 0.5 + user, "double")
    events = EVENTS.frame(spark, sf_dir)
    return events.select("event_id", score(F.col("value").cast("double"), "user_id").alias("score"))


@query(
    "udtf_flatmap",
    f"SELECT event_id, unnest(generate_series(1, user_id % 3)) AS part FROM {EVENTS.sql}",
)
def udtf_flatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event becomes none, one or two rows."""

    def spread(rows: pd.DataFrame) -> pd.DataFrame:
        times = rows["user_id"] % 3
        out = rows.loc[rows.index.repeat(times), ["event_id"]]
        return out.assign(part=out.groupby("event_id").cumcount() + 1)

    return udf.flat_map(EVENTS.frame(spark, sf_dir).select("event_id", "user_id"), spread, "event_id long, part long")


@query(
    "udtf_partitioned",
    "SELECT user_id, any_value(event_type) AS event_type, min(ts) AS began, count(*) AS length FROM (SELECT *, sum(opens) OVER "
    "(PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY "
    f"user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS opens FROM {EVENTS.sql})) GROUP BY user_id, run",
)
def udtf_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events of one type of every user."""
    events = EVENTS.frame(spark, sf_dir).select("user_id", "event_type", "ts", "event_id")
    return table_functions.run_lengths(events, ["user_id"], "event_type", "ts", ["ts", "event_id"])


@query(
    "udaf_merge",
    "SELECT event_type, count(*) AS n, CAST(sum(user_id) AS DOUBLE) / count(*) AS mean, max(user_id) - min(user_id) "
    f"AS spread FROM {EVENTS.sql} GROUP BY event_type",
)
def udaf_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    def update(acc: tuple, rows: pd.DataFrame) -> tuple:
        user = rows["user_id"]
        return merge(acc, (len(user), int(user.sum()), int(user.min()), int(user.max())))

    def merge(a: tuple, b: tuple) -> tuple:
        if a[0] == 0 or b[0] == 0:
            return b if a[0] == 0 else a
        return (a[0] + b[0], a[1] + b[1], min(a[2], b[2]), max(a[3], b[3]))

    spec = udf.Aggregate(
        create=lambda: (0, 0, 0, 0),
        update=update,
        merge=merge,
        finish=lambda a: (a[0], a[1] / a[0], a[3] - a[2]),
        schema="n long, mean double, spread long",
    )
    return udf.aggregate(EVENTS.frame(spark, sf_dir).select("event_type", "user_id"), ["event_type"], spec)
