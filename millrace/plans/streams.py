"""Queries that run as streams over the events and return the table they have written."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import TypeVar

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggregates import Agg, avg_of, count, max_of, min_of, quantiles_of, rank_error, sum_of
from ..functions.udf import Aggregate
from ..operators.joins import join_static, theta_join_time, window_join
from ..operators.measure import PERCENTILES
from ..operators.ranking import top_with_ties
from ..operators.time_windows import panes_of, window_aggregate
from ..operators.windows import MICROS, WindowSpec
from ..session import shared_path
from ..streaming.inspect import open_windows
from ..streaming.late import late_stopped_vehicles_stream
from ..streaming.late_rows import corrected, corrections, late_row_batches
from ..streaming.progress import progress_log
from ..streaming.row_join import row_join_batches
from ..streaming.row_windows import row_window_batches
from ..streaming.runner import (
    new_batches,
    read_batches,
    replace_batch,
    rocksdb_state,
    run_batches,
    run_to_table,
    shared_queries,
    stream_table,
)
from ..streaming.sliding import sliding_batches
from ..streaming.state import accidents_stream, row_windows_stream, stopped_vehicles_stream
from ..streaming.tolls import toll_batches
from . import sqltext as sql
from .basics import ARRIVAL, row_join_sql
from .campaign import minutes
from .registry import query
from .roads import ACCIDENTS_SQL, STOPS_SQL, TOLLS_SQL
from .views import ADS, CAMPAIGN, EVENTS, TRAFFIC, View, table, table_path

Out = TypeVar("Out")

_HOURS = WindowSpec.tumbling(minutes(60))
_KEYS = ["campaign_id"]


def _stream(spark: SparkSession, path: str, view: View = CAMPAIGN) -> DataFrame:
    return view.project(stream_table(spark, path))


def _events(spark: SparkSession, sf_dir: str, view: View = EVENTS, delay: str | None = None) -> DataFrame:
    stream = _stream(spark, table_path(sf_dir, "events"), view)
    return stream.withWatermark("ts", delay) if delay else stream


def _run(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    return run_to_table(stream, shared_path(spark, "results"), shared_path(spark, "checkpoint"))


def _closed(windows: str, delay: str, source: str = CAMPAIGN.sql) -> str:
    """The windows the final watermark has closed; a watermark counts whole milliseconds."""
    return (
        f"SELECT * FROM ({windows}) WHERE epoch_us(window_end) // 1000 <= "
        f"(SELECT max(epoch_us(ts) // 1000) FROM {source}) - epoch_us(INTERVAL {delay}) // 1000"
    )


_COUNTS = "count(*) AS n, " + sql.total("user_id", "total", "BIGINT")


@query("stream_watermark_count", _closed(sql.tumbling(CAMPAIGN.sql, 60, _KEYS, _COUNTS), "'30 minutes'"))
def stream_watermark_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _events(spark, sf_dir, CAMPAIGN, "30 minutes")
    return _run(window_aggregate(stream, _HOURS, _KEYS, [count(), sum_of("user_id", "total")]))


def _delivered(spark: SparkSession, sf_dir: str, parts: Sequence[str], run: Callable[[str], Out]) -> Out:
    """Deliver the events part by part, running the stream over the inbox after each from its checkpoint."""
    events, inbox = table(spark, sf_dir, "events"), shared_path(spark, "inbox")
    for part in parts:
        events.filter(part).write.mode("append").parquet(inbox)
        out = run(inbox)
    return out


#: Three spans of days, so that state is carried from batch to batch.
_SPANS = (
    "ts < TIMESTAMP_NTZ '2024-01-10 12:00:00'",
    "ts >= TIMESTAMP_NTZ '2024-01-10 12:00:00' AND ts < TIMESTAMP_NTZ '2024-01-20 06:30:00'",
    "ts >= TIMESTAMP_NTZ '2024-01-20 06:30:00'",
)


def _in_spans(spark: SparkSession, sf_dir: str, view: View, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table that ``build`` of the stream has appended after all spans."""
    out, checkpoint = shared_path(spark, "results"), shared_path(spark, "checkpoint")
    return _delivered(
        spark, sf_dir, _SPANS, lambda inbox: run_to_table(build(_stream(spark, inbox, view)), out, checkpoint)
    )


def _batches_in_spans(
    spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None],
    path: str,
) -> DataFrame:
    """The batches under ``path`` once ``write`` has had those of all spans."""
    checkpoint = shared_path(spark, "checkpoint")
    _delivered(spark, sf_dir, _SPANS, lambda inbox: run_batches(build(_stream(spark, inbox, EVENTS)), write, checkpoint))
    return read_batches(spark, path)


def _two_deliveries(spark: SparkSession, sf_dir: str, later: str, delay: str) -> DataFrame:
    """Run, stop, deliver the rows that meet ``later``, and run again from the checkpoint."""
    out, checkpoint = shared_path(spark, "windows"), shared_path(spark, "checkpoint")

    def run(inbox: str) -> DataFrame:
        stream = _stream(spark, inbox).withWatermark("ts", delay)
        windows = window_aggregate(stream, _HOURS, _KEYS, [count(), sum_of("user_id", "total")])
        return run_to_table(windows, out, checkpoint)

    return _delivered(spark, sf_dir, (f"NOT ({later})", later), run)


_LATE = "event_id % 10 = 0"
_MARK = f"(SELECT max(epoch_us(ts) // 1000) FROM {CAMPAIGN.sql} WHERE NOT ({_LATE})) - epoch_us(INTERVAL '5 days') // 1000"


@query(
    "stream_late_drop",
    _closed(
        sql.tumbling(
            CAMPAIGN.sql, 60, _KEYS, _COUNTS, f"(NOT ({_LATE}) OR (epoch_us(ts) // 3600000000 + 1) * 3600000 > {_MARK})"
        ),
        "'5 days'",
    ),
)
def stream_late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth event comes after all others: kept within the delay, dropped behind it."""
    return _two_deliveries(spark, sf_dir, _LATE, "5 days")


_BEHIND = f"{_LATE} AND (epoch_us(ts) // 3600000000 + 1) * 3600000 <= {_MARK}"


def _late_and_windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Late rows, and the windows that were closed without them, from two streams over the same deliveries."""
    out, first, path, second = (shared_path(spark, n) for n in ("windows", "checkpoint", "behind", "checkpoint"))
    aggs, delay = [count(), sum_of("user_id", "total")], 5 * 86_400 * MICROS
    write = late_row_batches(path, _HOURS, delay)

    def run(inbox: str) -> tuple[DataFrame, DataFrame]:
        stream = _stream(spark, inbox)
        run_batches(stream.select("event_id", "ts", "user_id", *_KEYS), write, second)
        windows = run_to_table(window_aggregate(stream.withWatermark("ts", "5 days"), _HOURS, _KEYS, aggs), out, first)
        return read_batches(spark, f"{path}/late"), windows

    return _delivered(spark, sf_dir, (f"NOT ({_LATE})", _LATE), run)


@query(
    "stream_late_rows",
    "SELECT event_id, make_timestamp(epoch_us(ts) // 3600000000 * 3600000000) AS window_start, "
    f"make_timestamp((epoch_us(ts) // 3600000000 + 1) * 3600000000) AS window_end, ({_MARK}) * 1000 - epoch_us(ts) AS behind "
    f"FROM {CAMPAIGN.sql} WHERE {_BEHIND}",
)
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a watermark of five days leaves out, with their closed window and how far they are behind."""
    late, _ = _late_and_windows(spark, sf_dir)
    return late.select("event_id", "window_start", "window_end", "behind")


@query("stream_late_corrected", _closed(sql.tumbling(CAMPAIGN.sql, 60, _KEYS, _COUNTS), "'5 days'"))
def stream_late_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed windows after the corrections by late rows: those of the whole table."""
    late, windows = _late_and_windows(spark, sf_dir)
    changes = corrections(windows, late, _KEYS, [count(), sum_of("user_id", "total")])
    return corrected(windows, changes, _KEYS)


@query(
    "stream_state_rows",
    f"SELECT * FROM ({sql.tumbling(CAMPAIGN.sql, 60, _KEYS, _COUNTS)}) WHERE epoch_us(window_end) // 1000 > "
    f"(SELECT max(epoch_us(ts) // 1000) FROM {CAMPAIGN.sql}) - epoch_us(INTERVAL '2 days') // 1000",
)
def stream_state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows that a stopped stream still holds open, read from its checkpoint."""
    checkpoint = shared_path(spark, "checkpoint")
    windows = window_aggregate(_events(spark, sf_dir, CAMPAIGN, "2 days"), _HOURS, _KEYS, [count(), sum_of("user_id", "total")])
    run_to_table(windows, shared_path(spark, "results"), checkpoint)
    held = open_windows(spark, checkpoint)
    return held.select("window_start", "window_end", *_KEYS, F.col("count").alias("n"), F.col("sum").alias("total"))


@query("stream_restart", _closed(sql.tumbling(CAMPAIGN.sql, 60, _KEYS, _COUNTS), "'2 hours'"))
def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stopped half way and started again, the result is that of one run."""
    return _two_deliveries(spark, sf_dir, "ts >= TIMESTAMP_NTZ '2024-01-15 00:00:00'", "2 hours")


@query("sink_foreach_batch", f"SELECT event_id, user_id, event_type FROM {CAMPAIGN.sql}")
def sink_foreach_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "batches")
    stream = _events(spark, sf_dir).select("event_id", "user_id", "event_type")
    run_batches(stream, replace_batch(path), shared_path(spark, "checkpoint"))
    return read_batches(spark, path)


_SLIDING = WindowSpec.sliding(minutes(60), minutes(10))


@query(
    "stream_sliding_panes",
    _closed(sql.sliding(CAMPAIGN.sql, 60, 10, ["event_code"], _COUNTS), "'10 minutes'"),
)
def stream_sliding_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of a stream from its panes: two chained aggregates."""
    stream = _events(spark, sf_dir, CAMPAIGN, "10 minutes")
    return _run(window_aggregate(stream, _SLIDING, ["event_code"], [count(), sum_of("user_id", "total")]))


def _answered(windows: str, pane: int, delay: str) -> str:
    """The windows that end no later than the last pane (in minutes) with rows that the final watermark has closed."""
    width = pane * sql.MINUTE
    end = f"(epoch_us(ts) // {width} + 1) * {width}"
    mark = f"(SELECT max(epoch_us(ts) // 1000) FROM {EVENTS.sql}) - epoch_us(INTERVAL {delay}) // 1000"
    return (
        f"SELECT * FROM ({windows}) WHERE epoch_us(window_end) <= (SELECT max({end}) FROM {EVENTS.sql} "
        f"WHERE {end} // 1000 <= {mark})"
    )


def _sliding(spark: SparkSession, sf_dir: str, spec: WindowSpec, keys: list[str], aggs: list[Agg], exact: bool) -> DataFrame:
    path = shared_path(spark, "sliding")
    write = sliding_batches(path, spec, keys, aggs, exact)
    panes = lambda stream: panes_of(stream.withWatermark("ts", "10 minutes"), spec, keys, aggs)
    return _batches_in_spans(spark, sf_dir, panes, write, f"{path}/windows")


@query(
    "stream_long_windows",
    _answered(sql.sliding(EVENTS.sql, 3600, 1, [], sql.average("value", "load")), 1, "'10 minutes'"),
)
def stream_long_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3600/1: windows are answered as they close, from the panes that open windows can reach."""
    spec = WindowSpec.sliding(minutes(3600), minutes(1))
    return _sliding(spark, sf_dir, spec, [], [avg_of("value", "load")], exact=True)


@query(
    "stream_keyed_long_windows",
    _answered(
        sql.sliding(EVENTS.sql, 3000, 10, ["event_type"], "max(value)::DOUBLE AS high, count(*) AS n"), 10, "'10 minutes'"
    ),
)
def stream_keyed_long_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300/1 per key, of an aggregate that cannot be subtracted."""
    spec = WindowSpec.sliding(minutes(3000), minutes(10))
    return _sliding(spark, sf_dir, spec, ["event_type"], [max_of("value", "high"), count()], exact=False)


_RANKS, _SKETCH = tuple(p / 100 for p in PERCENTILES), 64


@query(
    "stream_latency",
    f"SELECT w.*, p AS percentile, true AS within FROM ({{}}) w, unnest([{', '.join(map(str, PERCENTILES))}]) u(p)".format(
        _answered(
            sql.sliding(EVENTS.sql, 2880, 720, [], "count(*) AS n, min(value)::DOUBLE AS low, max(value)::DOUBLE AS high"),
            720, "'10 minutes'",
        )
    ),
)
def stream_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of a measurement as windows of a stream close, and whether their true rank is within the stated error."""
    spec = WindowSpec.sliding(minutes(2880), minutes(720))
    aggs = [count(), min_of("value", "low"), max_of("value", "high"), quantiles_of("value", "quantiles", _RANKS, _SKETCH)]
    windows = _sliding(spark, sf_dir, spec, [], aggs, exact=False)
    at = F.posexplode("quantiles").alias("i", "found")
    asked = windows.select("window_start", "window_end", "n", F.col("low").cast("double"), F.col("high").cast("double"), at)
    rows = EVENTS.frame(spark, sf_dir).select("ts", F.col("value").cast("double").alias("value"))
    sorted_in = rows.groupBy(F.window("ts", "2880 minutes", "720 minutes").alias("w"), "value").count()
    counted = asked.join(sorted_in, F.col("window_start") == F.col("w.start")).groupBy(*asked.columns).agg(
        F.coalesce(F.sum(F.when(F.col("value") < F.col("found"), F.col("count"))), F.lit(0)).alias("below"),
        F.coalesce(F.sum(F.when(F.col("value") <= F.col("found"), F.col("count"))), F.lit(0)).alias("upto"),
    )
    rank, off = F.element_at(F.array(*map(F.lit, _RANKS)), F.col("i") + 1), rank_error(_SKETCH)
    within = (F.col("below") / F.col("n") <= rank + off) & (F.col("upto") / F.col("n") >= rank - off)
    percentile = F.element_at(F.array(*map(F.lit, PERCENTILES)), F.col("i") + 1).alias("percentile")
    return counted.select("window_start", "window_end", "n", "low", "high", percentile, within.alias("within"))


_HOTTEST = sql.sliding(EVENTS.sql, 120, 30, ["user_id"], "count(*) AS n")


@query(
    "stream_hot_items",
    _closed(
        "SELECT window_start, window_end, user_id, n FROM (SELECT *, rank() OVER (PARTITION BY window_start ORDER BY n "
        f"DESC) AS r FROM ({_HOTTEST})) WHERE r = 1",
        "'30 minutes'",
    ),
)
def stream_hot_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The busiest users of each sliding window, ties included, as windows close."""
    spec = WindowSpec.sliding(minutes(120), minutes(30))
    counts = lambda stream: window_aggregate(
        stream.withWatermark("ts", "30 minutes"), spec, ["user_id"], [count()]
    )
    path = shared_path(spark, "hottest")
    return _batches_in_spans(spark, sf_dir, counts, replace_batch(path, lambda closed: top_with_ties(closed, "n")), path)


@query(
    "stream_session",
    _closed(
        "SELECT min(ts) AS window_start, max(ts) + INTERVAL 4 HOUR AS window_end, user_id, count(*) AS n FROM (SELECT *, "
        "sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER "
        "(PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS opens FROM "
        f"{EVENTS.sql})) GROUP BY user_id, s",
        "'1 hour'",
    ),
)
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _events(spark, sf_dir, delay="1 hour")
    return _run(window_aggregate(stream, WindowSpec.session(minutes(240)), ["user_id"], [count()]))


def _side(spark: SparkSession, sf_dir: str, prefix: str, kind: str) -> DataFrame:
    kept = _events(spark, sf_dir).filter(F.col("event_type") == kind)
    renamed = kept.select(*(F.col(c).alias(f"{prefix}_{c}") for c in ("event_id", "ts", "user_id", "value")))
    return renamed.withWatermark(f"{prefix}_ts", "1 hour")


@query(
    "stream_theta_join",
    f"SELECT l.event_id AS l_event_id, r.event_id AS r_event_id FROM {EVENTS.sql} l JOIN {EVENTS.sql} r ON r.ts >= l.ts - "
    "INTERVAL 40 MINUTE AND r.ts <= l.ts + INTERVAL 20 MINUTE AND l.value < r.value WHERE l.event_type = 'purchase' AND "
    "r.event_type = 'view'",
)
def stream_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _side(spark, sf_dir, "l", "purchase"), _side(spark, sf_dir, "r", "view")
    cheaper = F.col("l_value") < F.col("r_value")
    pairs = theta_join_time(left, right, cheaper, 2400 * MICROS, 1200 * MICROS, "l_ts", "r_ts")
    return _run(pairs.select("l_event_id", "r_event_id"))


@query(
    "stream_theta_grid",
    f"SELECT l.event_id AS l_event_id, r.event_id AS r_event_id FROM {EVENTS.sql} l JOIN {EVENTS.sql} r ON r.ts >= l.ts - "
    "INTERVAL 40 MINUTE AND r.ts <= l.ts + INTERVAL 20 MINUTE AND l.value < r.value WHERE l.event_type = 'click' AND "
    "r.event_type = 'view'",
)
def stream_theta_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bin of two streams is a grid of cells, so a flooded one is held by several tasks."""
    left, right = _side(spark, sf_dir, "l", "click"), _side(spark, sf_dir, "r", "view")
    cheaper = F.col("l_value") < F.col("r_value")
    pairs = theta_join_time(left, right, cheaper, 2400 * MICROS, 1200 * MICROS, "l_ts", "r_ts", grid=(3, 2))
    return _run(pairs.select("l_event_id", "r_event_id"))


@query(
    "stream_window_join",
    f"SELECT l.event_id AS l_event_id, r.event_id AS r_event_id FROM {EVENTS.sql} l JOIN {EVENTS.sql} r ON l.user_id = "
    "r.user_id AND epoch_us(l.ts) // 43200000000 = epoch_us(r.ts) // 43200000000 WHERE l.event_type = 'purchase' AND "
    "r.event_type = 'view'",
)
def stream_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _side(spark, sf_dir, "l", "purchase"), _side(spark, sf_dir, "r", "view")
    spec = WindowSpec.tumbling(minutes(12 * 60))
    return _run(window_join(left, right, spec, [("l_user_id", "r_user_id")], "l_ts", "r_ts").select("l_event_id", "r_event_id"))


@query(
    "stream_static_join",
    f"SELECT c.event_id, a.campaign_id FROM {CAMPAIGN.sql} c JOIN {ADS.sql} a ON c.ad_id = a.ad_id WHERE event_code = 0",
)
def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _events(spark, sf_dir, CAMPAIGN).filter("event_code = 0").select("event_id", "ad_id")
    return _run(join_static(stream, ADS.frame(spark, sf_dir), "ad_id").select("event_id", "campaign_id"))


@query(
    "stream_row_windows",
    "SELECT event_type, i // 100 AS window_index, sum(user_id)::BIGINT AS total, max(user_id) AS high FROM (SELECT *, "
    "row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) "
    f"AS rows FROM {EVENTS.sql}) WHERE (i // 100 + 1) * 100 <= rows GROUP BY 1, 2",
)
def stream_row_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 100 events of a type, from built-in aggregates."""
    path = shared_path(spark, "row-windows")
    aggs = [sum_of("user_id", "total"), max_of("user_id", "high")]
    write = row_window_batches(path, 100, ["event_type"], aggs, ["ts", "event_id"])
    return _batches_in_spans(spark, sf_dir, lambda stream: stream, write, f"{path}/windows")


@query(
    "stream_sliding_rows",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER "
    f"(PARTITION BY event_type) AS rows FROM {EVENTS.sql}) SELECT event_type, k AS window_index, count(*) AS n, "
    "sum(user_id)::BIGINT AS total, min(user_id) AS low FROM (SELECT *, unnest(generate_series(greatest((i - 60) // 25 + "
    "CASE WHEN i < 60 THEN 0 ELSE 1 END, 0), i // 25)) AS k FROM r) WHERE k * 25 <= i AND i < k * 25 + 60 AND k * 25 + 60 <= rows "
    "GROUP BY 1, 2",
)
def stream_sliding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 60 events of a type every 25 of them, from panes of five that batches add to."""
    path = shared_path(spark, "sliding-rows")
    aggs = [count(), sum_of("user_id", "total"), min_of("user_id", "low")]
    write = row_window_batches(path, 60, ["event_type"], aggs, ["ts", "event_id"], slide=25, compact_every=2)
    return _batches_in_spans(spark, sf_dir, lambda stream: stream, write, f"{path}/windows")


@query(
    "stream_row_windows_udaf",
    "SELECT event_type, i // 40 AS window_index, max(user_id) - min(user_id) AS spread FROM (SELECT *, row_number() OVER "
    "(PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS rows FROM "
    f"{EVENTS.sql}) WHERE (i // 40 + 1) * 40 <= rows GROUP BY 1, 2",
)
def stream_row_windows_udaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 40 events of a type, from an aggregate of the user's own."""

    def update(acc: tuple, rows: pd.DataFrame) -> tuple:
        return merge(acc, (int(rows["user_id"].min()), int(rows["user_id"].max())))

    def merge(a: tuple, b: tuple) -> tuple:
        return (min(a[0], b[0]), max(a[1], b[1])) if a and b else a or b

    agg = Aggregate(create=tuple, update=update, merge=merge, finish=lambda a: (a[1] - a[0],), schema="spread long")
    columns = ["event_type", "ts", "event_id", "user_id"]
    windows = lambda stream: row_windows_stream(
        stream.select(*columns), ["event_type"], 40, agg, ["ts", "event_id"]
    )
    return _in_spans(spark, sf_dir, EVENTS, windows)


@query(
    "stream_stopped_vehicles",
    STOPS_SQL + "SELECT 'stopped' AS kind, vehicle, highway, position, segment, first_ts, stopped_at, NULL::TIMESTAMP AS "
    "cleared_at FROM stops UNION ALL SELECT 'cleared', vehicle, highway, position, segment, first_ts, stopped_at, cleared_at "
    "FROM stops WHERE cleared_at IS NOT NULL",
)
def stream_stopped_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops as they are detected, and as the vehicles move on."""
    return _in_spans(spark, sf_dir, TRAFFIC, stopped_vehicles_stream)


@query(
    "stream_accidents",
    ACCIDENTS_SQL
    + "SELECT highway, position, 'started' AS kind, started_at AS at FROM accidents UNION ALL "
    "SELECT highway, position, 'ended', ended_at FROM accidents WHERE ended_at IS NOT NULL",
)
def stream_accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream detects stops and appends them to a table; a second one follows that table."""
    stops_path, first = shared_path(spark, "stops"), shared_path(spark, "checkpoint")
    out, second = shared_path(spark, "results"), shared_path(spark, "checkpoint")

    def run(inbox: str) -> DataFrame:
        stops = run_to_table(stopped_vehicles_stream(_stream(spark, inbox, TRAFFIC)), stops_path, first)
        follow = spark.readStream.schema(stops.schema).parquet(stops_path)
        return run_to_table(accidents_stream(follow), out, second)

    return _delivered(spark, sf_dir, _SPANS, run).select("highway", "position", "kind", "at")


#: Hours by which a report comes late, up to a day, and the delay that waits for them.
_LATENESS, _PATIENCE = "CAST(event_id * 7919 % 1440 AS INT)", "1 day"
_SHUFFLED = (
    f"ts + make_interval(0, 0, 0, 0, 0, {_LATENESS}) < TIMESTAMP_NTZ '2024-01-10 12:00:00'",
    f"ts + make_interval(0, 0, 0, 0, 0, {_LATENESS}) >= TIMESTAMP_NTZ '2024-01-10 12:00:00' AND "
    f"ts + make_interval(0, 0, 0, 0, 0, {_LATENESS}) < TIMESTAMP_NTZ '2024-01-20 06:30:00'",
    f"ts + make_interval(0, 0, 0, 0, 0, {_LATENESS}) >= TIMESTAMP_NTZ '2024-01-20 06:30:00'",
)
#: The reports that the last watermark has passed.
_PASSED = (
    f"(SELECT * FROM {TRAFFIC.sql} WHERE epoch_us(ts) <= "
    f"((SELECT max(epoch_us(ts) // 1000) FROM events) - epoch_us(INTERVAL '{_PATIENCE}') // 1000) * 1000)"
)


def _late_stops(spark: SparkSession, inbox: str, path: str, checkpoint: str) -> DataFrame:
    reports = _stream(spark, inbox, TRAFFIC).withWatermark("ts", _PATIENCE)
    with rocksdb_state(spark):
        return run_to_table(late_stopped_vehicles_stream(reports), path, checkpoint)


@query(
    "stream_stopped_vehicles_late",
    STOPS_SQL.replace(TRAFFIC.sql, _PASSED)
    + "SELECT 'stopped' AS kind, vehicle, highway, position, segment, first_ts, stopped_at, NULL::TIMESTAMP AS "
    "cleared_at FROM stops UNION ALL SELECT 'cleared', vehicle, highway, position, segment, first_ts, stopped_at, cleared_at "
    "FROM stops WHERE cleared_at IS NOT NULL",
)
def stream_stopped_vehicles_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops from reports that come up to a day late and out of order."""
    out, checkpoint = shared_path(spark, "results"), shared_path(spark, "checkpoint")
    return _delivered(spark, sf_dir, _SHUFFLED, lambda inbox: _late_stops(spark, inbox, out, checkpoint))


@query(
    "stream_accidents_late",
    ACCIDENTS_SQL.replace(TRAFFIC.sql, _PASSED)
    + "SELECT highway, position, 'started' AS kind, started_at AS at FROM accidents UNION ALL "
    "SELECT highway, position, 'ended', ended_at FROM accidents WHERE ended_at IS NOT NULL",
)
def stream_accidents_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accidents from late reports: stops leave the first stream in the order of the watermark, so a second one can follow them."""
    stops_path, first = shared_path(spark, "stops"), shared_path(spark, "checkpoint")
    out, second = shared_path(spark, "results"), shared_path(spark, "checkpoint")

    def run(inbox: str) -> DataFrame:
        stops = _late_stops(spark, inbox, stops_path, first)
        follow = spark.readStream.schema(stops.schema).parquet(stops_path)
        return run_to_table(accidents_stream(follow), out, second)

    return _delivered(spark, sf_dir, _SHUFFLED, run).select("highway", "position", "kind", "at")


@query("stream_road_tolls", _closed(TOLLS_SQL, "'10 minutes'", TRAFFIC.sql))
def stream_road_tolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of tolls as every 300 minutes close: stops, accidents and sums follow one another in three streams."""
    stops_path, events_path, path = (shared_path(spark, n) for n in ("stops", "accidents", "tolls"))
    first, second, third = (shared_path(spark, "checkpoint") for _ in range(3))
    every = WindowSpec.tumbling(minutes(300))
    write = toll_batches(path, every, lambda after: new_batches(spark, events_path, after))

    def run(inbox: str) -> DataFrame:
        stops = run_to_table(stopped_vehicles_stream(_stream(spark, inbox, TRAFFIC)), stops_path, first)
        follow = spark.readStream.schema(stops.schema).parquet(stops_path)
        run_batches(accidents_stream(follow), replace_batch(events_path), second)
        reports = _stream(spark, inbox, TRAFFIC).withWatermark("ts", "10 minutes")
        sums = [count("_rows"), sum_of("speed", "_total")]
        run_batches(window_aggregate(reports, every, ["highway", "segment"], sums), write, third)
        return read_batches(spark, f"{path}/tolls")

    return _delivered(spark, sf_dir, _SPANS, run)


_QUERIES = {"q0": "event_code = 2", "q1": "event_code = 0", "q2": "event_code >= 1"}


@query(
    "stream_multi_query",
    _closed(
        " UNION ALL ".join(
            f"SELECT '{name}' AS query_id, * FROM ({sql.tumbling(CAMPAIGN.sql, 60, _KEYS, 'count(*) AS n', test)})"
            for name, test in _QUERIES.items()
        ),
        "'30 minutes'",
    ),
)
def stream_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three windowed queries over one stream and one state, each with a sink of its own."""
    predicates = {name: F.expr(test) for name, test in _QUERIES.items()}
    path = shared_path(spark, "queries")
    rows = shared_queries(_events(spark, sf_dir, CAMPAIGN, "30 minutes"), predicates, ["ts", *_KEYS])
    windows = window_aggregate(rows, _HOURS, ["query_id", *_KEYS], [count()])
    sinks = {name: replace_batch(f"{path}/{name}") for name in predicates}

    def write(closed: DataFrame, batch: int) -> None:
        for name, sink in sinks.items():
            sink(closed.filter(F.col("query_id") == name), batch)

    run_batches(windows, write, shared_path(spark, "checkpoint"))
    parts = [read_batches(spark, f"{path}/{name}") for name in predicates]
    return reduce(DataFrame.unionByName, parts)


@query("stream_row_join", row_join_sql("purchase", "click", 6, 9, "l.value > r.value"))
def stream_row_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last rows of either side, carried from batch to batch."""

    def sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        parts = []
        for prefix, kind in (("l", "purchase"), ("r", "click")):
            kept = rows.filter(F.col("event_type") == kind)
            parts.append(kept.select(*(F.col(c).alias(f"{prefix}_{c}") for c in ("ts", "event_id", "value"))))
        return parts[0], parts[1]

    path = shared_path(spark, "row-join")
    write = row_join_batches(path, sides, F.col("l_value") > F.col("r_value"), 6, 9, ARRIVAL)
    pairs = _batches_in_spans(spark, sf_dir, lambda stream: stream, write, f"{path}/pairs")
    return pairs.select("l_event_id", "r_event_id")


_SPAN_ROWS = " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS batch, count(*) AS rows FROM {EVENTS.sql} WHERE {span.replace('TIMESTAMP_NTZ', 'TIMESTAMP')}" for i, span in enumerate(_SPANS)
)


@query("stream_throughput_log", _SPAN_ROWS)
def stream_throughput_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log that a stream has left of its batches; their rates are kept as well, and differ from run to run."""
    path = shared_path(spark, "progress")
    out, checkpoint = shared_path(spark, "results"), shared_path(spark, "checkpoint")

    def run(inbox: str) -> DataFrame:
        with progress_log(spark, path):
            run_to_table(_stream(spark, inbox, EVENTS), out, checkpoint)
        return spark.read.parquet(path)

    return _delivered(spark, sf_dir, _SPANS, run).select("batch", "rows")
