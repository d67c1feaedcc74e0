"""Streams against the same operators on tables, over several micro-batches."""

import pytest
from conftest import seconds
from pyspark.sql import Observation
from pyspark.sql import functions as F

from millrace.functions.aggregates import count, max_of, sum_of
from millrace.functions.udf import Aggregate
from millrace.operators.ranking import top_with_ties
from millrace.operators.joins import theta_join_rows
from millrace.operators.road import accidents, stopped_vehicles
from millrace.operators.time_windows import window_aggregate
from millrace.operators.windows import WindowSpec
from millrace.plans.views import EVENTS, TRAFFIC
from millrace.streaming.runner import (
    peek, progress_rates, read_batches, replace_batch, run_batches, run_to_table, shared_queries, start_to_table,
    stream_table,
)
from millrace.operators.time_windows import panes_of
from millrace.streaming.progress import ProgressLog, progress_log, throughput_of
from millrace.streaming.row_join import row_join_batches
from millrace.streaming.row_windows import row_window_batches
from millrace.streaming.sliding import sliding_batches
from millrace.streaming.state import accidents_stream, row_windows_stream, stopped_vehicles_stream


@pytest.fixture
def feed(spark, sf_dir, tmp_path):
    """Deliver the events in three parts by time, running a stream after each from its checkpoint."""

    def run(view, build):
        inbox, out = str(tmp_path / "in"), None
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        for low, high in ((0, 300), (300, 555), (555, 10**9)):
            part = events.filter((F.col("event_id") >= low) & (F.col("event_id") < high))
            part.coalesce(1).write.mode("append").parquet(inbox)
            stream = build(view.project(stream_table(spark, inbox)))
            out = run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        return out, view.project(events)

    return run


@pytest.mark.parametrize(
    "spec", [WindowSpec.tumbling(3600), WindowSpec.sliding(7200, 1200), WindowSpec.session(7200)]
)
def test_windows_of_a_restarted_stream(feed, spec):
    aggs = [count(), sum_of("user_id", "total"), max_of("value", "high")]
    found, table = feed(
        EVENTS, lambda s: window_aggregate(s.withWatermark("ts", "1 hour"), spec, ["event_type"], aggs)
    )
    closed = table.agg(F.date_trunc("millisecond", F.max("ts")) - F.expr("INTERVAL 1 HOUR")).scalar()
    expected = window_aggregate(table, spec, ["event_type"], aggs).filter(F.col("window_end") <= closed)
    assert found.count() > 0
    assert found.exceptAll(expected).count() == expected.exceptAll(found).count() == 0


def test_stopped_vehicles_stream(feed):
    found, table = feed(TRAFFIC, stopped_vehicles_stream)
    stops = stopped_vehicles(table.withColumn("vehicle", F.col("vehicle").cast("long")))
    columns = ["vehicle", "highway", "position", "segment", "first_ts", "stopped_at"]
    assert seconds(found.filter("kind = 'stopped'"), *columns) == seconds(stops, *columns)
    ended = stops.filter("cleared_at IS NOT NULL")
    assert seconds(found.filter("kind = 'cleared'"), *columns, "cleared_at") == seconds(ended, *columns, "cleared_at")


def test_row_windows_stream(feed):
    total = Aggregate(
        create=int,
        update=lambda acc, rows: acc + int(rows["user_id"].sum()),
        merge=lambda a, b: a + b,
        finish=lambda acc: (acc,),
        schema="total long",
    )
    found, table = feed(EVENTS, lambda s: row_windows_stream(s, ["event_type"], 7, total, ["ts", "event_id"]))
    rows = {}
    for r in table.orderBy("ts", "event_id").collect():
        rows.setdefault(r.event_type, []).append(r.user_id)
    expected = [
        (kind, i, sum(users[7 * i : 7 * i + 7])) for kind, users in rows.items() for i in range(len(users) // 7)
    ]
    assert seconds(found) == sorted(expected, key=repr)


def test_top_of_closed_windows(spark, sf_dir, tmp_path):
    spec = WindowSpec.tumbling(6 * 3600)
    stream = EVENTS.project(stream_table(spark, f"{sf_dir}/events.parquet")).withWatermark("ts", "0 seconds")
    counts = window_aggregate(stream, spec, ["user_id"], [count()])
    with pytest.raises(ValueError):
        top_with_ties(counts, "n")
    write = replace_batch(str(tmp_path / "out"), lambda w: top_with_ties(w, "n"))
    run_batches(counts, write, str(tmp_path / "cp"))
    table = EVENTS.frame(spark, sf_dir)
    top = window_aggregate(table, spec, ["user_id"], [count()], post=lambda w: top_with_ties(w, "n"))
    closed = table.agg(F.date_trunc("millisecond", F.max("ts"))).scalar()
    expected = top.filter(F.col("window_end") <= closed)
    found = read_batches(spark, str(tmp_path / "out"))
    assert found.count() > 0
    assert seconds(found, *expected.columns) == seconds(expected)


def test_many_queries_share_one_stream(spark, sf_dir, tmp_path):
    stream = EVENTS.project(stream_table(spark, f"{sf_dir}/events.parquet"))
    predicates = {"all": F.lit(True), "views": F.col("event_type") == "view", "none": F.lit(False)}
    out = run_to_table(
        shared_queries(stream, predicates, ["event_id"]), str(tmp_path / "out"), str(tmp_path / "cp")
    )
    counts = dict(map(tuple, out.groupBy("query_id").count().collect()))
    table = EVENTS.frame(spark, sf_dir)
    assert counts == {"all": table.count(), "views": table.filter("event_type = 'view'").count()}


def test_peek_counts_without_changing_rows(spark):
    seen = Observation("seen")
    assert peek(spark.range(5), seen, even=F.count(F.when(F.col("id") % 2 == 0, 1))).count() == 5
    assert seen.get == {"rows": 5, "even": 3}


def test_accidents_stream(spark, tmp_path):
    """Vehicles 1 and 2 stand together; 3 joins as 1 leaves; the table form finds the same span."""
    report = "ts LONG, report_id LONG, vehicle LONG, speed LONG, highway LONG, position LONG, segment LONG"
    stands = {1: (0, 300), 2: (60, 600), 3: (210, 500)}
    rows = [
        (t, v * 10_000 + t, v, 0 if a <= t < b else 9, 1, 100 if a <= t < b else 500 + t, 1)
        for v, (a, b) in stands.items()
        for t in range(0, 700, 30)
    ]
    table = spark.createDataFrame(rows, report).withColumn("ts", F.timestamp_seconds("ts"))
    found = None
    for low, high in ((0, 200), (200, 400), (400, 900)):
        part = table.filter((F.unix_seconds("ts") >= low) & (F.unix_seconds("ts") < high))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        reports = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
        stops = run_to_table(stopped_vehicles_stream(reports), str(tmp_path / "stops"), str(tmp_path / "cp1"))
        events = spark.readStream.schema(stops.schema).parquet(str(tmp_path / "stops"))
        found = run_to_table(accidents_stream(events), str(tmp_path / "out"), str(tmp_path / "cp2"))
    spans = accidents(stopped_vehicles(table))
    started, ended = (seconds(spans.select(F.col(c).alias("at"))) for c in ("started_at", "ended_at"))
    assert len(started) == 1
    assert seconds(found.filter("kind = 'started'").select("at")) == started
    assert seconds(found.filter("kind = 'ended'").select("at")) == ended


def test_row_join_of_streams(spark, sf_dir, tmp_path):
    def sides(rows):
        parts = []
        for prefix, kind in (("l", "purchase"), ("r", "click")):
            part = rows.filter(F.col("event_type") == kind)
            parts.append(part.select(*(F.col(c).alias(f"{prefix}_{c}") for c in ("ts", "event_id", "value"))))
        return tuple(parts)

    dearer, order = F.col("l_value") > F.col("r_value"), [("l_ts", "r_ts"), ("l_event_id", "r_event_id")]
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for low, high in ((0, 300), (300, 305), (305, 10**9)):
        part = events.filter((F.col("event_id") >= low) & (F.col("event_id") < high))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        write = row_join_batches(str(tmp_path / "out"), sides, dearer, 5, 8, order)
        run_batches(EVENTS.project(stream_table(spark, str(tmp_path / "in"))), write, str(tmp_path / "cp"))
    found = read_batches(spark, str(tmp_path / "out" / "pairs"))
    expected = theta_join_rows(*sides(EVENTS.project(events)), dearer, 5, 8, order)
    assert seconds(found, "l_event_id", "r_event_id") == seconds(expected, "l_event_id", "r_event_id")


def test_rates_of_a_stream(spark, sf_dir, tmp_path):
    stream = stream_table(spark, f"{sf_dir}/events.parquet").select("event_id")
    query = start_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert query.awaitTermination(60)
    rates = progress_rates(query)
    assert sum(rows for _, rows, _ in rates) == EVENTS.frame(spark, sf_dir).count()


@pytest.mark.parametrize("exact", [True, False])
def test_long_windows_are_answered_once_and_closed(spark, tmp_path, exact):
    """Batches of panes with a quiet time, an empty batch and a batch that is handed over twice."""
    spec, path = WindowSpec.sliding(20, 2), str(tmp_path / "out")
    aggs = [count(), sum_of("v", "total")]
    rows = [(t, k, t) for t in (0, 1, 3, 8, 19, 21, 22, 40, 90, 91, 99) for k in ("a", None) if t % 3 or k]
    table = spark.createDataFrame(rows, "t LONG, k STRING, v LONG").withColumn("ts", F.timestamp_seconds("t"))
    write = sliding_batches(path, spec, ["k"], aggs, exact)
    for batch, (low, high) in enumerate(((0, 0), (0, 4), (4, 20), (20, 20), (20, 92), (92, 100))):
        part = table.filter((F.col("t") >= low) & (F.col("t") < high))
        for _ in range(1 + (batch == 4)):
            write(panes_of(part, spec, ["k"], aggs), batch)
    found = read_batches(spark, f"{path}/windows")
    expected = window_aggregate(table, spec, ["k"], aggs).filter(F.unix_seconds("window_end") <= 100)
    assert seconds(found, *expected.columns) == seconds(expected)
    assert sorted(p.name for p in (tmp_path / "out" / "panes").iterdir()) == ["batch=4", "batch=5"]


def test_row_windows_by_batch(spark, tmp_path):
    path, aggs = str(tmp_path / "out"), [count(), sum_of("v", "total"), max_of("v", "high")]
    rows = [(i, None if i % 5 == 0 else "hot" if i % 7 else "rare", i * i % 23) for i in range(200)]
    table = spark.createDataFrame(rows, "i LONG, k STRING, v LONG")
    write = row_window_batches(path, 8, ["k"], aggs, ["i"])
    for batch, (low, high) in enumerate(((0, 3), (3, 3), (3, 90), (90, 91), (91, 200))):
        for _ in range(1 + (batch == 2)):
            write(table.filter((F.col("i") >= low) & (F.col("i") < high)), batch)
    found = seconds(read_batches(spark, f"{path}/windows"), "k", "window_index", "n", "total", "high")
    expected = []
    for key in ("hot", "rare", None):
        values = [v for _, k, v in rows if k == key]
        for w in range(len(values) // 8):
            part = values[8 * w : 8 * w + 8]
            expected.append((key, w, 8, sum(part), max(part)))
    assert found == sorted(expected, key=repr)


@pytest.mark.parametrize("size,slide,every", [(12, 5, 2), (6, 2, 3), (4, 9, 1), (7, 7, 100)])
def test_sliding_row_windows_by_batch(spark, tmp_path, size, slide, every):
    """Batches without rows, a batch handed over twice, and keys that rest while panes are merged."""
    keys = ("hot", "hot", "rare", "hot", None, "hot", "hot")
    rows = [(i, "early" if i < 20 else keys[i % 7], i * 31 % 17 - 8) for i in range(230)]
    table, path = spark.createDataFrame(rows, "i LONG, k STRING, v LONG"), str(tmp_path / "out")
    aggs = [count(), sum_of("v", "total"), max_of("v", "high")]
    write = row_window_batches(path, size, ["k"], aggs, ["i"], slide=slide, compact_every=every)
    for batch, (low, high) in enumerate(((0, 25), (25, 25), (25, 90), (90, 91), (91, 140), (140, 230))):
        for _ in range(1 + (batch in (2, 4))):
            write(table.filter((F.col("i") >= low) & (F.col("i") < high)), batch)
    found = seconds(read_batches(spark, f"{path}/windows"), "k", "window_index", "n", "total", "high")
    expected = []
    for key in ("early", "hot", "rare", None):
        values = [v for _, k, v in rows if k == key]
        for w in range(0, max(len(values) - size, -1) // slide + 1):
            part = values[w * slide : w * slide + size]
            expected.append((key, w, size, sum(part), max(part)))
    assert found == sorted(expected, key=repr)


def test_idle_keys_of_row_windows_are_not_written_again(spark, tmp_path):
    path = str(tmp_path / "out")
    write = row_window_batches(path, 4, ["k"], [count()], ["i"], compact_every=3)
    for batch in range(7):
        keys = range(50) if batch == 0 else [7]
        write(spark.createDataFrame([(batch * 100 + k, k) for k in keys], "i LONG, k LONG"), batch)
    assert sorted(p.name for p in (tmp_path / "out" / "open").iterdir()) == ["epoch=1", "epoch=2"]
    assert spark.read.parquet(f"{path}/open/epoch=1/batch=4").select("k").collect() == [(7,)]
    base = spark.read.parquet(f"{path}/open/epoch=2/base")
    assert base.filter("k <> 7").count() == 49 and base.groupBy("k").agg(F.sum("_filled").alias("n")).filter("k = 7").first().n == 6


def test_state_goes_when_vehicles_move_on(spark, tmp_path):
    report = "ts LONG, report_id LONG, vehicle LONG, speed LONG, highway LONG, position LONG, segment LONG"
    inbox, kept = str(tmp_path / "in"), []
    for start, speed in ((0, 0), (1000, 9)):
        rows = [(start + 30 * i, start + i * 10 + v, v, speed, 1, 100 if speed == 0 else 500 + i, 1) for i in range(5) for v in range(9)]
        part = spark.createDataFrame(rows, report).withColumn("ts", F.timestamp_seconds("ts"))
        part.coalesce(1).write.mode("append").parquet(inbox)
        stream = stopped_vehicles_stream(spark.readStream.schema(part.schema).parquet(inbox))
        query = start_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination(60)
        kept.append(query.lastProgress.stateOperators[0].numRowsTotal)
    assert kept == [9, 0]


def test_stops_of_late_reports_equal_the_table(spark, tmp_path):
    """Reports in any order within the delay, over four runs: the stops of the table, and nothing but the last reports in state."""
    import random

    from millrace.operators.road import stopped_vehicles
    from millrace.streaming.late import late_stopped_vehicles_stream
    from millrace.streaming.runner import ROCKSDB, STATE_STORE, rocksdb_state

    rng = random.Random(2)
    rows = []
    for number in range(600):
        vehicle = number % 3
        stands = (number // 60 + vehicle) % 2 == 0 and rng.random() < 0.9
        rows.append((number * 10.0 + rng.random(), number, vehicle, 0.0 if stands else 9.5, 1, number // 90 * 5, 2))
    end = max(r[0] for r in rows)
    rows += [(10_000.0, 9000 + v, v, 5.0, 1, 0, 0) for v in range(3)]  # everyone moves on, long after
    rows += [(20_000.0, 9999, 77, 5.0, 1, 0, 0)]  # the watermark passes all others
    schema = "s DOUBLE, report_id LONG, vehicle LONG, speed DOUBLE, highway LONG, position LONG, segment LONG"
    table = spark.createDataFrame(rows, schema).withColumn("ts", F.expr("timestamp_micros(CAST(s * 1000000 AS BIGINT))")).drop("s")
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("inbox", "out", "checkpoint"))
    sent = {r[1]: min(int((r[0] + rng.random() * 250) // (end / 3)), 2) if r[0] <= end else 3 for r in rows}
    for delivery in range(4):
        own = [i for i, d in sent.items() if d == delivery]
        table.filter(F.col("report_id").isin(own)).repartition(3).write.mode("append").parquet(inbox)
        before = spark.conf.get(STATE_STORE)
        with rocksdb_state(spark):
            stream = spark.readStream.schema(table.schema).parquet(inbox).withWatermark("ts", "300 seconds")
            found = run_to_table(late_stopped_vehicles_stream(stream), out, checkpoint)
        assert spark.conf.get(STATE_STORE) == before != ROCKSDB
    events = {(r.vehicle, r.kind, r.position, r.first_ts, r.stopped_at, r.cleared_at) for r in found.collect()}
    expected = set()
    for r in stopped_vehicles(table).collect():
        expected.add((r.vehicle, "stopped", r.position, r.first_ts, r.stopped_at, None))
        expected.add((r.vehicle, "cleared", r.position, r.first_ts, r.stopped_at, r.cleared_at))
    assert events == expected and len(expected) > 10
    known = spark.read.format("statestore").option("stateVarName", "known").load(checkpoint)
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(checkpoint)
    assert known.count() == 0 and [r.key.vehicle for r in waiting.select("key").distinct().collect()] == [77]


def test_predicates_by_index_equal_trying_each(spark):
    import random

    from millrace.operators.predicate_index import dyadic, indexed_queries

    rng = random.Random(1)
    for _ in range(300):
        low = rng.randrange(-200, 200)
        high = low + rng.randrange(-2, 150)
        covered = [v for level, n in dyadic(low, high) for v in range(n << level, (n + 1) << level)]
        assert sorted(covered) == list(range(low, high + 1))
    ranges = [(i, "ab"[i % 2], rng.choice([None, rng.randrange(-50, 50)]), rng.choice([None, rng.randrange(-50, 90)])) for i in range(150)]
    values = [(i, rng.choice([None, rng.randrange(-60, 100)]), rng.choice([None, rng.randrange(-60, 100), 2**62])) for i in range(120)]
    queries = spark.createDataFrame(ranges, "query_id long, column string, low long, high long")
    rows = spark.createDataFrame(values, "id long, a long, b long")
    found = sorted(tuple(r) for r in indexed_queries(rows, queries, ["a", "b"], ["id"]).collect())
    expected = sorted(
        (q, i) for q, column, low, high in ranges for i, a, b in values
        for v in [a if column == "a" else b]
        if v is not None and (low is None or low <= v) and (high is None or v <= high)
    )
    assert found == expected
    joins = indexed_queries(rows, queries, ["a", "b"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in joins and "Cartesian" not in joins
    assert indexed_queries(rows, queries.limit(0), ["a"], ["id"]).count() == 0


def test_corrections_retract_and_add(spark, at):
    from millrace.functions.aggregates import min_of
    from millrace.streaming.late_rows import corrected, corrections

    stamp = lambda s: f"timestamp_seconds({s})"
    windows = spark.sql(
        f"SELECT * FROM VALUES ({stamp(0)}, {stamp(10)}, 'a', 2L, 5L, 11L), ({stamp(0)}, {stamp(10)}, NULL, 1L, 1L, 1L), "
        f"({stamp(10)}, {stamp(20)}, 'a', 1L, 7L, 7L) AS t(window_start, window_end, k, n, low, total)"
    )
    late = spark.sql(
        f"SELECT * FROM VALUES ({stamp(0)}, {stamp(10)}, 'a', 3L), ({stamp(0)}, {stamp(10)}, 'a', 9L), ({stamp(0)}, {stamp(10)}, NULL, 4L), "
        f"({stamp(20)}, {stamp(30)}, 'b', 8L) AS t(window_start, window_end, k, v)"
    )
    aggs = [count(), min_of("v", "low"), sum_of("v", "total")]
    changes = corrections(windows, late, ["k"], aggs)
    assert sorted((r.change, r.k or "", r.n, r.low, r.total) for r in changes.collect()) == [
        ("add", "", 2, 1, 5), ("add", "a", 4, 3, 23), ("add", "b", 1, 8, 8), ("retract", "", 1, 1, 1), ("retract", "a", 2, 5, 11),
    ]
    after = corrected(windows, changes, ["k"])
    assert sorted((r.k or "", r.n, r.low, r.total) for r in after.collect()) == [("", 2, 1, 5), ("a", 1, 7, 7), ("a", 4, 3, 23), ("b", 1, 8, 8)]
    assert after.schema.simpleString() == windows.schema.simpleString()


def test_tolls_read_each_batch_of_accidents_once(spark, sf_dir, monkeypatch):
    from millrace.plans import streams

    asked, original = [], streams.new_batches

    def watched(session, path, after):
        rows, upto = original(session, path, after)
        asked.append((after, upto))
        return rows, upto

    monkeypatch.setattr(streams, "new_batches", watched)
    assert streams.stream_road_tolls(spark, sf_dir).count()
    assert len(asked) >= 3 and asked[0][0] == -1
    assert all(later[0] == earlier[1] for earlier, later in zip(asked, asked[1:], strict=False))
    assert asked[-1][1] >= 2


def test_checkpoints_can_be_read(spark, tmp_path):
    from millrace.streaming.inspect import open_windows, state_changes, state_operators

    inbox, out, checkpoint = (str(tmp_path / n) for n in ("inbox", "out", "checkpoint"))
    for batch in range(2):
        rows = spark.range(batch * 30, batch * 30 + 30).selectExpr("timestamp_seconds(id) AS ts", "id % 2 AS k")
        rows.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema("ts TIMESTAMP, k LONG").parquet(inbox).withWatermark("ts", "5 seconds")
        run_to_table(window_aggregate(stream, WindowSpec.tumbling(10), ["k"], [count()]), out, checkpoint)
    held = sorted((r.window_start.timestamp(), r.k, r["count"]) for r in open_windows(spark, checkpoint).collect())
    assert held == [(50.0, 0, 5), (50.0, 1, 5)]
    assert [r.operatorName for r in state_operators(spark, checkpoint).collect()] == ["stateStoreSave"]
    changes = state_changes(spark, checkpoint, 0, 1)
    assert {r.change_type for r in changes.select("change_type").distinct().collect()} == {"update", "delete"}


def test_progress_log_keeps_more_batches_than_the_query(spark, tmp_path):
    inbox, path = str(tmp_path / "in"), str(tmp_path / "log")
    spark.range(0, 1040, numPartitions=104).write.parquet(inbox)
    with progress_log(spark, path, held=40):
        stream = stream_table(spark, inbox, files_per_batch=1)
        query = start_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination()
    log = spark.read.parquet(path)
    assert sorted(r.batch for r in log.collect()) == list(range(104)) and len(query.recentProgress) <= 100
    total = throughput_of(log).first()
    assert (total.batches, total.rows) == (104, 1040) and total.rows_per_second > 0


def test_nothing_is_logged_of_streams_outside(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    log = ProgressLog(spark, str(tmp_path / "log"))
    log.wait(1)
    run_to_table(stream_table(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert not log.rows and not (tmp_path / "log").exists()
