import random
import re
from datetime import timedelta

import pytest
from conftest import seconds
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions.aggregates import avg_of, count, max_of, min_of, sum_of, weighted_avg_of
from millrace.operators import order, stretches
from millrace.operators.panes import ROWS
from millrace.operators.ranking import most_frequent, top_with_ties
from millrace.operators.row_windows import row_window_aggregate
from millrace.operators.time_windows import fill_gaps, shared_windows, window_aggregate
from millrace.operators.window_lattice import covers
from millrace.operators.windows import WindowSpec
from millrace.plans.roads import road_vehicle_cascade

EVENTS = "ts LONG, k STRING, v LONG"
EXACT = [count(), sum_of("v", "total"), avg_of("v", "mean")]
OTHER = [count(), min_of("v", "low"), max_of("v", "high"), sum_of("v", "total")]


def brute(rows, size, slide):
    """Windows by definition: every row visits each window that holds its second."""
    out = {}
    for ts, key, v in rows:
        start = ts // slide * slide
        while start > ts - size:
            out.setdefault((start, key), []).append(v)
            start -= slide
    return out


def test_edges_are_half_open(at):
    df = at([(0, "a", 1), (9, "a", 2), (10, "a", 4), (35, "a", 8)], EVENTS)
    got = window_aggregate(df, WindowSpec.tumbling(10), ["k"], [count(), sum_of("v", "total")])
    assert seconds(got) == [(0.0, 10.0, "a", 2, 3), (10.0, 20.0, "a", 1, 4), (30.0, 40.0, "a", 1, 8)]


def test_gaps_are_filled_and_open_windows_dropped(at):
    df = at([(0, "a", 1), (35, "a", 2), (47, "a", 3)], EVENTS)
    spec = WindowSpec.tumbling(10)
    windows = window_aggregate(df, spec, [], [count()], complete_only=True)
    assert seconds(fill_gaps(windows, spec), "window_start", "n") == [(0.0, 1), (10.0, 0), (20.0, 0), (30.0, 1)]


def test_long_gap_crosses_chunks_per_key(at):
    df = at([(0, "a", 1), (100_000, "a", 1), (5, "b", 1)], EVENTS)
    spec = WindowSpec.tumbling(10)
    filled = fill_gaps(window_aggregate(df, spec, ["k"], [count()]), spec, ["k"])
    counted = filled.groupBy("k").agg(F.count(F.lit(1)), F.sum("n"), F.countDistinct("window_start")).collect()
    assert sorted(map(tuple, counted)) == [("a", 10_001, 2, 10_001), ("b", 1, 1, 1)]


rows = st.lists(
    st.tuples(st.integers(0, 300), st.sampled_from("ab"), st.integers(-5, 5)), min_size=1, max_size=40
)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows, size=st.integers(1, 60), slide=st.integers(1, 20))
def test_panes_equal_the_definition(at, rows, size, slide):
    expected = brute(rows, size, slide)
    df = at(rows, EVENTS)
    spec = WindowSpec.sliding(size, slide)
    exact = seconds(window_aggregate(df, spec, ["k"], EXACT), "window_start", "k", "n", "total", "mean")
    assert exact == sorted(
        ((float(s), k, len(v), sum(v), sum(v) / len(v)) for (s, k), v in expected.items()), key=repr
    )
    other = seconds(window_aggregate(df, spec, ["k"], OTHER), "window_start", "k", "n", "low", "high", "total")
    assert other == sorted(
        ((float(s), k, len(v), min(v), max(v), sum(v)) for (s, k), v in expected.items()), key=repr
    )


@pytest.mark.parametrize("size,slide", [(600, 1), (601, 7), (50, 60), (90, 60)])
@pytest.mark.parametrize("aggs", [EXACT, OTHER])
def test_long_overlaps_and_hops(at, size, slide, aggs):
    data = [(i * 37 % 5000, "ab"[i % 2], i % 11 - 5) for i in range(300)]
    got = seconds(window_aggregate(at(data, EVENTS), WindowSpec.sliding(size, slide), ["k"], aggs), "window_start", "k", "n")
    assert got == sorted(((float(s), k, len(v)) for (s, k), v in brute(data, size, slide).items()), key=repr)


def test_panes_equal_plain_windows(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    df = df.withColumn("v", F.col("value").cast("decimal(18,2)"))
    plain = (
        df.groupBy(F.window("ts", "60 minutes", "7 minutes"), "event_type")
        .agg(*(a.direct() for a in EXACT))
        .select("window.start", "window.end", "event_type", "n", "total", "mean")
    )
    spec = WindowSpec.sliding(timedelta(minutes=60), timedelta(minutes=7))
    panes = window_aggregate(df, spec, ["event_type"], EXACT)
    assert panes.exceptAll(plain).count() == plain.exceptAll(panes).count() == 0


@pytest.mark.parametrize("aggs", [EXACT, OTHER])
def test_shared_windows_equal_each_alone(at, aggs):
    data = [(i * 53 % 4000, "ab"[i % 2], i % 7) for i in range(200)]
    df = at(data, EVENTS)
    specs = {
        "flat": WindowSpec.tumbling(30),
        "hour": WindowSpec.sliding(60, 20),
        "long": WindowSpec.sliding(500, 10),
    }
    together = shared_windows(df, specs, ["k"], aggs)
    for name, spec in specs.items():
        alone = window_aggregate(df, spec, ["k"], aggs)
        part = together.filter(F.col("window_id") == name).drop("window_id")
        assert seconds(part) == seconds(alone)


@pytest.mark.parametrize("gap", [5, 7, 20])
def test_sessions_equal_built_in(at, gap):
    data = [(t, "ab"[t % 2], 1) for t in (0, 5, 10, 11, 24, 25, 31, 39, 60, 66, 73, 80, 80, 100, 107)]
    df = at(data, EVENTS)
    built_in = (
        df.groupBy(F.session_window("ts", f"{gap} seconds"), "k")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
        .select(F.col("session_window.start").alias("a"), F.col("session_window.end").alias("b"), "k", "n", "total")
    )
    own = window_aggregate(df, WindowSpec.session(gap), ["k"], [count(), sum_of("v", "total")])
    assert seconds(own) == seconds(built_in)


def test_negative_maximum_and_nulls(at):
    df = at([(0, "a", -5), (1, "a", -3), (2, "b", None)], EVENTS)
    aggs = [max_of("v", "high"), sum_of("v", "total"), avg_of("v", "mean"), count()]
    for spec in (WindowSpec.tumbling(10), WindowSpec.sliding(10, 5)):
        got = seconds(window_aggregate(df, spec, ["k"], aggs).filter("window_start = timestamp_seconds(0)"))
        assert got == [(0.0, 10.0, "a", -3, -8, -4.0, 2), (0.0, 10.0, "b", None, None, None, 1)]


def test_weighted_average(at):
    df = at([(0, "a", 1), (1, "a", 4)], EVENTS)
    got = window_aggregate(df, WindowSpec.tumbling(10), [], [weighted_avg_of("v", F.col("v"), "w")])
    assert got.first().w == 17 / 5


def test_top_keeps_ties(at):
    df = at([(0, "a", 1), (1, "b", 1), (2, "c", 1), (3, "a", 1), (4, "b", 1), (11, "c", 1)], EVENTS)
    top = window_aggregate(df, WindowSpec.tumbling(10), ["k"], [count()], post=lambda w: top_with_ties(w, "n"))
    assert seconds(top, "window_start", "k", "n") == [(0.0, "a", 2), (0.0, "b", 2), (10.0, "c", 1)]


@pytest.mark.parametrize("size, slide", [(60, 1), (100, 3), (40, 1), (10, 5)])
def test_most_frequent_keys_with_ties(at, size, slide):
    """Hot keys that come and go, a key with a gap, keys that tie, and times before 1970."""
    rows = [(t, "hot" if t < 300 else "late", 1) for t in range(-50, 700, 2) if not 380 < t < 500]
    rows += [(t, name, 1) for t in range(-40, 900, 30) for name in ("tie", "eit")] + [(5, None, 1)] * 40
    df = at(rows, EVENTS)
    spec = WindowSpec.sliding(size, slide)
    expected = window_aggregate(df, spec, ["k"], [count()], post=lambda w: top_with_ties(w, "n"))
    assert seconds(most_frequent(df, spec, ["k"])) == seconds(expected)
    counts = {at: len(values) for at, values in brute(rows, size, slide).items()}
    best = {}
    for (start, _), n in counts.items():
        best[start] = max(best.get(start, 0), n)
    found = {(r[0], r[1]): r[2] for r in seconds(expected, "window_start", "k", "n")}
    assert found == {(float(s), k): n for (s, k), n in counts.items() if n == best[s]}


def test_row_windows_number_before_the_filter(at):
    df = at([(i, "a", i) for i in range(25)], EVENTS)
    aggs = [count(), sum_of("v", "total")]
    got = row_window_aggregate(df, WindowSpec.rows(10, 5), ["ts"], [], aggs, where=F.col("v") % 2 == 0)
    assert sorted(map(tuple, got.collect())) == [(0, 5, 20), (1, 5, 50), (2, 5, 70), (3, 5, 100)]
    every = row_window_aggregate(df, WindowSpec.rows(10), ["ts"], [], aggs, complete_only=False)
    assert sorted(map(tuple, every.collect())) == [(0, 10, 45), (1, 10, 145), (2, 5, 110)]


def test_window_definitions_are_checked():
    with pytest.raises(ValueError):
        WindowSpec("time", 0, 1)
    with pytest.raises(ValueError):
        WindowSpec("tuples", 1, 1)
    spec = WindowSpec.sliding(60, 25)
    assert (spec.pane, spec.ratio, spec.is_tumbling) == (5_000_000, 3, False)


def test_very_long_gap_is_counted(spark):
    from millrace.operators.time_windows import fill_gaps
    from millrace.operators.windows import WindowSpec

    windows = spark.sql("SELECT timestamp_seconds(s) AS window_start, timestamp_seconds(s + 1) AS window_end, 1L AS n "
                        "FROM VALUES (0L), (20000000L) AS t(s)")  # fmt: skip
    filled = fill_gaps(windows, WindowSpec.tumbling(1))
    assert filled.count() == 20_000_001


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_sessions_cross_chunks(at, monkeypatch, chunk):
    monkeypatch.setattr("millrace.operators.time_windows.CHUNK_WINDOWS", chunk)
    times = [0, 4, 9, 14, 30, 40, 51, 52, 53, 200, 210, 219, 500]
    df = at([(t, k, 1) for t in times for k in ("a", None)], EVENTS)
    got = seconds(window_aggregate(df, WindowSpec.session(10), ["k"], [count()]), "window_start", "window_end", "k", "n")
    spans = [(0.0, 24.0, 4), (30.0, 50.0, 2), (51.0, 63.0, 3), (200.0, 229.0, 3), (500.0, 510.0, 1)]
    assert got == sorted([(a, b, k, n) for a, b, n in spans for k in ("a", None)], key=repr)
    whole = seconds(window_aggregate(df, WindowSpec.session(10), [], [count()]))
    assert whole == sorted([(a, b, 2 * n) for a, b, n in spans], key=repr)


OWN_AGGS = {
    "a": (WindowSpec.sliding(10, 10), [max_of("v", "high"), count()]),
    "b": (WindowSpec.sliding(30, 10), [sum_of("v", "total")]),
    "c": (WindowSpec.sliding(60, 20), [max_of("v", "high"), avg_of("v", "mean")]),
    "d": (WindowSpec.sliding(120, 60), [min_of("v", "low"), count()]),
    "e": (WindowSpec.sliding(20, 20), [avg_of("v", "mean"), count()]),
    "f": (WindowSpec.sliding(70, 30), [max_of("v", "high")]),
    "g": (WindowSpec.sliding(10, 25), [count("rows")]),
    "h": (WindowSpec.sliding(40, 40), [weighted_avg_of("v", "ts_weight", "mean"), min_of("v", "low")]),
}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows)
def test_windows_with_their_own_aggregates_equal_the_definition(at, rows):
    of = {
        "high": max, "low": min, "n": len, "rows": len, "total": sum, "mean": lambda v: sum(v) / len(v),
        "weighted": lambda v: sum(x * (x + 6) for x in v) / sum(x + 6 for x in v) if sum(x + 6 for x in v) else None,
    }
    expected = []
    for name, (spec, aggs) in OWN_AGGS.items():
        for (start, key), values in brute(rows, spec.size // 10**6, spec.slide // 10**6).items():
            kinds = {a.name: "weighted" if a.kind == "weighted_avg" else a.name for a in aggs}
            shown = {n: of[kinds[n]](values) if n in kinds else None for n in ("high", "n", "total", "mean", "low", "rows")}
            expected.append((name, float(start), key, *((None if x is None else float(x)) for x in shown.values())))
    got = shared_windows(at(rows, EVENTS).withColumn("ts_weight", F.col("v") + 6), OWN_AGGS, ["k"])
    found = [
        (r.window_id, float(r.window_start.timestamp()), r.k, *((None if r[n] is None else float(r[n])) for n in ("high", "n", "total", "mean", "low", "rows")))
        for r in got.collect()
    ]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_covers_take_the_longest_source_that_fits():
    day, hour = 86_400, 3_600
    plan = covers(
        {
            "hour": (WindowSpec.tumbling(hour), ["max", "sum"]),
            "half": (WindowSpec.sliding(day // 2, hour), ["max"]),
            "day": (WindowSpec.tumbling(day), ["max", "min"]),
            "week": (WindowSpec.sliding(7 * day, day), ["max", "sum"]),
            "odd": (WindowSpec.sliding(hour + 60, 60), ["max"]),
        },
        60_000_000,
    )
    assert plan["half"].sources == {"hour": [ROWS, "max"]} and plan["odd"].sources == {"": [ROWS, "max"]}
    assert plan["day"].sources == {"half": [ROWS, "max"], "": ["min"]}
    assert plan["week"].sources == {"day": [ROWS, "max"], "hour": ["sum"]} and plan["week"].level == 4


def test_many_windows_share_few_shuffles(spark, at):
    specs = {f"w{i}": (WindowSpec.sliding(60 * i, 60), [max_of("v", f"m{i % 3}"), sum_of("v", "s")]) for i in range(1, 13)}
    found = shared_windows(at([(5, "a", 1)], EVENTS), specs, ["k"])
    assert found.count() == sum(range(1, 13))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    shuffles = found._jdf.queryExecution().sparkPlan().toString().count("Window ") + plan.count("Aggregate ")
    assert shuffles <= 6 < len(specs) and plan.count("LogicalRDD") + plan.count("LocalRelation") <= 2


def test_long_windows_merge_two_rows_each(spark):
    """Rows that are merged into windows: two a window at most, where blocks would need the root of the overlap per pane."""
    data = spark.range(20_000).selectExpr("timestamp_seconds(id * 3) AS ts", "CAST(id % 97 AS LONG) AS v")
    result = window_aggregate(data, WindowSpec.sliding(3600, 1), [], [max_of("v", "high")])
    got = result.collect()
    assert len(got) == 3 * 19_999 + 3600
    values = {r.window_start.timestamp(): r.high for r in got}
    for start in (-3599, -1, 0, 1, 3599, 3600, 59_996, 59_997):
        inside = [i % 97 for i in range(20_000) if start <= 3 * i < start + 3600]
        assert values.get(float(start)) == (max(inside) if inside else None)
    spread = [int(n) for n in re.findall(r"Generate.*?number of output rows: ([\d,]+)", executed_metrics(result))]
    assert spread and max(spread) <= 2 * len(got)


def executed_metrics(df) -> str:
    """Output rows of the operators that list windows, after the query has run."""
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("Generate") and node.metrics().contains("numOutputRows"):
            found.append(f"Generate number of output rows: {node.metrics().apply('numOutputRows').value()}")
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return "\n".join(found)


def test_few_pieces_of_windows_are_gathered_per_key_to_find_who_can_win(at):
    """Quiet keys and a busy one; what a table of keys and blocks takes is bounded by single stretches first."""
    rows = [(t, f"q{t % 40}", 1) for t in range(0, 6000, 25)] + [(t, "busy", 1) for t in range(2000, 3000, 7)]
    got = most_frequent(at(rows, EVENTS), WindowSpec.sliding(600, 10), ["k"])
    counts = {w: len(v) for w, v in brute(rows, 600, 10).items()}
    best = {}
    for (start, _), n in counts.items():
        best[start] = max(n, best.get(start, 0))
    expected = sorted((float(s), float(s + 600), k, n) for (s, k), n in counts.items() if n == best[s])
    assert sorted(seconds(got)) == expected
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    gathered = re.search(r"Aggregate \[[^\]]*_chunk#[^\]]*_block#", plan)
    assert gathered and "_bound" in plan[gathered.end() :]  # the bounds are among what is below it


def test_row_windows_over_stretches_equal_listed_rows(spark, monkeypatch):
    """Stretches of any length, below zero and over blocks, with null keys; the last row window is unfinished."""
    rng = random.Random(3)
    rows = []
    for key in range(200):
        at = rng.randrange(-700, 0)
        for _ in range(rng.randrange(6)):
            until = at + rng.choice([0, 1, 2, 30, 600])
            rows.append((key, rng.choice(["a", "b", None]), rng.choice([1.5, None]), at, until))
            at = until + rng.randrange(3)
    df = spark.createDataFrame(rows, "key long, g string, h double, a long, u long").repartition(5)
    order_by, n = ["key", "g", "h"], [count()]
    plain = stretches.listed(df, ("a", "u"), "i")
    assert plain.count() == sum(r[4] - r[3] for r in rows)
    for size, complete, at_once in ((64, True, 1 << 21), (7, False, 500), (1 << 20, False, 1 << 21), (1 << 20, True, 500)):
        monkeypatch.setattr(stretches, "LISTED_AT_ONCE", at_once)
        got = row_window_aggregate(df, WindowSpec.rows(size), order_by, ["g", "h"], n, complete_only=complete, stretch=("a", "u"))
        want = row_window_aggregate(plain, WindowSpec.rows(size), ["i", *order_by], ["g", "h"], n, complete_only=complete)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    other = [count(), max_of("key", "high")]  # aggregates that tasks do not count take the listed rows
    got = row_window_aggregate(df, WindowSpec.rows(20, 10), order_by, ["g"], other, stretch=("a", "u"))
    want = row_window_aggregate(plain, WindowSpec.rows(20, 10), ["i", *order_by], ["g"], other)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    empty = row_window_aggregate(df.limit(0), WindowSpec.rows(7), order_by, ["g"], n, complete_only=False, stretch=("a", "u"))
    assert empty.collect() == []


def test_the_cascade_writes_no_listed_windows(spark, sf_dir, monkeypatch):
    written = []

    def counted(df, name, plain=order.stage):
        out = plain(df, name)
        written.append(out.count())
        return out

    for module in (order, stretches):
        monkeypatch.setattr(module, "stage", counted)
    road_vehicle_cascade(spark, sf_dir).collect()
    reports = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert written and max(written) <= 3 * reports  # thirty windows a report
