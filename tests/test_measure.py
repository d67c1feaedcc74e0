import pytest
from conftest import seconds

from millrace.operators.measure import latency, log_rates, profile_columns, throughput


def line(worker, rate, query):
    return (
        f"12:00 INFO Worker: {worker} During the last 5 ms, we received 9 elements. That's {rate} elements/second/core. "
        f"1 MB/sec/core. GB received 0. Query {query}",
    )


def test_log_rates(spark):
    lines = [line(0, 10.0, 1), line(0, 20.0, 2), line(3, 5.5, 1), ("Worker: 9 started",), ("",), ("That's all",)]
    df = spark.createDataFrame(lines, "value STRING")
    assert sorted(map(tuple, log_rates(df).collect())) == [("0", 15.0, 2, 20.5), ("3", 5.5, 1, 20.5)]
    assert sorted(map(tuple, log_rates(df, by_query=True).collect())) == [
        ("0", "1", 10.0, 1, 35.5),
        ("0", "2", 20.0, 1, 35.5),
        ("3", "1", 5.5, 1, 35.5),
    ]


def test_profile_of_sixteen_rows(spark):
    df = spark.createDataFrame([(i, i // 6, 10 * i, i * 0.001) for i in range(16)], "i LONG, a LONG, b INT, c DOUBLE")
    for chunk_rows in (100, 4):
        got = {r.column_name: r for r in profile_columns(df, ["a", "b", "c"], ["i"], chunk_rows).collect()}
        assert [got[c].use_rle for c in "abc"] == [True, False, False]
        assert (got["a"].value_bits, got["b"].value_bits, got["c"].value_bits) == (2, 8, None)
        assert (got["a"].range_bits, got["b"].range_bits) == (2, 8)
        assert got["a"].mean_run == pytest.approx(16 / 3)


def percentile(values, p):
    values, position = sorted(values), p * (len(values) + 1) / 100
    if position < 1 or position >= len(values):
        return values[0] if position < 1 else values[-1]
    low = int(position)
    return values[low - 1] + (position - low) * (values[low] - values[low - 1])


@pytest.mark.parametrize("values", [[7.0], [3.0, 1.0], [float(i * i % 23) for i in range(57)], [2.0] * 9 + [5.0]])
def test_latency_percentiles(spark, values):
    row = latency(spark.createDataFrame([(v,) for v in values], "v DOUBLE"), "v").first()
    assert (row.n, row.low, row.high) == (len(values), min(values), max(values))
    assert row.mean == pytest.approx(sum(values) / len(values))
    for p in (5, 25, 50, 75, 99):
        assert row[f"p{p}"] == pytest.approx(percentile(values, p))


def test_throughput_starts_with_the_second_run(at):
    rows = [(i, i, i % 2) for i in range(20)] + [(19, 50 + i, 7) for i in range(8)]
    got = throughput(at(rows, "ts LONG, id LONG, worker LONG"), 4, "worker", ["ts", "id"])
    # worker 7 sends everything at once: its run takes no time and has no rate
    assert seconds(got) == [(0, 2, 8000, 0.5), (1, 2, 8000, 0.5), (7, 2, 0, None)]


def test_small_large_and_malformed_measurements_keep_their_digits(spark):
    from millrace.operators import measure

    small = measure.latency(spark.createDataFrame([(0.00001,), (0.00003,)], "v double"), "v").first()
    assert abs(small["mean"] - 0.00002) < 1e-15
    assert measure.latency(spark.createDataFrame([(2e14,), (4e14,)], "v double"), "v").first()["mean"] == 3e14
    line = "INFO Worker: 1 During the last 1000 ms, we received 5 elements. That's {} elements/second/core. Query 2"
    lines = spark.createDataFrame([(line.format(r),) for r in ("1000.00006", "1.2.3")], "value string")
    row = measure.log_rates(lines).first()
    assert row.mean_rate == 1000.00006 and row.entries == 1
    assert measure.malformed_rates(lines).count() == 1
