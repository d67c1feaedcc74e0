import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from millrace.functions import udf
from millrace.functions.aggregates import quantiles_of, rank_error
from millrace.functions.expressions import all_of, any_of, composite_key, hash_bucket, int_div, one_of, project_at
from millrace.functions.table_functions import register, run_lengths


def test_expressions(spark):
    df = spark.createDataFrame([(1, 23, -7), (12, 3, 8)], "a LONG, b LONG, c LONG")
    got = df.select(
        composite_key("a", "b"), int_div("c", 2), hash_bucket("c", 789, 321, 10), one_of("a", [12]),
        all_of(F.col("a") > 0, F.col("c") > 0), any_of(F.col("a") > 5, F.col("c") < 0),
    )
    assert [tuple(r) for r in got.collect()] == [
        ("1-23", -3, (-7 * 789 + 321) % 10, False, False, True),
        ("12-3", 4, (8 * 789 + 321) % 10, True, True, True),
    ]
    assert project_at(df, [2, 0]).columns == ["c", "a"]


def test_user_aggregate_over_many_tasks_and_a_heavy_key(spark, monkeypatch):
    monkeypatch.setattr(udf, "HELD_GROUPS", 3)
    monkeypatch.setattr(udf, "MERGE_SHARES", 2)
    df = spark.range(0, 2000, numPartitions=16).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id % 50 END AS k", "id AS v")
    longest = udf.Aggregate(
        create=list,
        update=lambda acc, rows: acc + rows["v"].tolist(),
        merge=lambda a, b: a + b,
        finish=lambda acc: (len(acc), max(acc)),
        schema="n long, high long",
    )
    got = {tuple(r) for r in udf.aggregate(df, ["k"], longest).collect()}
    assert got == {tuple(r) for r in df.groupBy("k").agg(F.count("v"), F.max("v")).collect()}


def test_scalar_and_flat_map(spark):
    double = udf.scalar(lambda v: v * 2, "long")
    assert [r[0] for r in spark.range(3).select(double("id")).collect()] == [0, 2, 4]

    def twice(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([rows, rows])

    assert udf.flat_map(spark.range(3), twice, "id long").count() == 6


def test_composite_keys_do_not_collide(spark):
    from millrace.functions.expressions import composite_key

    rows = [("a-b", "c"), ("a", "b-c"), (None, "1"), ("1", None), ("\\N", "1"), ("a\\", "b"), ("a", "\\b")]
    keys = spark.createDataFrame(rows, "a string, b string").select(composite_key("a", "b").alias("k")).collect()
    assert len({r.k for r in keys}) == len(rows)
    assert spark.createDataFrame([(1, 23)], "a int, b int").select(composite_key("a", "b")).first()[0] == "1-23"


def test_run_lengths_per_key_whatever_the_types(spark):
    rows = [("a", 1, 2.5), ("a", 2, 2.5), ("a", 3, None), ("a", 4, None), ("a", 5, 2.5), (None, 1, 1.0), ("b", 9, 1.0), (None, 2, 1.0)]
    table = spark.createDataFrame(rows, "k STRING, i INT, v DOUBLE").repartition(3)
    got = run_lengths(table, ["k"], "v", "i", ["i"])
    assert got.dtypes == [("k", "string"), ("v", "double"), ("began", "int"), ("length", "bigint")]
    expected = [("a", 2.5, 1, 2), ("a", None, 3, 2), ("a", 2.5, 5, 1), (None, 1.0, 1, 2), ("b", 1.0, 9, 1)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    assert run_lengths(table.filter("i < 0"), ["k"], "v", "i", ["i"]).count() == 0
    with pytest.raises(AnalysisException, match="no column w"):
        run_lengths(table, ["k"], "w", "i", ["i"])


def test_run_lengths_in_sql(spark):
    register(spark)
    spark.createDataFrame([(1, i, i // 3) for i in range(9)], "k INT, i INT, v INT").createOrReplaceTempView("steps")
    sql = "SELECT v, length FROM run_lengths(TABLE(steps) PARTITION BY (k) ORDER BY (i), 'k', 'v', 'i') ORDER BY began"
    assert spark.sql(sql).collect() == [(0, 3), (1, 3), (2, 3)]


def test_quantiles_of_merged_sketches(spark):
    ranks = (0.0, 0.25, 0.5, 0.99, 1.0)
    table = spark.range(20_000).selectExpr("id % 40 AS part", "CAST(id * 7919 % 20000 AS INT) AS v", "id % 2 AS k")
    odd = spark.createDataFrame([(1, None, 5), (2, float("nan"), 5), (3, 8.0, 6)], "part LONG, v DOUBLE, k LONG")
    agg = quantiles_of("v", "q", ranks, 128)
    for rows in (table, odd):
        panes = rows.groupBy("k", "part").agg(*(p.fold.alias(p.name) for p in agg.partials()))
        merged = panes.groupBy("k").agg(*(p.merge() for p in agg.partials())).select("k", agg.finish())
        found = {r.k: r.q for r in merged.collect()}
        if rows is odd:
            assert found == {5: None, 6: [8.0] * 5}
            continue
        for key in (0, 1):
            values = sorted(r.v for r in table.filter(F.col("k") == key).collect())
            assert found[key][0] == values[0] and found[key][-1] == values[-1]
            for rank, value in zip(ranks, found[key]):
                assert abs(sum(v <= value for v in values) / len(values) - rank) <= rank_error(128)
