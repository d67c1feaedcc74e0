"""What the physical plans must look like to hold at scale."""

import re

import pytest

import __spark_entry__ as entry


def plan(df, final=False):
    if final:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


BATCH = sorted(n for n in set(entry.queries()) - set(entry.LLM_QUERIES) if not n.startswith(("stream_", "sink_", "src_")))


@pytest.mark.parametrize("name", BATCH)
def test_no_query_compares_all_pairs(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(entry.queries()["campaign_view_count"](spark, sf_dir))
    assert "EqualTo(event_type,view)" in text
    columns = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert {c.split(":")[0] for c in columns.split(",")} == {"event_id", "ts", "event_type"}


@pytest.mark.parametrize(
    "name", ["auction_q5_hot_items", "grid_outliers", "win_fill_gaps", "logs_throughput"]
)
def test_results_used_twice_are_computed_once(spark, sf_dir, name):
    assert "Reused" in plan(entry.queries()[name](spark, sf_dir), final=True)


# long windows of minima and maxima use their panes once
@pytest.mark.parametrize("name", ["cluster_cpu_by_category", "multi_query_shared", "equipment_union_avgs", "win_panes"])
def test_one_scan(spark, sf_dir, name):
    assert plan(entry.queries()[name](spark, sf_dir)).count("FileScan") == 1
