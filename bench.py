"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the number of local threads. Every query runs twice to a sink
that drops its rows, and the better time counts. ``rows_per_sec`` relates it to the rows of the table
the query reads. ``compare`` holds sliding windows through panes against Spark's own expansion
of rows at overlaps of 60 and 300.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.functions.aggregates import avg_of, count  # noqa: E402
from millrace.operators.time_windows import window_aggregate  # noqa: E402
from millrace.operators.windows import WindowSpec  # noqa: E402
from millrace.plans.catalog import QUERIES  # noqa: E402
from millrace.plans.views import GRID, table  # noqa: E402
from millrace.session import build_session  # noqa: E402
from millrace.sources.sinks import drop_result  # noqa: E402

HEADLINE = (
    "campaign_view_count", "campaign_sum_tumbling", "campaign_static_join_count", "cluster_cpu_by_category",
    "cluster_cpu_by_job", "grid_global_load", "grid_plug_load", "grid_outliers", "road_slow_segments",
    "road_vehicle_segments", "road_tolls", "equipment_three_avgs", "auction_q1_currency", "auction_q5_hot_items",
    "auction_q8_window_join", "multi_query_shared", "win_multi_shared", "win_tumbling_rows", "win_sliding_rows",
    "join_theta_time", "join_equi_rows", "stream_watermark_count",
)


LINEITEM = ("road_slow_segments", "road_vehicle_segments", "auction_q1_currency", "auction_q5_hot_items")
ORDERS = ("auction_q8_window_join",)


def source_of(name: str) -> str:
    return "lineitem" if name in LINEITEM else "orders" if name in ORDERS else "events"


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    drop_result(QUERIES["campaign_view_count"](spark, sf_dir))  # start the engine before the clock
    rows = {t: table(spark, sf_dir, t).count() for t in ("events", "lineitem", "orders")}
    times = {
        name: min(timed(lambda: drop_result(QUERIES[name](spark, sf_dir))) for _ in range(2)) for name in HEADLINE
    }

    grid = GRID.frame(spark, sf_dir)
    compare = {}
    for overlap in (60, 300):
        spec = WindowSpec.sliding(overlap * 60, 60)
        aggs = [count(), avg_of("value", "load")]
        plain = F.window("ts", f"{overlap} minutes", "1 minute")
        compare[f"panes_{overlap}"] = timed(lambda: drop_result(window_aggregate(grid, spec, ["house"], aggs)))
        compare[f"plain_{overlap}"] = timed(
            lambda: drop_result(grid.groupBy(plain, "house").agg(*(a.direct() for a in aggs)))
        )
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rows_per_sec": {name: round(rows[source_of(name)] / sec) for name, sec in times.items()},
                "compare": compare,
                "rows": rows,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
