"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of local cores. Every query is run
once to warm up, then timed ``BENCH_RUNS`` times (default 2); the best time counts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from lamella.session import clean_up  # noqa: E402
from queries import REGISTRY  # noqa: E402

HEADLINE = [
    "stage_events",
    "stage_union_orders",
    "partition_lte",
    "bulk_include_exclude",
    "grain_hour",
    "grain_month_orders",
    "where_nested",
    "in_sub",
    "not_in_sub",
    "exists_sub",
    "scalar_sub_gt",
    "having_text",
    "event_date_range",
    "read_recorded_partitions",
    "join_inner",
    "join_left",
    "join_full",
    "join_full_plain",
    "join_dims",
    "join_left_deep",
    "unnest_array",
    "unnest_struct",
    "unnest_json_map",
    "aggs_multi",
    "count_reagg",
    "expr_aggs",
    "rollup_day",
    "rollup_month",
    "rollup_select",
    "lookback_7d",
    "lookback_distinct",
    "hll_rollup",
    "kll_p95",
    "window_passthrough",
    "order_limit_offset",
    "union_models",
    "cte_chain",
    "overwrite_partitions",
    "delete_insert_key",
    "merge_all",
    "compact_partitions",
    "check_unique",
    "check_relationships",
    "run_checks",
    "date_profile",
    "candidate_dates",
    "changed_dates",
    "due_dates",
    "metric_avg",
    "metric_custom_median",
    "time_interval_week",
    "scalar_times",
    "shop_customer_summary",
    "shop_rolling_30_day",
    "shop_profitability_mart",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        # Recording where each column expression was written costs more than these queries run.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED", tempfile.mkdtemp(prefix="bench-")))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:] or HEADLINE
    seconds = {}
    REGISTRY["aggs_multi"].run(spark, folder).write.format("noop").mode("overwrite").save()
    for name in only:
        best = None
        for attempt in range(runs + 1):
            start = time.perf_counter()
            REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if attempt and (best is None or took < best):
                best = took
            if best is not None and took > 4:  # one timed run of a slow query is enough
                break
            if took > 60:  # a slow query needs no warming up
                best = took if best is None else best
                break
        seconds[name] = round(best, 4)
        print(f"{name} {best:.3f}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )
    clean_up()
    spark.stop()


if __name__ == "__main__":
    main()
