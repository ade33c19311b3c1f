"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
    BENCH_CPUS     cores of the local session (default 8)
    BENCH_QUERIES  comma separated names, to time others than the headline ones
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from workload import QUERIES

HEADLINE = (
    "chained_recipes",
    "step_formula_new",
    "step_find_replace",
    "step_extract_date_parts",
    "step_distinct_rows",
    "step_unpivot",
    "step_pivot_sum",
    "step_dedup_one",
    "step_dedup_all",
    "step_sort_desc",
    "filter_contains_remove",
    "window_row_number",
    "window_running_sum",
    "window_moving_avg",
    "window_sum",
    "window_few_groups_rank",
    "window_global_lag",
    "join_inner",
    "join_full",
    "join_star",
    "group_median",
    "group_filtered",
    "group_global",
    "stack_all",
    "sql_recipe",
    "inc_append",
    "inc_delete_insert",
    "inc_merge_latest_per_key",
    "inc_group",
    "inc_microbatch_day",
    "test_suite",
    "freshness_column",
    "profile_quality_documents",
    "profile_full_lineitem",
    "profile_delta_emptied",
    "join_diagnosis_fan_out",
    "join_diagnosis_chain",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query starts the session's threads and code caches.
    QUERIES["chained_recipes"].run(spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in chosen.split(",") if chosen else HEADLINE:
        started = time.perf_counter()
        QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    scale = re.search(r"sf([0-9.]+)$", folder)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
