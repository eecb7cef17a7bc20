"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_RUNS (runs after a
warm-up; the median counts). Each query runs alone, from Parquet to a discarded result,
with nothing cached before it.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from salesmart.plans.registry import build_queries
from salesmart.session import configure

HEADLINE = (
    "filtered_invoices",
    "invoice_details",
    "core_kpis",
    "group_kpis_genre",
    "group_kpis_artist",
    "group_kpis_country",
    "topn_artist",
    "catalog_sales_artist",
    "monthly_summary",
    "geo_frames",
    "group_yearly_artist",
    "top_groups_yearly",
    "cohort_retention",
    "cohort_grid",
    "retention_decay",
    "customer_bounds",
    "retention_kpis",
    "kpi_bundle_long",
    "topn_all",
    "static_summary",
    "core_kpis_filtered",
    "monthly_summary_filtered",
    "group_kpis_genre_filtered",
    "retention_kpis_filtered",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = sys.argv[1:] or HEADLINE
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = build_queries()
    seconds = {name: _time(spark, registered[name], directory, runs) for name in chosen}
    print(
        json.dumps(
            {
                "metric": "total_wall_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


def _time(spark: SparkSession, query, directory: str, runs: int) -> float:
    taken = []
    for _ in range(runs + 1):
        spark.catalog.clearCache()
        begin = time.perf_counter()
        query(spark, directory).write.format("noop").mode("overwrite").save()
        taken.append(time.perf_counter() - begin)
    spark.catalog.clearCache()
    return round(statistics.median(taken[1:]), 3)


if __name__ == "__main__":
    main()
