"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, or ``all``), BENCH_REPEATS (default 3: the
median of up to so many runs, fewer where they take over ten seconds together).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import REGISTRY  # noqa: E402
from rackline.sources.tables import intermediate_tables  # noqa: E402

HEADLINE = (
    "interval_join_pairs",
    "energy_by_class_state",
    "class_state_metrics",
    "class_comparison",
    "concurrent_jobs",
    "state_counts_pivot",
    "jobs_enriched",
    "describe_wait_run",
    "ecdf_node_hours",
    "jobs_per_hour_of_year",
    "jobs_per_node_top5",
    "box_jobs_per_period",
    "rack_hardware",
    "utilisation_ratios",
    "ratios_winsorized",
    "ratio_histogram",
    "ratio_box",
    "gpu_power_temp_bins",
    "gpu_power_temp_bins_95",
    "peer_state_counts",
    "peer_state_corr",
    "profile",
    "interpolate",
    "null_neighbours",
    "json_aggregate",
    "corr_pearson",
    "corr_spearman",
    "node_expand",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = tuple(REGISTRY) if chosen == "all" else tuple(filter(None, chosen.split(","))) or HEADLINE
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    # One small query first, so that the first measured one does not pay for
    # starting the engine.
    REGISTRY["node_expand"](spark, base).write.format("noop").mode("overwrite").save()

    seconds, repeats = {}, int(os.environ.get("BENCH_REPEATS", "3"))
    for name in names:
        runs = []
        # Up to three runs; a slow query is not repeated beyond ten seconds.
        while len(runs) < repeats and sum(runs) < 10:
            begin = time.perf_counter()
            with intermediate_tables(spark):
                REGISTRY[name](spark, base).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begin)
        seconds[name] = round(median(runs), 3)
    result = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(base).name.removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
