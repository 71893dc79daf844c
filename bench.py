"""Time the whole study over the tables in ``$BENCH_SF_DIR``; print one JSON line.

One study runs all steps in order, as a user would: it scans ``lineitem`` once,
and later steps read the tables that earlier steps wrote.  The study runs twice
from scratch: ``cold_total`` includes start-up and code generation, ``value`` and
``queries`` are the second run.  ``standalone`` holds queries that each start
again from the order tables.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import catalog  # noqa: E402

STUDY = [
    "fundamentals_annual",
    "factors_tidy",
    "qcut_independent",
    "qcut_dependent",
    "premium_comparison",
    "newey_west_mean",
    "estimate_histogram",
    "reference_lines",
    "grid_summary",
]
STANDALONE = ["panel_monthly", "premium_comparison", "grid_results", "exchange_breakpoints_ranked"]


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def run(query, spark: SparkSession, sf_dir: str) -> float:
    return timed(
        lambda: query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    )


def run_study(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    catalog.forget_studies()
    queries = catalog.queries()
    times = {"write_panel": timed(lambda: catalog.study(spark, sf_dir))}
    times["write_sorting_variables"] = timed(
        lambda: catalog.study(spark, sf_dir).sorting_variables
    )
    times["write_grid_results"] = timed(lambda: catalog.study(spark, sf_dir).results)
    return times | {name: run(queries[name], spark, sf_dir) for name in STUDY}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("factorloom-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-shared-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    cold = run_study(spark, sf_dir)
    times = run_study(spark, sf_dir)
    standalone = {}
    for name in STANDALONE:
        catalog.forget_studies()
        standalone[name] = run(catalog.queries()[name], spark, sf_dir)
    line = {
        "metric": "whole study, from order tables to reports",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "cold_total": round(sum(cold.values()), 3),
        "standalone": standalone,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": int(cpus),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
