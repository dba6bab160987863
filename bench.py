"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line.

Each query is run to completion with the no-op sink, so all its columns are computed and nothing is collected.
The figure of a query is the median of its runs after one warm-up run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from weirflow.plans.catalog import QUERIES

HEADLINE = [
    "win_dedup_latest", "win_flatline_24h", "prj_quality_flag", "agg_telemetry_hourly", "agg_wq_hourly", "agg_completeness",
    "win_mnf_baseline", "prj_energy", "prj_asset_health", "agg_statistics", "win_anomaly", "win_downsample",
    "win_sensor_validity", "agg_compliance_window", "agg_compliance_daily", "agg_pressure_drop", "agg_connectivity",
    "agg_peer_compare", "agg_fleet_summary", "jn_asset_master", "agg_daily_tag_stats", "agg_cost_estimate", "wo_propose",
    "agg_energy_loss", "txt_route", "txt_resolve_terms", "txt_chunk_corpus", "txt_retrieve_keyword", "txt_retrieve_vector",
    "cnv_transcript", "snk_upsert", "str_hourly",
]


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name].plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("weirflow-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus), "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
