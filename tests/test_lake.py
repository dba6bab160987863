"""The batch jobs over a small lake."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from weirflow.plans import lake, medallion
from weirflow.plans.pipelines import built_lake

SMALL = "/root/testdata/sf0.001"


def content(spark, run, table):
    return sorted(map(repr, spark.read.parquet(run.path(table)).collect()))


def test_jobs_run_twice_without_a_change_and_agree_with_the_plans(spark):
    run = built_lake(spark, SMALL, hours=24 * 31)
    first = sorted(map(tuple, lake.silver_to_gold(spark, run).collect()))
    tables = ["silver_telemetry", "silver_data_completeness", "gold_telemetry_hourly", "gold_energy", "gold_asset_health"]
    before = {t: content(spark, run, t) for t in tables}
    lake.bronze_to_silver(spark, run)
    assert sorted(map(tuple, lake.silver_to_gold(spark, run).collect())) == first
    assert before == {t: content(spark, run, t) for t in tables}

    # No bronze key is lost on the way, good or bad.
    keys = spark.read.parquet(run.path("bronze_telemetry")).select("deviceId", "eventTimeUtc").distinct().count()
    assert spark.read.parquet(run.path("silver_telemetry")).count() == keys

    columns = medallion.hourly(spark, SMALL).columns
    want = sorted(map(repr, medallion.hourly(spark, SMALL).collect()))
    assert sorted(map(repr, spark.read.parquet(run.path("gold_telemetry_hourly")).select(*columns).collect())) == want


def test_a_short_rerun_does_not_spoil_what_was_there(spark):
    run = built_lake(spark, SMALL, hours=24 * 31)
    before = content(spark, run, "silver_telemetry")
    # A later and shorter window: its first hours have no full day inside the window, and must come out the same.
    lake.bronze_to_silver(spark, replace(run, as_of="2024-01-20 12:30:00", hours=72))
    assert content(spark, run, "silver_telemetry") == before
    late = spark.read.parquet(run.path("silver_telemetry")).agg(F.max("timestamp")).first()[0]
    assert late.day == 30


def test_a_device_on_another_asset_leaves_no_row_of_the_old_one(spark):
    run = built_lake(spark, SMALL, hours=24 * 31)
    lake.silver_to_gold(spark, run)
    before = {r.deviceId: r.assetId for r in spark.read.parquet(run.path("gold_asset_health")).collect()}
    moved = sorted(before)[0]
    rows = spark.read.parquet(run.path("bronze_telemetry")).filter(F.col("deviceId") == moved)
    later = rows.withColumns({"assetId": F.lit("AST-NEW"), "enqueuedUtc": F.col("enqueuedUtc") + F.expr("interval 2 day")})
    later.write.mode("append").partitionBy("ingestDate").parquet(run.path("bronze_telemetry"))
    lake.bronze_to_silver(spark, run)
    lake.silver_to_gold(spark, run)
    after = sorted((r.deviceId, r.assetId) for r in spark.read.parquet(run.path("gold_asset_health")).collect())
    assert after == sorted({**before, moved: "AST-NEW"}.items())
