"""The two batch jobs over a lake of tables: bronze to silver, and silver to gold. Both may be run again at any time.

Tables are the stage boundaries: what one job needs of the other is read back, never computed twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow import params
from weirflow.functions import rules
from weirflow.operators import gold, integrity, silver
from weirflow.session import leaf_folders, path_exists
from weirflow.sources.writers import pass_through, read_table, upsert

# Reference tables, their gold name and key.
DIMENSIONS = {
    "ref_failure_modes": ("gold_failure_mode", ["assetClass", "failureMode"]),
    "ref_regulatory_limits": ("gold_regulatory_limit", ["jurisdiction", "parameter"]),
    "ref_workorders": ("gold_work_order", ["workOrderId"]),
    "ref_alarms": ("gold_alarm", ["alarmId"]),
    "ref_spare_parts": ("gold_spare_part", ["assetId", "partNumber"]),
}
GOLD = [
    "gold_site", "gold_asset", "gold_edge_device", "gold_telemetry_hourly", "gold_water_quality", "gold_dma_flow",
    "gold_dma_mnf", "gold_energy", "gold_asset_health", *[name for name, _ in DIMENSIONS.values()],
]


#: Days that a night's baseline reaches back.
BASELINE_DAYS = 90


@dataclass(frozen=True)
class Run:
    """One run: where, up to when, how far back, and the limits of the quality rules."""

    lake: str
    as_of: str
    hours: int = 72
    min_samples: int = params.FLATLINE_MIN_SAMPLES
    std_limit: float = params.FLATLINE_STD
    expected_per_hour: int = params.SAMPLES_PER_HOUR

    def path(self, table: str) -> str:
        return f"{self.lake.rstrip('/')}/{table}"


def _since(df: DataFrame, ts: str, run: Run, extra_hours: int = 0) -> DataFrame:
    """Rows from the full hour in which the run's window begins, with the partition date filtered along."""
    now = F.lit(run.as_of).cast("timestamp")
    start = F.date_trunc("hour", now - F.make_dt_interval(hours=F.lit(run.hours + extra_hours)))
    return df.filter((F.col(ts) >= start) & (F.col(ts) <= now) & (F.col("ingestDate") >= F.to_date(start)))


def bronze_to_silver(spark: SparkSession, run: Run) -> None:
    """Clean the reprocess window. A day more is read than written, so that the trailing statistics of the first
    written hours are whole; a late replay inside the window finds its place by key."""
    quality = {"min_samples": run.min_samples, "std_limit": run.std_limit}
    jobs = {
        "telemetry": (lambda rows: silver.silver_telemetry(rows, **quality), ["deviceId", "timestamp"]),
        "water_quality": (lambda rows: silver.silver_water_quality(rows, **quality), ["deviceId", "timestamp"]),
        "dma_flow": (silver.silver_dma_flow, ["dmaId", "timestamp"]),
    }
    for name, (clean, keys) in jobs.items():
        if leaf_folders(spark, run.path(f"bronze_{name}"), 1):  # a stream's table is there before its first row
            bronze = _since(spark.read.parquet(run.path(f"bronze_{name}")), "eventTimeUtc", run, extra_hours=24)
            upsert(spark, _since(clean(bronze), "timestamp", run), run.path(f"silver_{name}"), keys, "ingestDate")

    now = F.lit(run.as_of).cast("timestamp")
    ledger = silver.Ledger(
        now - F.make_dt_interval(hours=F.lit(run.hours)), now - F.make_dt_interval(hours=F.lit(1)), run.expected_per_hour
    )
    folded = ledger.folded(
        _since(spark.read.parquet(run.path("silver_telemetry")), "timestamp", run), spark.read.parquet(run.path("ref_devices"))
    )
    upsert(
        spark, folded, run.path("silver_data_completeness"), ["deviceId", "hour"], "ingestDate", unfold=(ledger.days, ledger.hours)
    )


def silver_to_gold(spark: SparkSession, run: Run) -> DataFrame:
    """Build the business tables; returns their row counts."""

    def read(table: str) -> DataFrame:
        return read_table(spark, run.path(table))

    def put(df: DataFrame, table: str, keys: list[str], partition: str | None = None) -> None:
        upsert(spark, df, run.path(table), keys, partition)

    put(gold.gold_site(read("ref_sites")), "gold_site", ["siteId"])
    put(gold.gold_asset(read("ref_assets")), "gold_asset", ["assetId"])
    put(gold.gold_edge_device(read("ref_devices"), run.as_of), "gold_edge_device", ["deviceId"])

    hours = gold.telemetry_hourly(
        _since(read("silver_telemetry"), "timestamp", run), expected_per_hour=run.expected_per_hour
    )
    put(hours, "gold_telemetry_hourly", ["deviceId", "timestamp"], "ingestDate")
    # what the first job skips for want of bronze rows is skipped here too
    if path_exists(spark, run.path("silver_water_quality")):
        quality = gold.water_quality_hourly(_since(read("silver_water_quality"), "timestamp", run))
        put(quality, "gold_water_quality", ["deviceId", "timestamp"], "ingestDate")
    if path_exists(spark, run.path("silver_dma_flow")):
        put(gold.dma_hourly(_since(read("silver_dma_flow"), "timestamp", run)), "gold_dma_flow", ["dmaId", "timestamp"], "ingestDate")
        # the nights of the window, and before them the days that their baselines reach back
        flow = _since(read("gold_dma_flow"), "timestamp", run, extra_hours=(BASELINE_DAYS + 1) * 24)
        nights = gold.night_flow_baseline(gold.nightly_flow(flow), baseline_days=BASELINE_DAYS).withColumn("ingestDate", F.col("date"))
        first = F.to_date(F.lit(run.as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(run.hours)))
        put(nights.filter(F.col("date") >= first), "gold_dma_mnf", ["dmaId", "date"], "ingestDate")
    put(gold.energy(_since(read("gold_telemetry_hourly"), "timestamp", run)), "gold_energy", ["deviceId", "timestamp"], "ingestDate")
    recent = read("gold_telemetry_hourly").filter(
        rules.within("ingestDate", F.lit(run.as_of).cast("timestamp"), 15 * 24)
    )
    slope = gold.vibration_trend(recent, run.as_of)
    # by device: one that is fitted to another asset leaves no row of the old one behind
    put(gold.asset_health(slope, read("gold_asset"), gold.zone_limits(spark)), "gold_asset_health", ["deviceId"])

    tables = {name: read(name) for name in DIMENSIONS if path_exists(spark, run.path(name))}
    pass_through(spark, tables, {name: (run.path(target), keys) for name, (target, keys) in DIMENSIONS.items()})
    return summary(spark, run)


def summary(spark: SparkSession, run: Run) -> DataFrame:
    """Row counts of the gold tables that are there."""
    return integrity.row_counts(
        {t: spark.read.parquet(run.path(t)) for t in GOLD if path_exists(spark, run.path(t))}
    )
