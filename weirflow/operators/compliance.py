"""Water quality against regulatory limits, and sensor faults against real events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow import params
from weirflow.functions import ordered, rules
from weirflow.session import local_table


def limit_table(spark: SparkSession) -> DataFrame:
    return local_table(spark, params.REGULATORY_LIMITS, params.LIMIT_COLUMNS)


def limits_for(limits: DataFrame, jurisdiction: str | None = "US-EPA", parameter: str | None = None) -> DataFrame:
    return limits.filter(rules.matches({"jurisdiction": jurisdiction, "parameter": parameter}))


def breach() -> Column:
    low = F.coalesce(F.col("value") < F.col("minValue"), F.lit(False))
    return low | F.coalesce(F.col("value") > F.col("maxValue"), F.lit(False))


def with_limits(readings: DataFrame, limits: DataFrame) -> DataFrame:
    """Long readings with their limit and a breach mark. The limits of one jurisdiction are a handful of rows."""
    return readings.join(limits, "parameter").withColumn("isBreach", breach())


def compliance_window(readings: DataFrame, limits: DataFrame, sites: DataFrame) -> DataFrame:
    """Status of every site and limited parameter; parameters without readings say ``no data``."""
    found = (
        with_limits(readings, limits)
        .groupBy("siteId", "parameter")
        .agg(
            rules.steady(F.min("value"), 3).alias("min"),
            rules.steady(F.max("value"), 3).alias("max"),
            rules.steady(F.avg("value"), 3).alias("mean"),
            F.count("value").alias("samples"),
            F.count_if("isBreach").alias("breachCount"),
        )
    )
    facts = ["parameter", "unit", "minValue", "maxValue", "tier", "notificationHours", "requiredAction", "citation"]
    rulebook = limits.agg(F.collect_list(F.struct(*facts))).scalar()
    return (
        sites.select("siteId", F.inline(rulebook))
        .join(found, ["siteId", "parameter"], "left")
        .na.fill(0, ["samples", "breachCount"])
        .withColumn(
            "status",
            F.when(F.col("samples") == 0, "no data").when(F.col("breachCount") > 0, "exceedance").otherwise("compliant"),
        )
    )


def overall_status(window: DataFrame) -> DataFrame:
    bad = F.bool_or(F.col("status") == "exceedance")
    return window.groupBy("siteId").agg(F.when(bad, "exceedance").otherwise("compliant").alias("overallStatus"))


def escalations(window: DataFrame) -> DataFrame:
    """Acute breaches with what to do and by when."""
    return window.filter((F.col("tier") == 1) & (F.col("breachCount") > 0)).select(
        "siteId", "parameter", F.col("requiredAction").alias("action"),
        F.col("notificationHours").alias("deadlineHours"), "citation",
    )


def latest_calibration(calibrations: DataFrame) -> DataFrame:
    keys = ["deviceId", "parameter"]
    return ordered.latest_by(calibrations, keys, [F.col("calibratedAt"), ordered.tie_hash(calibrations, keys)])


def sensor_validity(readings: DataFrame, calibrations: DataFrame, *, min_samples: int = 6) -> DataFrame:
    """Water problem or sensor problem: flatline, railed and drift, each named.

    Drift alone is advisory, because a real steady decay looks the same; it does not remove trust.
    """
    keys = ["deviceId", "parameter"]
    placed = ordered.with_positions(readings, keys, "timestamp", ["value"])
    n, at, value = F.col("seriesLength"), F.col("position"), F.col("value")
    half = F.floor(n / 2)
    last = F.when(at > n - 6, value)
    facts = placed.filter(n >= min_samples).groupBy(*keys).agg(
        F.count("value").alias("samples"),
        F.avg("value").alias("_mean"),
        F.stddev_pop("value").alias("_std"),
        F.max("value").alias("_max"),
        F.max(F.when(at == 1, value)).alias("_first"),
        F.min(last).alias("_lastMin"),
        F.max(last).alias("_lastMax"),
        F.avg(F.when(at > half, value)).alias("_late"),
        F.avg(F.when(at <= half, value)).alias("_early"),
    )
    std = F.col("_std")
    flat = std < 1e-6
    pinned = (F.col("_lastMin") == F.col("_first")) & (F.col("_lastMax") == F.col("_first"))
    railed = pinned & ((F.col("_first") == 0) | (F.col("_first") == F.col("_max")))
    drift = F.abs(F.col("_late") - F.col("_early")) > F.when(std == 0, 1.0).otherwise(std) * 0.5
    named = [F.when(flat, "flatline"), F.when(railed, "railed"), F.when(drift, "drift")]
    return (
        facts.withColumn("suspectedFaults", F.array_compact(F.array(*named)))
        .withColumn("isTrusted", ~(flat | railed))
        .withColumn("mean", rules.steady(F.col("_mean"), 4))
        .withColumn("stdev", rules.steady(std, 5))
        .withColumn(
            "verdict",
            F.when(F.size("suspectedFaults") > 0, "sensor fault likely").otherwise("sensor behaving normally"),
        )
        .drop("_mean", "_std", "_max", "_first", "_lastMin", "_lastMax", "_late", "_early")
        .join(latest_calibration(calibrations).select(*keys, "calibratedAt", "result"), keys, "left")
    )


def compliance_daily(
    readings: DataFrame, *, low: float = 0.2, high: float = 4.0, min_samples: int = 12, flat_range: float = 0.005
) -> DataFrame:
    """Chlorine record per sample point and day. A day that never moves inside the limits is no evidence."""
    cl = F.col("chlorine_mg_l")
    day = F.to_date("timestamp").alias("date")
    rows = readings.groupBy("siteId", "deviceId", day).agg(
        F.count(cl).alias("sampleCount"),
        F.min(cl).alias("_min"),
        F.max(cl).alias("_max"),
        rules.steady(F.avg(cl), 4).alias("meanValue"),
        F.count_if((cl < low) | (cl > high)).alias("breachCount"),
        rules.steady(F.max("turbidity_ntu"), 4).alias("turbidityMaxNtu"),
        rules.steady(F.min("ph"), 3).alias("phMin"),
        rules.steady(F.max("ph"), 3).alias("phMax"),
    )
    still = (F.col("sampleCount") >= min_samples) & (F.col("_max") - F.col("_min") < flat_range)
    return (
        rows.filter(F.col("sampleCount") > 0)
        .withColumn("isInvariant", still)
        .withColumn("analyserSuspect", still & (F.col("breachCount") == 0))
        .withColumn("compliant", (F.col("breachCount") == 0) & ~F.col("analyserSuspect"))
        .withColumn("minValue", rules.steady(F.col("_min"), 4))
        .withColumn("maxValue", rules.steady(F.col("_max"), 4))
        .withColumn("limitMin", F.lit(low))
        .withColumn("limitMax", F.lit(high))
        .withColumn("id", rules.stable_id(F.lit("compliance"), "siteId", "deviceId", F.col("date").cast("string")))
        .withColumn("assessmentNote", F.when(F.col("analyserSuspect"), "output invariant - treat as no data"))
        .drop("_min", "_max")
    )


def breach_runs(daily: DataFrame) -> DataFrame:
    """Runs of consecutive breach days per sample point (gaps and islands over day rows)."""
    order = Window.partitionBy("siteId", "deviceId").orderBy("date")
    island = F.unix_date("date") - F.row_number().over(order)
    return (
        daily.filter(F.col("breachCount") > 0)
        .withColumn("_island", island)
        .groupBy("siteId", "deviceId", "_island")
        .agg(
            F.min("date").alias("firstDay"),
            F.max("date").alias("lastDay"),
            F.count(F.lit(1)).alias("breachDays"),
            F.sum("breachCount").alias("breaches"),
        )
        .drop("_island")
    )
