"""Shaped rows for an operational store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.functions import rules

OPEN_ORDER = ["open", "in_progress", "scheduled"]


def asset_master(assets: DataFrame, devices: DataFrame, sites: DataFrame, alarms: DataFrame, orders: DataFrame) -> DataFrame:
    """Asset with its site and device nested, and what is open on it. Counts are aggregated before they are joined."""
    open_alarms = alarms.filter(F.col("state") == "active").groupBy("deviceId").agg(
        F.count(F.lit(1)).alias("openAlarmCount")
    )
    open_orders = orders.filter(F.col("status").isin(OPEN_ORDER)).groupBy("assetId").agg(
        F.count(F.lit(1)).alias("openWorkOrderCount")
    )
    site = sites.select("siteId", F.struct("siteName", "siteType", "region", "capacityMld").alias("site"))
    device = devices.select(
        "deviceId",
        F.struct("deviceType", "status", "connectivity", "certDaysToExpiry", "minutesSinceLastMessage").alias("edgeDevice"),
    )
    return (
        assets.join(device, "deviceId", "left")
        .join(site, "siteId", "left")
        .join(open_alarms, "deviceId", "left")
        .join(open_orders, "assetId", "left")
        .na.fill(0, ["openAlarmCount", "openWorkOrderCount"])
        .withColumn("id", F.col("assetId"))
        .withColumn("docType", F.lit("asset"))
    )


def open_alarms(alarms: DataFrame) -> DataFrame:
    return alarms.withColumn("id", F.col("alarmId")).withColumn("isOpen", F.col("state") == "active")


def open_orders(orders: DataFrame, origin: str = "historical") -> DataFrame:
    return (
        orders.withColumn("id", F.col("workOrderId"))
        .withColumn("isOpen", F.col("status").isin(OPEN_ORDER))
        .withColumn("origin", F.lit(origin))
    )


def daily_tag_stats(points: DataFrame, *, expected_per_day: int = 24) -> DataFrame:
    """One row per device and day with a map of tag statistics (as many entries as there are tags)."""
    per_tag = points.groupBy("deviceId", "siteId", F.to_date("timestamp").alias("date"), "tag").agg(
        F.count("value").alias("n"),
        rules.steady(F.avg("value"), 4).alias("mean"),
        rules.steady(F.min("value"), 4).alias("min"),
        rules.steady(F.max("value"), 4).alias("max"),
        rules.steady(F.stddev_pop("value"), 4).alias("std"),
    )
    entry = F.struct("tag", F.struct("n", "mean", "min", "max", "std").alias("stats"))
    observed = F.col("observedSamples")
    return (
        per_tag.groupBy("deviceId", "siteId", "date")
        .agg(
            F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("tags"),
            F.max("n").alias("observedSamples"),
        )
        .withColumn("id", rules.stable_id(F.lit("tsum"), "deviceId", F.col("date").cast("string")))
        .withColumn("expectedSamples", F.lit(expected_per_day))
        .withColumn("completenessPct", rules.steady(observed * 100.0 / expected_per_day, 1))
    )
