"""Health of the devices themselves: status, drift, outages, certificates and rollouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions import ordered, rules


def canonical_devices(devices: DataFrame) -> DataFrame:
    return devices.withColumns({c: rules.canonical(F.col(c)) for c in ("deviceType", "status") if c in devices.columns})


def fleet_summary(devices: DataFrame, by: list[str]) -> DataFrame:
    """Counts per status, stale devices, certificate risk and health score of each group."""
    online = F.col("status") == "online"
    per_status = devices.groupBy(*by, F.coalesce("status", F.lit("unknown")).alias("_status")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("minutesSinceLastMessage") > 60).alias("_stale"),
        F.count_if(F.col("certDaysToExpiry") <= 30).alias("_risk"),
        F.count_if(online).alias("_online"),
    )
    return per_status.groupBy(*by).agg(
        F.sum("_n").alias("totalDevices"),
        # As many entries as there are status words.
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("_status", "_n")))).alias("byStatus"),
        F.sum("_stale").alias("staleTelemetry"),
        F.sum("_risk").alias("certificateRisk"),
        rules.steady(F.sum("_online") * 100 / F.sum("_n"), 1).alias("healthScore"),
    )


def needs_attention(devices: DataFrame) -> DataFrame:
    """The devices behind the summary's counts, as rows, because a site may have any number of them."""
    stale = F.col("minutesSinceLastMessage") > 60
    risk = F.col("certDaysToExpiry") <= 30
    return devices.select(
        "siteId", "deviceId", F.coalesce(stale, F.lit(False)).alias("isStale"),
        F.coalesce(risk, F.lit(False)).alias("isCertificateRisk"),
    ).filter("isStale OR isCertificateRisk")


def drifted_properties(twins: DataFrame) -> DataFrame:
    """Properties whose report differs from what is wanted; missing on both sides counts as equal."""
    rows = twins.filter(~F.col("desiredValue").eqNullSafe(F.col("reportedValue")))
    return rows.select("deviceId", "moduleId", "property", F.col("desiredValue").alias("desired"),
                       F.col("reportedValue").alias("reported"))


def twin_drift(twins: DataFrame) -> DataFrame:
    same = F.col("desiredValue").eqNullSafe(F.col("reportedValue"))
    return twins.groupBy("deviceId").agg(
        F.count(F.lit(1)).alias("propertyCount"), F.count_if(~same).alias("driftCount")
    )


def connectivity(events: DataFrame, devices: DataFrame, as_of: Column, *, hours: int) -> DataFrame:
    """Disconnects and uptime. Outages are clipped to the window and overlapping ones count once.

    Overlaps are merged hour by hour, so a flapping device is spread over as many groups as the window has hours.
    """
    start = as_of - F.make_dt_interval(hours=F.lit(hours))
    begin = F.greatest(F.unix_seconds("timestamp"), F.unix_seconds(start))
    lasting = F.coalesce("durationMinutes", F.lit(0)) * 60
    finish = F.least(F.unix_seconds("timestamp") + lasting, F.unix_seconds(as_of))
    outages = (
        events.filter((F.col("event") == "disconnected") & (F.col("timestamp") <= as_of))
        .select("deviceId", begin.cast("long").alias("_from"), finish.cast("long").alias("_to"))
        .filter(F.col("_to") >= F.col("_from"))
    )
    counts = outages.groupBy("deviceId").agg(F.count(F.lit(1)).alias("disconnectCount"))
    slot = F.explode(F.sequence(F.floor(F.col("_from") / 3600), F.floor(F.col("_to") / 3600)))
    pieces = (
        outages.withColumn("_hour", slot)
        .select(
            "deviceId",
            "_hour",
            F.greatest("_from", F.col("_hour") * 3600).alias("_from"),
            F.least("_to", F.col("_hour") * 3600 + 3600).alias("_to"),
        )
        .groupBy("deviceId", "_hour", "_from")
        .agg(F.max("_to").alias("_to"))
    )
    before = Window.partitionBy("deviceId", "_hour").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("_to").over(before), F.col("_from"))
    down = (
        pieces.withColumn("_down", F.greatest(F.col("_to") - F.greatest("_from", reach), F.lit(0)))
        .groupBy("deviceId")
        .agg(F.sum("_down").alias("_down"))
    )
    share = F.least(F.lit(100.0), F.col("_down") / (hours * 3600) * 100)
    return (
        devices.select("deviceId")
        .join(counts, "deviceId", "left")
        .join(down, "deviceId", "left")
        .na.fill(0, ["disconnectCount", "_down"])
        .withColumn("uptimePercent", rules.steady(F.lit(100.0) - share, 2))
        .drop("_down")
    )


def cert_expiry(devices: DataFrame, *, days_ahead: int = 90, critical_days: int = 14) -> DataFrame:
    """Devices whose certificate ends soon, soonest first. Zero days left is critical."""
    days = F.col("certDaysToExpiry")
    return (
        devices.filter(days <= days_ahead)
        .select("deviceId", "siteId", "status", "certDaysToExpiry", (days <= critical_days).alias("isCritical"))
        .orderBy("certDaysToExpiry", "deviceId")
    )


def rollout(deployments: DataFrame) -> DataFrame:
    return deployments.withColumn(
        "successPercent", rules.percent(F.col("reportedSuccessCount"), F.col("appliedCount"), 1)
    )


def unseen(devices: DataFrame, rows: DataFrame, as_of: Column, hours: float) -> DataFrame:
    """Devices without any data in the window, with the asset each of them leaves unwatched."""
    seen = rows.filter(rules.within("timestamp", as_of, hours)).select("deviceId").distinct()
    return devices.join(seen, "deviceId", "left_anti").select("deviceId", "siteId", "assetId")
