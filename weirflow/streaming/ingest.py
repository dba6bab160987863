"""From raw messages to routed bronze rows; the same transforms serve batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow import params

# Payload types and the bronze table that takes them.
ROUTES = {
    "telemetry": "bronze_telemetry",
    "waterQuality": "bronze_water_quality",
    "dmaFlow": "bronze_dma_flow",
    "alarm": "bronze_alarm",
    "connectivity": "bronze_device_event",
    "deployment": "bronze_device_event",
    "twin": "bronze_device_event",
}
DEAD_LETTERS = "bronze_unrouted"


def lift_envelope(messages: DataFrame) -> DataFrame:
    """System properties and body fields as first-class columns."""
    return messages.select(
        F.col("SystemProperties.connectionDeviceId").alias("deviceId"),
        F.col("SystemProperties.enqueuedTime").alias("enqueuedUtc"),
        F.col("body.timestamp").alias("eventTimeUtc"),
        F.col("body.assetId").alias("assetId"),
        F.col("body.siteId").alias("siteId"),
        F.col("body.dmaId").alias("dmaId"),
        F.col("body.schemaVersion").alias("schemaVersion"),
        F.col("body.payloadType").alias("payloadType"),
        F.col("body.measurements").alias("measurements"),
    )


def drop_unattributed(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("deviceId").isNotNull() & F.col("eventTimeUtc").isNotNull())


def flag_late(rows: DataFrame, limit_seconds: int = params.REPLAY_LAG_SECONDS) -> DataFrame:
    """Arrival lag, and whether the row is a replay of a device's buffer."""
    lag = F.timestamp_diff("SECOND", F.col("eventTimeUtc"), F.col("enqueuedUtc"))
    return rows.withColumn("ingestLagSeconds", lag).withColumn("isReplay", F.col("ingestLagSeconds") > limit_seconds)


def ahead(event: str, arrival: str, limit_seconds: int = params.CLOCK_SKEW_SECONDS) -> Column:
    """Whether an event claims to lie after its own arrival: the device's clock is wrong. False where a time is missing."""
    return F.coalesce(F.col(event) > F.col(arrival) + F.make_dt_interval(secs=F.lit(limit_seconds)), F.lit(False))


def route(rows: DataFrame) -> DataFrame:
    """Name the target table; unknown types and events from the future go to the dead letters instead of vanishing, the
    latter under the day of their arrival."""
    pairs = [F.lit(x) for kv in ROUTES.items() for x in kv]
    target = F.create_map(*pairs)[F.col("payloadType")]
    wrong = ahead("eventTimeUtc", "enqueuedUtc")
    return rows.withColumn("target", F.when(~wrong, target)).withColumns({
        "target": F.coalesce("target", F.lit(DEAD_LETTERS)),
        "ingestDate": F.to_date(F.when(wrong, F.col("enqueuedUtc")).otherwise(F.col("eventTimeUtc"))),
    })


def to_bronze(messages: DataFrame) -> DataFrame:
    return route(flag_late(drop_unattributed(lift_envelope(messages))))
