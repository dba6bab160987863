"""Queries of the bronze, silver and gold layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow import params
from weirflow.functions import ordered, rules
from weirflow.operators import gold, silver
from weirflow.plans import bindings as b
from weirflow.plans.oracle_views import NOW, sql
from weirflow.plans.registry import query

TAGS = ", ".join(params.TELEMETRY_TAGS)
WQ = ", ".join(params.QUALITY_PARAMETERS)


def silver_telemetry(spark, sf_dir):
    return silver.silver_telemetry(b.bronze_telemetry(spark, sf_dir), min_samples=b.MIN_SAMPLES, std_limit=b.STD_LIMIT)


def silver_quality(spark, sf_dir):
    return silver.silver_water_quality(
        b.bronze_quality(spark, sf_dir), min_samples=b.MIN_SAMPLES, std_limit=b.STD_LIMIT
    )


def silver_dma(spark, sf_dir):
    return silver.silver_dma_flow(b.bronze_dma(spark, sf_dir))


def hourly(spark, sf_dir):
    return gold.telemetry_hourly(silver_telemetry(spark, sf_dir), expected_per_hour=b.EXPECTED_PER_HOUR)


@query("prj_flatten", sql(f"""SELECT "timestamp", ingestedUtc, deviceId, assetId, siteId, isReplay, schemaVersion, {TAGS},
    runHours FROM bronze"""))
def prj_flatten(spark, sf_dir):
    return silver.flatten(
        b.bronze_telemetry(spark, sf_dir), params.TELEMETRY_TAGS, ["deviceId", "assetId", "siteId"], ["runHours"]
    )


@query("win_dedup_latest", sql(f"""SELECT "timestamp", ingestedUtc, deviceId, {TAGS} FROM bronze
    QUALIFY row_number() OVER (PARTITION BY deviceId, "timestamp" ORDER BY ingestedUtc DESC) = 1"""))
def win_dedup_latest(spark, sf_dir):
    rows = silver.flatten(b.bronze_telemetry(spark, sf_dir), params.TELEMETRY_TAGS, ["deviceId"])
    return silver.dedup_latest(rows, ["deviceId", "timestamp"]).drop("isReplay", "schemaVersion")


@query("flt_bounds", sql("""SELECT deviceId, "timestamp", hadOutOfRange, """ + TAGS + " FROM silver"))
def flt_bounds(spark, sf_dir):
    rows = silver.flatten(b.bronze_telemetry(spark, sf_dir), params.TELEMETRY_TAGS, ["deviceId"])
    rows = silver.apply_bounds(silver.dedup_latest(rows, ["deviceId", "timestamp"]), params.TELEMETRY_BOUNDS)
    return rows.select("deviceId", "timestamp", "hadOutOfRange", *params.TELEMETRY_TAGS)


@query("win_flatline_24h", sql('SELECT deviceId, "timestamp", isFlatline FROM silver'))
def win_flatline_24h(spark, sf_dir):
    return silver_telemetry(spark, sf_dir).select("deviceId", "timestamp", "isFlatline")


@query("prj_quality_flag", sql(f"""SELECT "timestamp", deviceId, assetId, siteId, isReplay, schemaVersion, {TAGS}, runHours,
    isFlatline, qualityFlag, isTrustworthy, ingestDate FROM silver"""), dates=("ingestDate",))
def prj_quality_flag(spark, sf_dir):
    return silver_telemetry(spark, sf_dir).drop("ingestedUtc", "hadOutOfRange")


@query("silver_water_quality", sql(f"""SELECT "timestamp", deviceId, siteId, {WQ}, chlorineSensorFlatline, qualityFlag,
    isTrustworthy, ingestDate FROM silver_wq"""), dates=("ingestDate",))
def silver_water_quality(spark, sf_dir):
    return silver_quality(spark, sf_dir).drop("ingestedUtc", "hadOutOfRange", "isReplay", "schemaVersion")


@query("prj_night_window", sql("SELECT * FROM silver_dma"), dates=("ingestDate",))
def prj_night_window(spark, sf_dir):
    return silver_dma(spark, sf_dir).drop("ingestedUtc")


@query("flt_lookback", sql(f"""SELECT * FROM telemetry WHERE "timestamp" >= {NOW} - INTERVAL 72 HOUR"""))
def flt_lookback(spark, sf_dir):
    return silver.lookback(b.telemetry(spark, sf_dir), "timestamp", 72, b.AS_OF)


@query("flt_lookback_newest", sql("""SELECT * FROM telemetry
    WHERE "timestamp" >= (SELECT max("timestamp") FROM telemetry) - INTERVAL 72 HOUR"""))
def flt_lookback_newest(spark, sf_dir):
    return silver.lookback(b.telemetry(spark, sf_dir), "timestamp", 72)


@query("agg_completeness", sql(f"""
  WITH grid AS (SELECT 'DEV-' || c_custkey AS deviceId, unnest(generate_series({NOW} - INTERVAL 72 HOUR,
                       {NOW} - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS "hour" FROM customer),
  got AS (SELECT deviceId, date_trunc('hour', "timestamp") AS "hour", count(*) AS n,
                 count(*) FILTER (WHERE isTrustworthy) AS t FROM silver GROUP BY 1, 2)
  SELECT deviceId, "hour", receivedSamples, trustworthySamples, {b.EXPECTED_PER_HOUR} AS expectedSamples, completenessPct,
         CASE WHEN completenessPct >= {params.MIN_COMPLETENESS_PCT} THEN 'sufficient' WHEN completenessPct > 0 THEN 'degraded'
              ELSE 'no_data' END AS verdict, CAST("hour" AS DATE) AS ingestDate
  FROM (SELECT deviceId, "hour", coalesce(n, 0) AS receivedSamples, coalesce(t, 0) AS trustworthySamples,
               least(CAST(100.0 AS DOUBLE),
                     round(coalesce(n, 0) / CAST({b.EXPECTED_PER_HOUR} AS DOUBLE) * 100, 1)) AS completenessPct
        FROM grid LEFT JOIN got USING (deviceId, "hour"))"""), dates=("ingestDate",))
def agg_completeness(spark, sf_dir):
    now = F.lit(b.AS_OF).cast("timestamp")
    return silver.completeness(
        silver_telemetry(spark, sf_dir),
        b.devices(spark, sf_dir),
        expected_per_hour=b.EXPECTED_PER_HOUR,
        start=now - F.expr("interval 72 hours"),
        end=now - F.expr("interval 1 hour"),
    )


@query("agg_telemetry_hourly", sql("SELECT * REPLACE (array_to_string(qualityFlags, ',') AS qualityFlags) FROM hourly"), dates=("ingestDate",))
def agg_telemetry_hourly(spark, sf_dir):
    return hourly(spark, sf_dir).withColumn("qualityFlags", F.array_join("qualityFlags", ","))


def _wq_oracle() -> str:
    stats = []
    for t in params.QUALITY_PARAMETERS:
        g = f"CASE WHEN usable THEN {t} END"
        stats += [f"round(avg({g}), 4) AS {t}", f"round(min({g}), 4) AS {t}_min", f"round(max({g}), 4) AS {t}_max"]
    return f"""
      WITH marked AS (SELECT *, isTrustworthy OR breach AS usable, chlorineSensorFlatline AND NOT breach AS suspect
        FROM (SELECT *, coalesce(chlorineSensorFlatline AND chlorine_mg_l NOT BETWEEN 0.2 AND 4.0, FALSE) AS breach
              FROM silver_wq)),
      h AS (SELECT date_trunc('hour', "timestamp") AS "timestamp", deviceId, siteId, {', '.join(stats)},
                   count(*) AS sampleCount, count(*) FILTER (WHERE usable) AS trustworthyCount,
                   bool_or(chlorineSensorFlatline) AS chlorineSensorFlatline, bool_or(suspect) AS chlorineSensorSuspect
            FROM marked GROUP BY 1, 2, 3)
      SELECT * REPLACE (CASE WHEN NOT chlorineSensorSuspect THEN chlorine_mg_l END AS chlorine_mg_l),
             NOT chlorineSensorSuspect AS isTrustworthy, CAST("timestamp" AS DATE) AS ingestDate FROM h"""


@query("agg_wq_hourly", sql(_wq_oracle()), dates=("ingestDate",))
def agg_wq_hourly(spark, sf_dir):
    return gold.water_quality_hourly(silver_quality(spark, sf_dir))


@query("agg_dma_hourly", sql('SELECT *, CAST("timestamp" AS DATE) AS ingestDate FROM dma_hour'), dates=("ingestDate",))
def agg_dma_hourly(spark, sf_dir):
    return gold.dma_hourly(silver_dma(spark, sf_dir))


@query("agg_nightly_mnf", sql("SELECT * FROM nightly"), dates=("date",))
def agg_nightly_mnf(spark, sf_dir):
    return gold.nightly_flow(gold.dma_hourly(silver_dma(spark, sf_dir)))


@query("win_mnf_baseline", sql("""
  SELECT *, CASE WHEN baselineMnf_m3_h IS NULL THEN 'insufficient_baseline' WHEN excessMnf_m3_h > 5 THEN 'significant'
                 WHEN excessMnf_m3_h > 2 THEN 'confirmed' ELSE 'normal' END AS leakIndication,
         round(greatest(coalesce(excessMnf_m3_h, 0), 0) * 8760, 0) AS annualLossM3
  FROM (SELECT *, round(mnf_m3_h - baselineMnf_m3_h, 3) AS excessMnf_m3_h
        FROM (SELECT *, round(avg(mnf_m3_h) OVER (PARTITION BY dmaId ORDER BY "date" - DATE '1970-01-01'
                        RANGE BETWEEN 90 PRECEDING AND 7 PRECEDING), 3) AS baselineMnf_m3_h FROM nightly))"""), dates=("date",))
def win_mnf_baseline(spark, sf_dir):
    return gold.night_flow_baseline(gold.nightly_flow(gold.dma_hourly(silver_dma(spark, sf_dir))))


@query("prj_energy", sql('SELECT *, CAST("timestamp" AS DATE) AS ingestDate FROM energy'), dates=("ingestDate",))
def prj_energy(spark, sf_dir):
    hours = b.pump_hours(spark, sf_dir).withColumn("assetId", F.lit(None).cast("string"))
    return gold.energy(hours).drop("assetId")


SLOPE = f"""
  SELECT assetId, deviceId, siteId, round(avg(vibration_mm_s), 3) AS meanVibration,
         round(max(vibration_mm_s), 3) AS peakVibration, round(avg(bearing_temp_c), 2) AS meanBearingTemp,
         count(*) AS hoursObserved,
         round(regr_slope(vibration_mm_s, (epoch_us("timestamp") - epoch_us({NOW})) / 86400000000.0), 4) AS vibrationSlopePerDay
  FROM hourly WHERE "timestamp" >= {NOW} - INTERVAL 14 DAY AND vibration_mm_s IS NOT NULL AND isTrustworthy
  GROUP BY 1, 2, 3"""


def slope(spark, sf_dir):
    # One good sample per hour is enough here, or almost every hour of the sparse events would fall out.
    rows = gold.telemetry_hourly(silver_telemetry(spark, sf_dir), expected_per_hour=1)
    return gold.vibration_trend(rows, b.AS_OF)


SLOPE = SLOPE.replace("AND isTrustworthy", "AND trustworthyCount >= 1")


@query("agg_trend_slope", sql(SLOPE))
def agg_trend_slope(spark, sf_dir):
    return slope(spark, sf_dir)


HEALTH = f"""
  WITH slope AS ({SLOPE}),
  z AS (SELECT s.*, ratedPowerKw, isoVibrationBand, assetClass, criticality, ab, bc, cd
        FROM slope s LEFT JOIN assets a ON s.assetId = a.assetId LEFT JOIN zones USING (isoVibrationBand)),
  h AS (SELECT * EXCLUDE (ab, bc, cd),
               CASE WHEN ab IS NULL THEN 'unknown' WHEN peakVibration >= cd THEN 'D' WHEN peakVibration >= bc THEN 'C'
                    WHEN peakVibration >= ab THEN 'B' ELSE 'A' END AS isoZone,
               CASE WHEN ab IS NULL THEN NULL WHEN peakVibration >= bc THEN cd WHEN peakVibration >= ab THEN bc ELSE ab END
                 AS nextZoneBoundary FROM z)
  SELECT *, CASE WHEN vibrationSlopePerDay > 0.001
                 THEN round((nextZoneBoundary - peakVibration) / vibrationSlopePerDay, 0) END AS daysToNextZone,
         CASE WHEN isoZone = 'D' THEN 'act_now' WHEN isoZone = 'C' AND vibrationSlopePerDay > 0.05 THEN 'act_within_7_days'
              WHEN isoZone = 'C' THEN 'plan_within_30_days'
              WHEN isoZone = 'B' AND vibrationSlopePerDay > 0.05 THEN 'monitor_daily' ELSE 'healthy' END AS healthVerdict
  FROM h"""


def health(spark, sf_dir):
    return gold.asset_health(slope(spark, sf_dir), gold.gold_asset(b.assets(spark, sf_dir)), gold.zone_limits(spark))


@query("prj_asset_health", sql(HEALTH))
def prj_asset_health(spark, sf_dir):
    return health(spark, sf_dir)


@query("jn_health_asset", sql(f"""
  WITH slope AS ({SLOPE})
  SELECT s.assetId, peakVibration, ratedPowerKw, isoVibrationBand, assetClass, criticality
  FROM slope s LEFT JOIN assets a ON s.assetId = a.assetId"""))
def jn_health_asset(spark, sf_dir):
    cols = ["assetId", "peakVibration", "ratedPowerKw", "isoVibrationBand", "assetClass", "criticality"]
    return health(spark, sf_dir).select(*cols)


@query("prj_cast_dims", sql("""SELECT siteId, siteName, siteType, region, populationServed, capacityMld,
    CAST(NULL AS VARCHAR) AS criticality FROM sites"""))
def prj_cast_dims(spark, sf_dir):
    return gold.gold_site(b.sites(spark, sf_dir))


@query("prj_iso_band", sql("""SELECT assetId, siteId, assetClass, manufacturer, model, ratedPowerKw, installDate, criticality,
    dutyStandby, isoVibrationBand FROM assets"""), dates=("installDate",))
def prj_iso_band(spark, sf_dir):
    return gold.gold_asset(b.assets(spark, sf_dir))


@query("prj_cert_risk", sql("""SELECT deviceId, replace(deviceType, 'analyzer', 'analyser') AS deviceType,
    replace(status, 'connected', 'online') AS status, certDaysToExpiry AS certDaysRemaining,
    CASE WHEN certDaysToExpiry < 0 THEN 'expired' WHEN certDaysToExpiry <= 7 THEN 'critical'
         WHEN certDaysToExpiry <= 30 THEN 'warning' ELSE 'ok' END AS certRisk FROM devices"""))
def prj_cert_risk(spark, sf_dir):
    rows = gold.gold_edge_device(b.devices(spark, sf_dir), b.AS_OF)
    return rows.select("deviceId", "deviceType", "status", "certDaysRemaining", "certRisk")


@query("prj_heartbeat_age", sql(f"""SELECT deviceId, {NOW} - to_minutes(CAST(minutesSinceLastMessage AS INT))
    AS lastHeartbeatUtc, CAST(minutesSinceLastMessage AS DOUBLE) AS minutesSinceHeartbeat FROM devices"""))
def prj_heartbeat_age(spark, sf_dir):
    rows = gold.gold_edge_device(b.devices(spark, sf_dir), b.AS_OF)
    return rows.select("deviceId", "lastHeartbeatUtc", "minutesSinceHeartbeat")


@query("str_late_flag", sql("""SELECT event_id, date_diff('second', ts, ingestedUtc) AS ingestLagSeconds, isReplay
    FROM arrivals"""))
def str_late_flag(spark, sf_dir):
    from weirflow.streaming.ingest import flag_late

    rows = b._arrivals(spark, sf_dir).select("event_id", F.col("ts").alias("eventTimeUtc"), "enqueuedUtc")
    return flag_late(rows).select("event_id", "ingestLagSeconds", "isReplay")


@query("set_array_except", sql("""SELECT deviceId, "timestamp", len(flags) AS n, array_to_string(flags, ',') AS qualityFlags FROM (
    SELECT deviceId, "timestamp", list_filter([CASE WHEN isFlatline THEN 'suspect_flatline' END, CASE WHEN hadOutOfRange THEN 'suspect_range' END,
                                               CASE WHEN isReplay THEN 'replayed' END], lambda x: x IS NOT NULL) AS flags FROM silver) WHERE len(flags) > 0"""))
def set_array_except(spark, sf_dir):
    """All the flags that a row earned, where its verdict names the gravest only: each is there or NULL, and the NULLs go."""
    tests = {"suspect_flatline": "isFlatline", "suspect_range": "hadOutOfRange", "replayed": "isReplay"}
    every = F.array(*[F.when(F.col(test), flag) for flag, test in tests.items()])
    rows = silver_telemetry(spark, sf_dir).withColumn("flags", F.array_compact(every)).filter(F.size("flags") > 0)
    return rows.select("deviceId", "timestamp", F.size("flags").cast("long").alias("n"), F.array_join("flags", ",").alias("qualityFlags"))
