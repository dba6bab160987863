"""Queries of the series, compliance, network and fleet operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow import params
from weirflow.functions import rules
from weirflow.operators import assets as a
from weirflow.operators import compliance as c
from weirflow.operators import fleet, gold, network
from weirflow.operators import timeseries as ts
from weirflow.plans import bindings as b
from weirflow.plans.oracle_views import NOW, VIEWS, sql, values
from weirflow.plans.registry import query

TAGS = ["vibration_mm_s", "bearing_temp_c", "power_kw", "flow_m3_h"]


def now():
    return F.lit(b.AS_OF).cast("timestamp")


def points(spark, sf_dir):
    return ts.series(b.telemetry(spark, sf_dir), ["timestamp", "deviceId", "siteId"], TAGS)


def readings(spark, sf_dir):
    return ts.series(
        b.water_quality(spark, sf_dir), ["timestamp", "deviceId", "siteId"], params.QUALITY_PARAMETERS, "parameter"
    )


def devices(spark, sf_dir):
    return fleet.canonical_devices(b.devices(spark, sf_dir))


VIEWS["fleet_devices"] = """SELECT * REPLACE (replace(deviceType, 'analyzer', 'analyser') AS deviceType,
    replace(status, 'connected', 'online') AS status) FROM devices"""
VIEWS["units"] = "SELECT * FROM (" + values(params.UNITS) + ") AS t(tag, unit)"
VIEWS["placed"] = """SELECT *, row_number() OVER (PARTITION BY deviceId, tag ORDER BY "timestamp", value) AS position,
    count(*) OVER (PARTITION BY deviceId, tag) AS n FROM series"""
VIEWS["stats"] = """
  SELECT deviceId, tag, n AS "count", round(lo, 3) AS "min", round(hi, 3) AS "max", round(m, 3) AS mean, round(sd, 3) AS stdev,
         round(sorted[greatest(CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT), 1)], 3) AS p95,
         CASE WHEN last - first > abs(first) * CAST(0.05 AS DOUBLE) THEN 'rising'
              WHEN last - first < -abs(first) * CAST(0.05 AS DOUBLE) THEN 'falling' ELSE 'stable' END AS trend,
         CASE WHEN first <> 0 THEN round((last - first) / first * 100, 1) ELSE 0 END AS changePercent
  FROM (SELECT deviceId, tag, count(*) AS n, min(value) AS lo, max(value) AS hi, avg(value) AS m, stddev_pop(value) AS sd,
               list_sort(list(value)) AS sorted, avg(value) FILTER (WHERE position <= greatest(n // 2, 1)) AS first,
               avg(value) FILTER (WHERE position > n - greatest(n // 2, 1)) AS last
        FROM placed GROUP BY deviceId, tag)"""


@query("flt_series", sql(f"""SELECT * FROM series WHERE "timestamp" >= {NOW} - INTERVAL 168 HOUR"""))
def flt_series(spark, sf_dir):
    return points(spark, sf_dir).filter(rules.within("timestamp", now(), 168))


@query("prj_tag_catalog", sql("""SELECT deviceId, tag, count(*) AS samples, coalesce(unit, '') AS unit
    FROM series LEFT JOIN units USING (tag) GROUP BY deviceId, tag, unit"""))
def prj_tag_catalog(spark, sf_dir):
    return ts.tag_catalog(points(spark, sf_dir), ts.units(spark))


@query("win_downsample", sql("""SELECT "timestamp", deviceId, siteId, tag, value FROM placed
    WHERE (position - 1) % (CASE WHEN n > 20 THEN n // 20 + 1 ELSE 1 END) = 0"""))
def win_downsample(spark, sf_dir):
    return ts.downsample(points(spark, sf_dir), 20)


@query("top_hot_path_bound", sql("""SELECT "timestamp", deviceId, siteId, tag, value FROM placed WHERE position > n - 30"""))
def top_hot_path_bound(spark, sf_dir):
    return ts.newest_points(points(spark, sf_dir), 30)


@query("agg_statistics", sql("SELECT * FROM stats"))
def agg_statistics(spark, sf_dir):
    return ts.statistics(points(spark, sf_dir))


@query("win_anomaly", sql("""
  SELECT "timestamp", deviceId, siteId, tag, value, round((value - m) / sd, 2) AS zScore
  FROM (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(*) OVER w AS c
        FROM series WINDOW w AS (PARTITION BY deviceId, tag))
  WHERE c >= 8 AND abs(value - m) > 3 * sd"""))
def win_anomaly(spark, sf_dir):
    return ts.anomalies(points(spark, sf_dir))


@query("agg_peer_compare", sql("""
  WITH own AS (SELECT deviceId, round(avg(value), 3) AS mean, round(max(value), 3) AS "max", count(*) AS n
               FROM series WHERE tag = 'power_kw' GROUP BY 1),
  r AS (SELECT d.deviceId, assetClass, a.siteId, mean, "max", coalesce(n, 0) AS "count"
        FROM assets a JOIN devices d ON a.deviceId = d.deviceId LEFT JOIN own ON own.deviceId = d.deviceId),
  p AS (SELECT assetClass, siteId, avg(mean) AS pm FROM r GROUP BY 1, 2)
  SELECT r.deviceId, r.assetClass, r.siteId, mean, "max", "count",
         CASE WHEN "count" = 0 THEN 'no data' ELSE 'ok' END AS status,
         CASE WHEN mean IS NOT NULL THEN CASE WHEN pm <> 0 THEN round((mean - pm) / pm * 100, 1) ELSE 0 END END
           AS deviationFromPeersPercent
  FROM r JOIN p USING (assetClass, siteId)"""))
def agg_peer_compare(spark, sf_dir):
    peers = gold.pick(b.assets(spark, sf_dir), {"deviceId": "string", "assetClass": "string", "siteId": "string"})
    peers = peers.withColumn("assetClass", rules.canonical(F.col("assetClass")))
    peers = peers.join(b.devices(spark, sf_dir).select("deviceId"), "deviceId", "left_semi")
    power = points(spark, sf_dir).filter("tag = 'power_kw'")
    return ts.peer_compare(power, peers, ["assetClass", "siteId"])


@query("flt_alarms", sql(f"""SELECT * EXCLUDE (assetId) FROM alarms WHERE raisedAt >= {NOW} - INTERVAL 240 HOUR
    AND lower(severity) = 'high'"""))
def flt_alarms(spark, sf_dir):
    return ts.alarm_window(b.alarms(spark, sf_dir), now(), 240, severity="HIGH", siteId=None).drop("assetId")


@query("agg_active_alarms", sql("""SELECT deviceId, count(*) AS alarmCount, count(*) FILTER (WHERE state = 'active')
    AS activeCount FROM alarms GROUP BY 1"""))
def agg_active_alarms(spark, sf_dir):
    return ts.active_alarms(b.alarms(spark, sf_dir))


@query("agg_data_quality", sql(f"""
  SELECT deviceId, receivedSamples, lastTimestamp, expectedSamples, completenessPercent,
         CAST(floor((epoch_us({NOW}) - epoch_us(lastTimestamp)) / 60000000) AS DOUBLE) AS staleMinutes,
         CASE WHEN completenessPercent >= 95 THEN 'healthy' WHEN completenessPercent >= 70 THEN 'degraded' ELSE 'unreliable'
         END AS verdict
  FROM (SELECT deviceId, coalesce(n, 0) AS receivedSamples, lastTimestamp, 72 AS expectedSamples,
               round(coalesce(n, 0) / CAST(72 AS DOUBLE) * 100, 1) AS completenessPercent
        FROM devices LEFT JOIN (SELECT deviceId, count(*) AS n, max("timestamp") AS lastTimestamp FROM telemetry
                                WHERE "timestamp" >= {NOW} - INTERVAL 72 HOUR GROUP BY 1) USING (deviceId))"""))
def agg_data_quality(spark, sf_dir):
    return ts.data_quality(b.telemetry(spark, sf_dir), b.devices(spark, sf_dir), now(), hours=72)


@query("win_gap_list", sql("""
  SELECT deviceId, gapStart, gapEnd, gapSeconds
  FROM (SELECT deviceId, gapStart, "timestamp" AS gapEnd, (epoch_us("timestamp") - epoch_us(gapStart)) / 1000000.0 AS gapSeconds
        FROM (SELECT deviceId, "timestamp", lag("timestamp") OVER (PARTITION BY deviceId ORDER BY "timestamp") AS gapStart
              FROM telemetry)) WHERE gapSeconds > 43200"""))
def win_gap_list(spark, sf_dir):
    return ts.gaps(b.telemetry(spark, sf_dir), longer_than_seconds=43200)


@query("agg_weekly_energy", sql("""SELECT deviceId, mean AS meanKw, p95 AS p95Kw, trend, round(mean * 168, 0) AS kwhPerWeek
    FROM stats WHERE tag = 'power_kw'"""))
def agg_weekly_energy(spark, sf_dir):
    return ts.weekly_energy(ts.statistics(points(spark, sf_dir).filter("tag = 'power_kw'")))


# ---------------------------------------------------------------- water quality

EPA = "SELECT * FROM limits WHERE jurisdiction = 'US-EPA'"
VIEWS["epa"] = EPA
VIEWS["checked"] = """SELECT r.*, e.* EXCLUDE (parameter), coalesce(value < minValue, FALSE) OR coalesce(value > maxValue, FALSE)
    AS isBreach FROM wq_long r JOIN epa e USING (parameter)"""
VIEWS["compliance"] = """
  SELECT siteId, parameter, unit, minValue, maxValue, tier, notificationHours, requiredAction, citation,
         lo AS "min", hi AS "max", m AS mean, coalesce(n, 0) AS samples, coalesce(x, 0) AS breachCount,
         CASE WHEN coalesce(n, 0) = 0 THEN 'no data' WHEN x > 0 THEN 'exceedance' ELSE 'compliant' END AS status
  FROM (SELECT siteId, epa.* FROM sites, epa)
  LEFT JOIN (SELECT siteId, parameter, round(min(value), 3) AS lo, round(max(value), 3) AS hi, round(avg(value), 3) AS m,
                    count(*) AS n, count(*) FILTER (WHERE isBreach) AS x FROM checked GROUP BY 1, 2) USING (siteId, parameter)"""
VIEWS["compliance"] = VIEWS["compliance"].replace("FROM sites, epa", "FROM sites CROSS JOIN epa")


def epa(spark):
    return c.limits_for(c.limit_table(spark))


def window(spark, sf_dir):
    return c.compliance_window(readings(spark, sf_dir), epa(spark), b.sites(spark, sf_dir))


@query("flt_wq_readings", sql("SELECT * FROM wq_long WHERE parameter = 'chlorine_mg_l'"))
def flt_wq_readings(spark, sf_dir):
    return readings(spark, sf_dir).filter("parameter = 'chlorine_mg_l'")


@query("flt_limits", sql("SELECT DISTINCT w.siteId, l.* FROM limits l JOIN wq_long w USING (parameter) WHERE jurisdiction = 'WHO'"))
def flt_limits(spark, sf_dir):
    measured = readings(spark, sf_dir).groupBy("siteId", "parameter").agg(F.count(F.lit(1)).alias("n")).drop("n")
    return measured.join(c.limits_for(c.limit_table(spark), "who"), "parameter")


@query("jn_limits", sql("""SELECT "timestamp", deviceId, siteId, parameter, value, minValue, maxValue, isBreach FROM checked"""))
def jn_limits(spark, sf_dir):
    rows = c.with_limits(readings(spark, sf_dir), epa(spark))
    return rows.select("timestamp", "deviceId", "siteId", "parameter", "value", "minValue", "maxValue", "isBreach")


@query("agg_compliance_window", sql("SELECT * FROM compliance"))
def agg_compliance_window(spark, sf_dir):
    return window(spark, sf_dir)


@query("agg_overall_status", sql("""SELECT siteId, CASE WHEN bool_or(status = 'exceedance') THEN 'exceedance'
    ELSE 'compliant' END AS overallStatus FROM compliance GROUP BY 1"""))
def agg_overall_status(spark, sf_dir):
    return c.overall_status(window(spark, sf_dir))


@query("agg_escalations", sql("""SELECT siteId, parameter, requiredAction AS action, notificationHours AS deadlineHours, citation
    FROM compliance WHERE tier = 1 AND breachCount > 0"""))
def agg_escalations(spark, sf_dir):
    return c.escalations(window(spark, sf_dir))


VIEWS["last_calibration"] = """SELECT * FROM calibrations QUALIFY row_number() OVER (PARTITION BY deviceId, parameter
    ORDER BY calibratedAt DESC) = 1"""


@query("jn_calibration", sql("SELECT deviceId, parameter, calibratedAt, postCalError, result FROM last_calibration"))
def jn_calibration(spark, sf_dir):
    return c.latest_calibration(b.calibrations(spark, sf_dir))


@query("win_sensor_validity", sql("""
  WITH p AS (SELECT *, row_number() OVER (PARTITION BY deviceId, parameter ORDER BY "timestamp", value) AS pos,
                    count(*) OVER (PARTITION BY deviceId, parameter) AS n FROM wq_long),
  f AS (SELECT deviceId, parameter, count(*) AS samples, avg(value) AS m, stddev_pop(value) AS sd, max(value) AS hi,
               max(value) FILTER (WHERE pos = 1) AS first, min(value) FILTER (WHERE pos > n - 6) AS l1,
               max(value) FILTER (WHERE pos > n - 6) AS l2, avg(value) FILTER (WHERE pos > n // 2) AS late,
               avg(value) FILTER (WHERE pos <= n // 2) AS early FROM p WHERE n >= 6 GROUP BY 1, 2),
  g AS (SELECT *, sd < 1e-6 AS flat, l1 = first AND l2 = first AND (first = 0 OR first = hi) AS railed,
               abs(late - early) > 0.5 * CASE WHEN sd = 0 THEN 1 ELSE sd END AS drift FROM f)
  SELECT g.deviceId, g.parameter, samples,
         concat_ws(',', CASE WHEN flat THEN 'flatline' END, CASE WHEN railed THEN 'railed' END,
                   CASE WHEN drift THEN 'drift' END) AS suspectedFaults,
         NOT (flat OR railed) AS isTrusted, round(m, 4) AS mean, round(sd, 5) AS stdev,
         CASE WHEN flat OR railed OR drift THEN 'sensor fault likely' ELSE 'sensor behaving normally' END AS verdict,
         calibratedAt, result
  FROM g LEFT JOIN last_calibration USING (deviceId, parameter)"""))
def win_sensor_validity(spark, sf_dir):
    rows = c.sensor_validity(readings(spark, sf_dir), b.calibrations(spark, sf_dir))
    return rows.withColumn("suspectedFaults", F.array_join("suspectedFaults", ","))


VIEWS["daily"] = """
  SELECT *, "isInvariant" AND breachCount = 0 AS analyserSuspect,
         breachCount = 0 AND NOT ("isInvariant" AND breachCount = 0) AS compliant
  FROM (SELECT siteId, deviceId, "date", sampleCount, round(lo, 4) AS minValue, round(hi, 4) AS maxValue, meanValue, breachCount,
               turbidityMaxNtu, phMin, phMax, sampleCount >= 3 AND hi - lo < 0.5 AS isInvariant,
               substr(sha1(concat_ws('|', 'compliance', siteId, deviceId, CAST("date" AS VARCHAR))), 1, 24) AS id
        FROM (SELECT siteId, deviceId, CAST("timestamp" AS DATE) AS "date", count(chlorine_mg_l) AS sampleCount,
                     min(chlorine_mg_l) AS lo, max(chlorine_mg_l) AS hi, round(avg(chlorine_mg_l), 4) AS meanValue,
                     count(*) FILTER (WHERE chlorine_mg_l < 0.2 OR chlorine_mg_l > 4.0) AS breachCount,
                     round(max(turbidity_ntu), 4) AS turbidityMaxNtu, round(min(ph), 3) AS phMin, round(max(ph), 3) AS phMax
              FROM wq GROUP BY 1, 2, 3) WHERE sampleCount > 0)"""


def daily(spark, sf_dir):
    # The sparse events need a shorter and wider notion of "never moved".
    return c.compliance_daily(b.water_quality(spark, sf_dir), min_samples=3, flat_range=0.5)


@query("agg_compliance_daily", sql("SELECT * FROM daily"), dates=("date",))
def agg_compliance_daily(spark, sf_dir):
    return daily(spark, sf_dir).drop("limitMin", "limitMax", "assessmentNote")


@query("prj_stable_id", sql("SELECT id, siteId, deviceId, \"date\" FROM daily"), dates=("date",))
def prj_stable_id(spark, sf_dir):
    return daily(spark, sf_dir).select("id", "siteId", "deviceId", "date")


@query("win_consecutive_breach", sql("""
  SELECT siteId, deviceId, min("date") AS firstDay, max("date") AS lastDay, count(*) AS breachDays, CAST(sum(breachCount) AS BIGINT) AS breaches
  FROM (SELECT *, "date" - DATE '1970-01-01' - row_number() OVER (PARTITION BY siteId, deviceId ORDER BY "date") AS island
        FROM daily WHERE breachCount > 0) GROUP BY siteId, deviceId, island"""), dates=("firstDay", "lastDay",))
def win_consecutive_breach(spark, sf_dir):
    return c.breach_runs(daily(spark, sf_dir))


# ---------------------------------------------------------------- network

VIEWS["dma_profile"] = """
  SELECT *, CASE WHEN excessMnfM3h <> 0 THEN round(excessMnfM3h / baselineMnfM3h * 100, 1) END AS excessPercent,
         CASE WHEN excessMnfM3h > 0 THEN round(excessMnfM3h * 24, 1) ELSE 0 END AS estimatedLossM3PerDay,
         CASE WHEN excessMnfM3h / baselineMnfM3h > 0.15 THEN 'probable leak' ELSE 'normal' END AS verdict
  FROM (SELECT *, CASE WHEN baselineMnfM3h <> 0 THEN round(currentMnfM3h - baselineMnfM3h, 2) END AS excessMnfM3h
        FROM (SELECT dmaId, round(avg(flow_m3_h) FILTER (WHERE hour("timestamp") BETWEEN 2 AND 4), 2) AS currentMnfM3h,
                     arg_min(baselineMnf_m3_h, "timestamp") AS baselineMnfM3h, round(avg(flow_m3_h), 2) AS meanFlowM3h
              FROM dma GROUP BY 1))"""


def profile(spark, sf_dir):
    return network.dma_profile(b.dma_flow(spark, sf_dir))


@query("agg_dma_profile", sql("SELECT * FROM dma_profile"))
def agg_dma_profile(spark, sf_dir):
    return profile(spark, sf_dir)


@query("win_loss_rank", sql("""
  SELECT dmaId, excessMnfM3h, annualCost, rank() OVER (ORDER BY excessMnfM3h DESC) AS excessRank,
         rank() OVER (ORDER BY annualCost DESC) AS costRank
  FROM (SELECT *, round(estimatedLossM3PerDay * 365 * CAST(0.62 AS DOUBLE), 0) AS annualCost FROM dma_profile
        WHERE excessMnfM3h IS NOT NULL)"""))
def win_loss_rank(spark, sf_dir):
    rows = network.loss_rank(profile(spark, sf_dir), 0.62)
    return rows.select("dmaId", "excessMnfM3h", "annualCost", "excessRank", "costRank")


@query("agg_pressure_drop", sql("""
  WITH p AS (SELECT *, row_number() OVER (PARTITION BY dmaId, sensorId ORDER BY "timestamp", pressure_bar) AS pos,
                    count(*) OVER (PARTITION BY dmaId, sensorId) AS n FROM dma_pressure),
  f AS (SELECT dmaId, sensorId, avg(pressure_bar) FILTER (WHERE pos <= greatest(n // 3, 1)) AS b0,
               avg(pressure_bar) FILTER (WHERE pos > n - greatest(n // 6, 1)) AS r0 FROM p GROUP BY 1, 2),
  d AS (SELECT dmaId, sensorId, round(b0, 3) AS baselineBar, round(r0, 3) AS recentBar, round(b0 - r0, 3) AS dropBar,
               CASE WHEN b0 <> 0 THEN round((b0 - r0) / b0 * 100, 1) ELSE 0 END AS dropPercent FROM f)
  SELECT *, rank() OVER (PARTITION BY dmaId ORDER BY dropBar DESC) AS dropRank,
         first_value(sensorId) OVER (PARTITION BY dmaId ORDER BY dropBar DESC, sensorId) AS likelyNearestSensor FROM d"""))
def agg_pressure_drop(spark, sf_dir):
    return network.pressure_drop(b.dma_pressure(spark, sf_dir))


@query("agg_nrw", sql("""
  SELECT dmaId, periodStart, inputM3, billedM3, round(inputM3 - billedM3, 1) AS nrwM3,
         round((inputM3 - billedM3) / inputM3 * 100, 1) AS nrwPercent, costPerM3,
         round((inputM3 - billedM3) / 30 * 365 * costPerM3, 0) AS annualisedCost
  FROM nrw QUALIFY row_number() OVER (PARTITION BY dmaId ORDER BY periodStart DESC) = 1"""), dates=("periodStart",))
def agg_nrw(spark, sf_dir):
    return network.nrw_latest(b.nrw_monthly(spark, sf_dir))


# ---------------------------------------------------------------- fleet

@query("agg_fleet_summary", sql("""
  WITH s AS (SELECT siteId, status, count(*) AS n FROM fleet_devices GROUP BY 1, 2),
  m AS (SELECT siteId, string_agg(status || '=' || n, ',' ORDER BY status) AS byStatus FROM s GROUP BY 1)
  SELECT d.siteId, count(*) AS totalDevices, any_value(byStatus) AS byStatus,
         count(*) FILTER (WHERE minutesSinceLastMessage > 60) AS staleTelemetry,
         count(*) FILTER (WHERE certDaysToExpiry <= 30) AS certificateRisk,
         round(count(*) FILTER (WHERE status = 'online') * 100 / CAST(count(*) AS DOUBLE), 1) AS healthScore
  FROM fleet_devices d JOIN m ON m.siteId = d.siteId GROUP BY 1"""))
def agg_fleet_summary(spark, sf_dir):
    rows = fleet.fleet_summary(devices(spark, sf_dir), ["siteId"])
    pairs = F.transform(F.map_entries("byStatus"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return rows.withColumn("byStatus", F.array_join(pairs, ","))


@query("agg_fleet_attention", sql("""SELECT siteId, deviceId, minutesSinceLastMessage > 60 AS isStale,
    certDaysToExpiry <= 30 AS isCertificateRisk FROM devices WHERE minutesSinceLastMessage > 60 OR certDaysToExpiry <= 30"""))
def agg_fleet_attention(spark, sf_dir):
    return fleet.needs_attention(devices(spark, sf_dir))


@query("agg_twin_drift", sql("""SELECT deviceId, count(*) AS propertyCount,
    count(*) FILTER (WHERE desiredValue IS DISTINCT FROM reportedValue) AS driftCount FROM twins GROUP BY 1"""))
def agg_twin_drift(spark, sf_dir):
    return fleet.twin_drift(b.twins(spark, sf_dir))


@query("flt_drifted_properties", sql("""SELECT deviceId, moduleId, property, desiredValue AS desired, reportedValue AS reported
    FROM twins WHERE desiredValue IS DISTINCT FROM reportedValue"""))
def flt_drifted_properties(spark, sf_dir):
    return fleet.drifted_properties(b.twins(spark, sf_dir))


@query("agg_connectivity", sql(f"""
  WITH o AS (SELECT deviceId, greatest(epoch_us("timestamp") // 1000000, epoch_us({NOW} - INTERVAL 240 HOUR) // 1000000) AS s,
                    least(epoch_us("timestamp") // 1000000 + coalesce(durationMinutes, 0) * 60, epoch_us({NOW}) // 1000000) AS e
             FROM connectivity WHERE event = 'disconnected' AND "timestamp" <= {NOW}),
  k AS (SELECT * FROM o WHERE e >= s),
  m AS (SELECT *, max(e) OVER (PARTITION BY deviceId ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM k),
  t AS (SELECT deviceId, count(*) AS c, sum(greatest(e - greatest(s, coalesce(pe, s)), 0)) AS down FROM m GROUP BY 1)
  SELECT deviceId, coalesce(c, 0) AS disconnectCount,
         round(100 - least(CAST(100 AS DOUBLE), coalesce(down, 0) / CAST(864000 AS DOUBLE) * 100), 2) AS uptimePercent
  FROM devices LEFT JOIN t USING (deviceId)"""))
def agg_connectivity(spark, sf_dir):
    return fleet.connectivity(b.connectivity(spark, sf_dir), b.devices(spark, sf_dir), now(), hours=240)


@query("agg_cert_expiry", sql("""SELECT deviceId, siteId, status, certDaysToExpiry, certDaysToExpiry <= 14 AS isCritical
    FROM fleet_devices WHERE certDaysToExpiry <= 90"""))
def agg_cert_expiry(spark, sf_dir):
    return fleet.cert_expiry(devices(spark, sf_dir))


@query("agg_rollout", sql("""SELECT *, CASE WHEN appliedCount <> 0
    THEN round(reportedSuccessCount / CAST(appliedCount AS DOUBLE) * 100, 1) END AS successPercent FROM deployments"""))
def agg_rollout(spark, sf_dir):
    return fleet.rollout(b.deployments(spark, sf_dir))


@query("flt_deployments", sql("SELECT * FROM deployments ORDER BY deploymentId LIMIT 50"))
def flt_deployments(spark, sf_dir):
    return a.list_rows(b.deployments(spark, sf_dir), ["deploymentId"], 50)


@query("jn_anti_unseen", sql(f"""SELECT deviceId, siteId, assetId FROM devices WHERE deviceId NOT IN
    (SELECT deviceId FROM telemetry WHERE "timestamp" >= {NOW} - INTERVAL 72 HOUR)"""))
def jn_anti_unseen(spark, sf_dir):
    return fleet.unseen(b.devices(spark, sf_dir), b.telemetry(spark, sf_dir), now(), 72)


DEVICE_COLUMNS = ["deviceId", "siteId", "deviceType", "status", "certDaysToExpiry", "minutesSinceLastMessage"]


@query("flt_devices", sql(f"""SELECT {', '.join(DEVICE_COLUMNS)} FROM fleet_devices
    WHERE status = 'offline' AND deviceType = 'gateway' ORDER BY deviceId LIMIT 50"""))
def flt_devices(spark, sf_dir):
    rows = a.list_rows(devices(spark, sf_dir), ["deviceId"], 50, status="Offline", deviceType="GATEWAY", siteId=None)
    return rows.select(*DEVICE_COLUMNS)


@query("flt_criteria", sql(f"""SELECT {', '.join(DEVICE_COLUMNS)} FROM fleet_devices
    WHERE status IN ('online', 'degraded') AND connectivity = 'cellular'"""))
def flt_criteria(spark, sf_dir):
    wanted = rules.matches({"status": ["online", "degraded"], "connectivity": "Cellular", "siteId": None})
    return devices(spark, sf_dir).filter(wanted).select(*DEVICE_COLUMNS)


@query("get_device", sql(f"""SELECT {', '.join(DEVICE_COLUMNS)} FROM fleet_devices
    WHERE deviceId IN (SELECT deviceId FROM telemetry)"""))
def get_device(spark, sf_dir):
    wanted = b.telemetry(spark, sf_dir).select(F.col("deviceId").alias("id"))
    return a.find(devices(spark, sf_dir), wanted, "deviceId").select(*DEVICE_COLUMNS)
