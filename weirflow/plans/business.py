"""Queries of the asset, work-order, rollup and measure operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow import params
from weirflow.operators import assets as a
from weirflow.operators import gold, measures, rollups, silver
from weirflow.operators import timeseries as ts
from weirflow.operators import workorders as wo
from weirflow.plans import bindings as b
from weirflow.plans import medallion as m
from weirflow.plans import tools as t
from weirflow.plans.oracle_views import NOW, VIEWS, sql
from weirflow.plans.registry import query


def asset_table(spark, sf_dir):
    rows = gold.gold_asset(b.assets(spark, sf_dir))
    return rows.join(b.assets(spark, sf_dir).select("assetId", "deviceId", "processArea"), "assetId")


ASSET = ["assetId", "siteId", "assetClass", "criticality", "ratedPowerKw"]


@query("flt_assets", sql(f"""SELECT {', '.join(ASSET)} FROM assets WHERE assetClass = 'pump' AND criticality = 'critical'
    ORDER BY assetId LIMIT 50"""))
def flt_assets(spark, sf_dir):
    rows = a.list_rows(gold.gold_asset(b.assets(spark, sf_dir)), ["assetId"], 50, assetClass="PUMP", criticality="critical")
    return rows.select(*ASSET)


VIEWS["wanted"] = "SELECT DISTINCT deviceId AS id FROM alarms UNION SELECT assetId FROM work_orders WHERE status = 'open'"


@query("get_asset", sql(f"""
  SELECT {', '.join(ASSET)}, 'assetId' AS matchedBy FROM assets WHERE assetId IN (SELECT id FROM wanted)
  UNION ALL
  SELECT {', '.join(ASSET)}, 'deviceId' FROM assets
  WHERE deviceId IN (SELECT id FROM wanted WHERE id NOT IN (SELECT assetId FROM assets))"""))
def get_asset(spark, sf_dir):
    ids = b.alarms(spark, sf_dir).select(F.col("deviceId").alias("id")).unionByName(
        b.work_orders(spark, sf_dir).filter("status = 'open'").select(F.col("assetId").alias("id"))
    )
    return a.find(asset_table(spark, sf_dir), ids, "assetId", "deviceId").select(*ASSET, "matchedBy")


ORDER = ["workOrderId", "assetId", "siteId", "priority", "status", "createdAt"]


@query("flt_work_orders", sql(f"""SELECT {', '.join(ORDER)} FROM work_orders WHERE status = 'open'
    ORDER BY priority, createdAt, workOrderId LIMIT 50"""))
def flt_work_orders(spark, sf_dir):
    rows = a.list_rows(b.work_orders(spark, sf_dir), ["priority", "createdAt", "workOrderId"], 50, status="Open")
    return rows.select(*ORDER)


@query("top_limit", sql(f"""SELECT {', '.join(ORDER)}, costUsd FROM work_orders ORDER BY costUsd DESC, workOrderId LIMIT 100"""))
def top_limit(spark, sf_dir):
    rows = a.list_rows(b.work_orders(spark, sf_dir), [F.col("costUsd").desc(), "workOrderId"], 100)
    return rows.select(*ORDER, "costUsd")


@query("get_work_order", sql(f"""SELECT {', '.join(ORDER)} FROM work_orders
    WHERE workOrderId IN (SELECT 'WO-' || l_orderkey FROM lineitem WHERE l_quantity > 45)"""))
def get_work_order(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem").filter("l_quantity > 45")
    ids = lines.select(F.concat(F.lit("WO-"), F.col("l_orderkey").cast("string")).alias("id"))
    return a.find(b.work_orders(spark, sf_dir), ids, "workOrderId").select(*ORDER)


@query("prj_vibration_limits", sql("""
  SELECT assetId, ratedPowerKw, isoVibrationBand, ab, bc, cd, format('< {:.1f} mm/s', ab) AS zoneA,
         format('{:.1f}-{:.1f} mm/s', ab, bc) AS zoneB, format('{:.1f}-{:.1f} mm/s', bc, cd) AS zoneC,
         format('> {:.1f} mm/s', cd) AS zoneD
  FROM assets JOIN zones USING (isoVibrationBand)"""))
def prj_vibration_limits(spark, sf_dir):
    return a.vibration_limits(b.assets(spark, sf_dir), gold.zone_limits(spark))


@query("flt_failure_modes", sql("SELECT assetId, f.* FROM assets JOIN failure_modes f USING (assetClass) WHERE assetClass = 'pump'"))
def flt_failure_modes(spark, sf_dir):
    pumps = gold.gold_asset(b.assets(spark, sf_dir)).filter("assetClass = 'pump'")
    return a.failure_candidates(pumps, a.failure_library(spark))


@query("jn_failure_match", sql("SELECT assetId, f.* FROM assets JOIN failure_modes f USING (assetClass)"))
def jn_failure_match(spark, sf_dir):
    return a.failure_candidates(gold.gold_asset(b.assets(spark, sf_dir)), a.failure_library(spark))


@query("agg_maintenance_history", sql("""
  WITH r AS (SELECT * FROM work_orders WHERE status IN ('closed', 'completed')
             QUALIFY row_number() OVER (PARTITION BY assetId ORDER BY completedAt DESC NULLS LAST, workOrderId) <= 5),
  k AS (SELECT assetId, failureMode, count(*) AS n FROM r WHERE failureMode IS NOT NULL GROUP BY 1, 2),
  l AS (SELECT assetId, string_agg(failureMode || ':' || n, ',' ORDER BY n DESC, failureMode) AS modes FROM k GROUP BY 1)
  SELECT assetId, count(*) AS jobs, round(sum(coalesce(downtimeHours, 0)), 1) AS totalDowntimeHours,
         max(completedAt) AS lastCompletedAt, coalesce(any_value(modes), '') AS recurringFailureModes
  FROM r LEFT JOIN l USING (assetId) GROUP BY 1"""))
def agg_maintenance_history(spark, sf_dir):
    rows = a.maintenance_history(b.work_orders(spark, sf_dir), 5)
    return rows.withColumn("recurringFailureModes", F.coalesce(F.array_join("recurringFailureModes", ","), F.lit("")))


@query("top_per_group", sql("""SELECT assetId, workOrderId, completedAt FROM work_orders WHERE status = 'closed'
    QUALIFY row_number() OVER (PARTITION BY assetId ORDER BY completedAt DESC NULLS LAST, workOrderId) <= 3"""))
def top_per_group(spark, sf_dir):
    return a._recent_closed(b.work_orders(spark, sf_dir), 3).select("assetId", "workOrderId", "completedAt")


@query("agg_spares_shortage", sql("""SELECT *, coalesce(minStock, 0) - coalesce(onHand, 0) AS shortBy FROM spares
    WHERE coalesce(onHand, 0) < coalesce(minStock, 0)"""))
def agg_spares_shortage(spark, sf_dir):
    return a.spares_shortage(b.spares(spark, sf_dir))


@query("agg_asset_tree", sql("""
  WITH x AS (SELECT *, coalesce(processArea, 'unassigned') AS area FROM assets)
  SELECT 'asset' AS level, assetId AS nodeId, siteId || '/' || area AS parentId, 0 AS children, assetClass, deviceId, criticality,
         dutyStandby FROM x
  UNION ALL SELECT 'area', siteId || '/' || area, siteId, count(*), NULL, NULL, NULL, NULL FROM x GROUP BY siteId, area
  UNION ALL SELECT 'site', siteId, NULL, count(DISTINCT area), NULL, NULL, NULL, NULL FROM x GROUP BY siteId"""))
def agg_asset_tree(spark, sf_dir):
    return a.asset_tree(asset_table(spark, sf_dir))


@query("agg_asset_card", sql("""
  WITH c AS (SELECT a.assetId, a.deviceId, assetClass, ratedPowerKw, criticality, isoVibrationBand, mean, "max", p95, trend,
                    coalesce(n, 0) AS activeAlarms,
                    CASE WHEN p95 IS NULL THEN 'unknown' WHEN p95 >= cd THEN 'D' WHEN p95 >= bc THEN 'C' WHEN p95 >= ab THEN 'B'
                         ELSE 'A' END AS zone
             FROM assets a JOIN zones USING (isoVibrationBand)
             LEFT JOIN (SELECT * FROM stats WHERE tag = 'vibration_mm_s') s ON s.deviceId = a.deviceId
             LEFT JOIN (SELECT deviceId, count(*) AS n FROM alarms WHERE state = 'active' GROUP BY 1) l ON l.deviceId = a.deviceId)
  SELECT *, CASE zone WHEN 'D' THEN 'act now' WHEN 'C' THEN 'plan intervention' WHEN 'unknown' THEN 'no data' ELSE 'healthy'
            END AS verdict FROM c"""))
def agg_asset_card(spark, sf_dir):
    vibration = t.points(spark, sf_dir).filter("tag = 'vibration_mm_s'")
    return a.asset_card(
        asset_table(spark, sf_dir), gold.zone_limits(spark), ts.statistics(vibration), b.alarms(spark, sf_dir)
    )


# ---------------------------------------------------------------- work orders

@query("jn_priority", sql("""
  SELECT workOrderId, o.criticality, o.consequence, coalesce(x.priority, 'P4') AS priority,
         coalesce(hours, 720) AS targetResponseHours, createdAt + to_hours(CAST(coalesce(hours, 720) AS INT)) AS dueBy
  FROM (SELECT workOrderId, createdAt, upper(a.criticality) AS criticality,
               ['safety','compliance','availability','efficiency'][CAST(substr(w.workOrderId, 4) AS BIGINT) % 4 + 1] AS consequence
        FROM work_orders w JOIN assets a ON a.assetId = w.assetId) o
  LEFT JOIN matrix x ON lower(o.criticality) = x.criticality AND lower(o.consequence) = x.consequence"""))
def jn_priority(spark, sf_dir):
    orders = b.work_orders(spark, sf_dir).drop("priority")
    number = F.substring("workOrderId", 4, 20).cast("long")
    rows = orders.join(b.assets(spark, sf_dir).select("assetId", F.upper("criticality").alias("criticality")), "assetId")
    rows = rows.withColumn("consequence", b._pick(number, ["safety", "compliance", "availability", "efficiency"]))
    rows = wo.with_priority(rows, wo.priority_matrix(spark), F.col("createdAt"))
    return rows.select("workOrderId", "criticality", "consequence", "priority", "targetResponseHours", "dueBy")


VIEWS["priced"] = """SELECT proposalId, p.partNumber, coalesce(s.unitCost, 0) AS unitCost, s.partNumber IS NOT NULL AS found
    FROM proposal_parts p LEFT JOIN spares s ON s.partNumber = p.partNumber"""


def priced(spark, sf_dir):
    return wo.parts_cost(b.proposal_parts(spark, sf_dir), b.spares(spark, sf_dir))


@query("jn_parts_cost", sql("SELECT * FROM priced"))
def jn_parts_cost(spark, sf_dir):
    return priced(spark, sf_dir)


@query("agg_cost_estimate", sql("""
  SELECT proposalId, round(estimatedHours * 95, 2) AS labourCost, round(parts, 2) AS partsCost,
         round(downtimeHours * 1200, 2) AS downtimeCost, round(estimatedHours * 95 + parts + downtimeHours * 1200, 2) AS totalCost,
         unknownParts
  FROM proposals JOIN (SELECT proposalId, sum(unitCost) AS parts, count(*) FILTER (WHERE NOT found) AS unknownParts
                       FROM priced GROUP BY 1) USING (proposalId)"""))
def agg_cost_estimate(spark, sf_dir):
    return wo.cost_estimate(b.proposals(spark, sf_dir), priced(spark, sf_dir))


@query("agg_crew_slots", sql("""
  WITH r AS (SELECT * FROM crews WHERE availableHours > 0
             QUALIFY row_number() OVER (PARTITION BY siteId, skill ORDER BY "date", crewId) <= 14)
  SELECT *, min("date") OVER (PARTITION BY siteId, skill) AS earliest FROM r"""), dates=("date", "earliest",))
def agg_crew_slots(spark, sf_dir):
    return wo.crew_slots(b.crews(spark, sf_dir))


VIEWS["health"] = m.HEALTH.strip()


@query("wo_propose", sql(f"""
  SELECT 'WO-' || upper(substr(sha1(concat_ws('|', 'proposal', h.assetId, '{b.AS_OF}')), 1, 8)) AS workOrderId, h.assetId, h.siteId,
         'Investigate high vibration - ' || h.assetId AS title, coalesce(priority, 'P4') AS priority,
         coalesce(hours, 720) AS targetResponseHours, {NOW} + to_hours(CAST(coalesce(hours, 720) AS INT)) AS dueBy,
         concat_ws(' ', 'Vibration zone', isoZone || ':', healthVerdict) AS description, 'P-1,P-2' AS requiredParts,
         {NOW} AS createdAt, 'weirflow/maintenance-planner' AS createdBy,
         'Bearing wear' AS failureMode, CAST(6.0 AS DOUBLE) AS estimatedHours, 'open' AS status, FALSE AS approved
  FROM health h LEFT JOIN assets a ON a.assetId = h.assetId
  LEFT JOIN matrix x ON x.criticality = coalesce(a.criticality, 'high') AND x.consequence = 'availability'
  WHERE isoZone IN ('C', 'D')"""))
def wo_propose(spark, sf_dir):
    assets = gold.gold_asset(b.assets(spark, sf_dir))
    rows = wo.propose(m.health(spark, sf_dir), assets, wo.priority_matrix(spark), b.AS_OF, required_parts=["P-1", "P-2"])
    return rows.withColumn("requiredParts", F.array_join("requiredParts", ","))


def changes(spark, sf_dir):
    """Change requests: one per order that has a discounted line; two in three are approved, some name new orders."""
    key = F.col("l_orderkey") + F.when(F.col("l_linenumber") == 7, 1000000000).otherwise(0)
    return b.table(spark, sf_dir, "lineitem").filter("l_discount >= 0.05").groupBy(key.alias("key")).agg(
        F.max("l_shipdate").cast("timestamp").alias("changedAt")
    ).select(
        F.concat(F.lit("WO-"), F.col("key").cast("string")).alias("workOrderId"),
        F.when(F.col("key") % 2 == 0, "scheduled").alias("status"),
        F.when(F.col("key") % 5 == 0, "P1").alias("priority"),
        (F.col("key") % 3 != 0).alias("approved"),
        "changedAt",
    )


VIEWS["changes"] = """SELECT 'WO-' || key AS workOrderId, CASE WHEN key % 2 = 0 THEN 'scheduled' END AS status,
    CASE WHEN key % 5 = 0 THEN 'P1' END AS priority, key % 3 <> 0 AS approved
    FROM (SELECT DISTINCT l_orderkey + CASE WHEN l_linenumber = 7 THEN 1000000000 ELSE 0 END AS key FROM lineitem
          WHERE l_discount >= 0.05)"""


@query("wo_apply", sql("""
  SELECT coalesce(o.workOrderId, k.workOrderId) AS workOrderId, assetId, coalesce(k.status, o.status) AS status,
         coalesce(k.priority, o.priority) AS priority
  FROM work_orders o FULL JOIN (SELECT * FROM changes WHERE approved) k ON k.workOrderId = o.workOrderId"""))
def wo_apply(spark, sf_dir):
    orders = b.work_orders(spark, sf_dir).select("workOrderId", "assetId", "status", "priority")
    return wo.apply_changes(orders, changes(spark, sf_dir), writes_enabled=True)


@query("wo_change_report", sql("""SELECT count(*) FILTER (WHERE approved) AS committed,
    count(*) FILTER (WHERE NOT approved) AS pending FROM changes"""))
def wo_change_report(spark, sf_dir):
    return wo.change_report(changes(spark, sf_dir), writes_enabled=True)


# ---------------------------------------------------------------- rollups

@query("jn_asset_master", sql("""
  SELECT a.assetId AS id, a.assetId, a.siteId, a.deviceId, siteName, region, d.status AS deviceStatus, certDaysToExpiry,
         coalesce(al.n, 0) AS openAlarmCount, coalesce(w.n, 0) AS openWorkOrderCount
  FROM assets a LEFT JOIN fleet_devices d ON d.deviceId = a.deviceId LEFT JOIN sites s ON s.siteId = a.siteId
  LEFT JOIN (SELECT deviceId, count(*) AS n FROM alarms WHERE state = 'active' GROUP BY 1) al ON al.deviceId = a.deviceId
  LEFT JOIN (SELECT assetId, count(*) AS n FROM work_orders WHERE status IN ('open','in_progress','scheduled') GROUP BY 1) w
    ON w.assetId = a.assetId"""))
def jn_asset_master(spark, sf_dir):
    rows = rollups.asset_master(
        b.assets(spark, sf_dir), t.devices(spark, sf_dir), gold_sites(spark, sf_dir), b.alarms(spark, sf_dir),
        b.work_orders(spark, sf_dir),
    )
    return rows.select(
        "id", "assetId", "siteId", "deviceId", "site.siteName", "site.region",
        F.col("edgeDevice.status").alias("deviceStatus"), "edgeDevice.certDaysToExpiry", "openAlarmCount",
        "openWorkOrderCount",
    )


def gold_sites(spark, sf_dir):
    return gold.gold_site(b.sites(spark, sf_dir))


@query("prj_open_alarms", sql("SELECT alarmId AS id, alarmId, deviceId, severity, state, state = 'active' AS isOpen FROM alarms"))
def prj_open_alarms(spark, sf_dir):
    return rollups.open_alarms(b.alarms(spark, sf_dir)).select("id", "alarmId", "deviceId", "severity", "state", "isOpen")


@query("prj_open_flags", sql("""SELECT workOrderId AS id, workOrderId, status, status IN ('open','in_progress','scheduled') AS isOpen,
    'historical' AS origin FROM work_orders"""))
def prj_open_flags(spark, sf_dir):
    return rollups.open_orders(b.work_orders(spark, sf_dir)).select("id", "workOrderId", "status", "isOpen", "origin")


@query("agg_daily_tag_stats", sql("""
  WITH p AS (SELECT deviceId, siteId, CAST("timestamp" AS DATE) AS "date", tag, count(*) AS n, round(avg(value), 4) AS mean,
                    round(min(value), 4) AS lo, round(max(value), 4) AS hi, round(stddev_pop(value), 4) AS sd
             FROM series GROUP BY 1, 2, 3, 4)
  SELECT substr(sha1(concat_ws('|', 'tsum', deviceId, CAST("date" AS VARCHAR))), 1, 24) AS id, deviceId, siteId, "date",
         max(n) AS observedSamples, 24 AS expectedSamples, round(max(n) * CAST(100.0 AS DOUBLE) / 24, 1) AS completenessPct,
         string_agg(tag, ',' ORDER BY tag) AS tagNames, max(CASE WHEN tag = 'power_kw' THEN mean END) AS powerMean,
         max(CASE WHEN tag = 'power_kw' THEN sd END) AS powerStd, max(CASE WHEN tag = 'flow_m3_h' THEN hi END) AS flowMax,
         max(CASE WHEN tag = 'flow_m3_h' THEN lo END) AS flowMin
  FROM p GROUP BY deviceId, siteId, "date" """), dates=("date",))
def agg_daily_tag_stats(spark, sf_dir):
    rows = rollups.daily_tag_stats(t.points(spark, sf_dir))
    tag = F.col("tags")
    return rows.select(
        "id", "deviceId", "siteId", "date", "observedSamples", "expectedSamples", "completenessPct",
        F.array_join(F.map_keys(tag), ",").alias("tagNames"), tag["power_kw"]["mean"].alias("powerMean"),
        tag["power_kw"]["std"].alias("powerStd"), tag["flow_m3_h"]["max"].alias("flowMax"),
        tag["flow_m3_h"]["min"].alias("flowMin"),
    )


# ---------------------------------------------------------------- measures

@query("msr_mnf", sql("""SELECT dmaId, round(avg(inflow_m3_h) FILTER (WHERE isNightWindow), 4) AS minimumNightFlow
    FROM dma_hour GROUP BY 1"""))
def msr_mnf(spark, sf_dir):
    return measures.minimum_night_flow(gold.dma_hourly(m.silver_dma(spark, sf_dir)), ["dmaId"])


@query("msr_nrw_pct", sql("""SELECT dmaId, round((sum(inputM3) - sum(billedM3)) / sum(inputM3), 8) * 100 AS nrwPercent
    FROM nrw GROUP BY 1"""))
def msr_nrw_pct(spark, sf_dir):
    return measures.non_revenue_water(b.nrw_monthly(spark, sf_dir), ["dmaId"])


@query("msr_sec", sql("SELECT deviceId, round(sum(power_kw) / sum(flow_m3_h), 6) AS specificEnergy FROM pump_hours GROUP BY 1"))
def msr_sec(spark, sf_dir):
    return measures.specific_energy(b.pump_hours(spark, sf_dir), ["deviceId"])


@query("msr_vibration_severity", sql("""
  SELECT assetId, isoVibrationBand, meanVibration, CASE WHEN meanVibration IS NULL THEN 'unknown' WHEN meanVibration >= cd THEN 'D'
         WHEN meanVibration >= bc THEN 'C' WHEN meanVibration >= ab THEN 'B' ELSE 'A' END AS zone
  FROM (SELECT assetId, round(avg(vibration_mm_s), 3) AS meanVibration FROM telemetry GROUP BY 1)
  JOIN assets USING (assetId) JOIN zones USING (isoVibrationBand)"""))
def msr_vibration_severity(spark, sf_dir):
    assets = gold.gold_asset(b.assets(spark, sf_dir))
    return measures.vibration_severity(b.telemetry(spark, sf_dir), assets, gold.zone_limits(spark))


@query("msr_chlorine_compliance", sql("""SELECT siteId, round(count(*) FILTER (WHERE chlorine_mg_l >= 0.5)
    / CAST(count(*) AS DOUBLE) * 100, 4) AS chlorineCompliance FROM silver_wq WHERE isTrustworthy GROUP BY 1"""))
def msr_chlorine_compliance(spark, sf_dir):
    return measures.chlorine_compliance(m.silver_quality(spark, sf_dir), ["siteId"], 0.5)


@query("msr_fleet_availability", sql("""SELECT siteId, round(count(*) FILTER (WHERE status = 'online')
    / CAST(count(*) AS DOUBLE) * 100, 4) AS fleetAvailability FROM fleet_devices GROUP BY 1"""))
def msr_fleet_availability(spark, sf_dir):
    return measures.fleet_availability(t.devices(spark, sf_dir), ["siteId"])


@query("msr_data_completeness", sql(f"""
  SELECT deviceId, round(n / CAST(720 * {b.EXPECTED_PER_HOUR} AS DOUBLE) * 100, 4) AS dataCompleteness
  FROM (SELECT 'DEV-' || c_custkey AS deviceId FROM customer)
  JOIN (SELECT 'DEV-' || c_custkey AS deviceId, count(silver.deviceId) AS n FROM customer
        LEFT JOIN silver ON silver.deviceId = 'DEV-' || c_custkey AND "timestamp" >= TIMESTAMP '2024-01-01'
          AND "timestamp" < {NOW} GROUP BY 1) USING (deviceId)"""))
def msr_data_completeness(spark, sf_dir):
    rows = silver.lookback(m.silver_telemetry(spark, sf_dir), "timestamp", 720, b.AS_OF)
    return measures.data_completeness(rows, b.devices(spark, sf_dir), 720 * b.EXPECTED_PER_HOUR)


@query("msr_mtbf", sql("""
  SELECT assetId, runHours, correctiveJobs, round(runHours / correctiveJobs, 3) AS mtbfHours
  FROM (SELECT assetId, sum(r) AS runHours FROM (SELECT deviceId, assetId, max(runHours) - min(runHours) AS r FROM silver
                                                 GROUP BY 1, 2) GROUP BY 1)
  JOIN (SELECT assetId, count(*) AS correctiveJobs FROM work_orders WHERE failureMode IS NOT NULL GROUP BY 1) USING (assetId)"""))
def msr_mtbf(spark, sf_dir):
    return a.mean_time_between_failures(m.silver_telemetry(spark, sf_dir), b.work_orders(spark, sf_dir))


@query("agg_energy_loss", sql(f"""
  WITH x AS (SELECT *, "timestamp" >= TIMESTAMP '2001-01-01' AS cur FROM energy),
  s AS (SELECT deviceId, siteId, sum(energyKwh) FILTER (WHERE NOT cur) AS pk, sum(volumeM3) FILTER (WHERE NOT cur) AS pv,
               sum(energyKwh) FILTER (WHERE cur) AS ck, sum(volumeM3) FILTER (WHERE cur) AS cv,
               sum(energyKwh * tariffRate) FILTER (WHERE cur) AS cost,
               coalesce(sum(energyKwh) FILTER (WHERE cur AND tariffPeriod = 'peak'), 0) AS peak FROM x GROUP BY 1, 2)
  SELECT deviceId, siteId, round(pk / pv, 5) AS baselineSec, round(ck / cv, 5) AS currentSec, round(cost, 2) AS costUsd,
         round(CASE WHEN pk / pv IS NOT NULL THEN greatest((ck / cv - pk / pv) * cv, 0) * (cost / ck) ELSE 0 END, 2)
           AS efficiencyLossUsd,
         round(peak * (CAST({params.PEAK_RATE} AS DOUBLE) - CAST({params.OFFPEAK_RATE} AS DOUBLE)), 2) AS tariffExposureUsd
  FROM s WHERE ck IS NOT NULL"""))
def agg_energy_loss(spark, sf_dir):
    return measures.energy_loss(
        b.pump_hours(spark, sf_dir), "2001-01-01", peak_rate=params.PEAK_RATE, offpeak_rate=params.OFFPEAK_RATE
    )
