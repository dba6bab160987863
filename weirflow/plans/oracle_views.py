"""The bindings and the shared stages once more, in SQL, for the oracles."""

from __future__ import annotations

import re

from weirflow import params
from weirflow.plans.bindings import AS_OF, EXPECTED_PER_HOUR, MIN_SAMPLES, QUESTION_PHRASES, STD_LIMIT


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    def cell(x: object) -> str:
        if x is None:
            return "CAST(NULL AS DOUBLE)"
        if isinstance(x, float):
            return f"CAST({x} AS DOUBLE)"
        return quoted(x) if isinstance(x, str) else str(x)

    return "VALUES " + ", ".join("(" + ", ".join(cell(x) for x in row) + ")" for row in rows)


def listed(items: list[str]) -> str:
    return "[" + ", ".join(quoted(x) for x in items) + "]"


def _bounded(bounds: dict[str, tuple[float, float]]) -> str:
    cols = ", ".join(f"CASE WHEN {t} BETWEEN {lo} AND {hi} THEN {t} END AS {t}" for t, (lo, hi) in bounds.items())
    bad = " OR ".join(f"coalesce({t} NOT BETWEEN {lo} AND {hi}, FALSE)" for t, (lo, hi) in bounds.items())
    return f"{cols}, ({bad}) AS hadOutOfRange"


def _silver(source: str, bounds: dict, tag: str, flat: str, ids: str, extra: str) -> str:
    return f"""
      SELECT *, CASE WHEN {flat} THEN 'suspect_flatline' WHEN hadOutOfRange THEN 'suspect_range'
                     WHEN isReplay THEN 'replayed' ELSE 'good' END AS qualityFlag,
             NOT {flat} AND NOT hadOutOfRange AS isTrustworthy,
             CAST("timestamp" AS DATE) AS ingestDate
      FROM (SELECT * EXCLUDE (n24, s24), coalesce(n24 >= {MIN_SAMPLES} AND s24 < {STD_LIMIT}, FALSE) AS {flat}
            FROM (SELECT *, count({tag}) OVER w AS n24, stddev_samp({tag}) OVER w AS s24
                  FROM (SELECT "timestamp", {ids}, isReplay, schemaVersion, {extra} {_bounded(bounds)}
                        FROM (SELECT *, row_number() OVER (PARTITION BY deviceId, "timestamp"
                                                           ORDER BY ingestedUtc DESC) AS rn FROM {source}) WHERE rn = 1)
                  WINDOW w AS (PARTITION BY deviceId ORDER BY epoch_us("timestamp") // 1000000
                               RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)))"""


def _hourly_stats() -> str:
    out = []
    for t in params.TELEMETRY_TAGS:
        g = f"CASE WHEN isTrustworthy THEN {t} END"
        out += [f"round(avg({g}), 3) AS {t}", f"round(min({g}), 3) AS {t}_min", f"round(max({g}), 3) AS {t}_max",
                f"round(stddev_samp({g}), 4) AS {t}_std"]
    return ", ".join(out)


_IDS = "'DEV-' || user_id AS deviceId, 'AST-' || user_id AS assetId, 'SITE-' || (user_id % 25) AS siteId"

VIEWS: dict[str, str] = {
    "ev": "SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    "arrivals": f"""
      SELECT event_id, ts, user_id, event_type, value, k, ts + to_seconds(k * 10) AS ingestedUtc,
             k * 10 > {params.REPLAY_LAG_SECONDS} AS isReplay FROM ev
      UNION ALL
      SELECT event_id, ts, user_id, event_type, value + 1, k, ts + to_seconds(k * 10 + 3600), TRUE
      FROM ev WHERE event_id % 7 = 0""",
    "bronze": f"""
      SELECT ts AS "timestamp", ingestedUtc, {_IDS}, isReplay, CASE WHEN k % 2 = 0 THEN '1.1' ELSE '1.0' END AS schemaVersion,
             value * CAST(0.1372904651 AS DOUBLE) AS vibration_mm_s, k * CAST(2.4731957803 AS DOUBLE) - 30 AS bearing_temp_c,
             value * CAST(4.0273918465 AS DOUBLE) AS motor_current_a,
             value * CAST(2.0193847561 AS DOUBLE) + k AS power_kw, k * CAST(3.0128475693 AS DOUBLE) AS flow_m3_h,
             k * CAST(0.4918273645 AS DOUBLE) - 2 AS pressure_bar,
             CASE WHEN event_type <> 'error' THEN value * CAST(0.0203847561 AS DOUBLE) END AS suction_pressure_bar,
             event_id / CAST(100.0 AS DOUBLE) AS runHours
      FROM arrivals""",
    "bronze_wq": f"""
      SELECT ts AS "timestamp", ingestedUtc, {_IDS}, isReplay, CASE WHEN k % 2 = 0 THEN '1.1' ELSE '1.0' END AS schemaVersion,
             CASE WHEN event_type <> 'error' THEN value * CAST(0.0493827165 AS DOUBLE) END AS chlorine_mg_l, k * CAST(0.0201938475 AS DOUBLE) AS turbidity_ntu,
             k * CAST(0.0249182736 AS DOUBLE) + 6 AS ph, value * CAST(20.0182736455 AS DOUBLE) AS conductivity_us_cm,
             value * CAST(0.2518273645 AS DOUBLE) AS temperature_c
      FROM arrivals""",
    "bronze_dma": """
      SELECT ts AS "timestamp", ingestedUtc, 'DMA-' || user_id AS dmaId, value * CAST(1.0183746529 AS DOUBLE) AS inflow_m3_h,
             k * CAST(0.0492837465 AS DOUBLE) AS pressure_bar FROM arrivals""",
    "silver": _silver("bronze", params.TELEMETRY_BOUNDS, "vibration_mm_s", "isFlatline",
                      "deviceId, assetId, siteId", "runHours,"),
    "silver_wq": _silver("bronze_wq", params.QUALITY_BOUNDS, "chlorine_mg_l", "chlorineSensorFlatline",
                         "deviceId, siteId", ""),
    "silver_dma": """
      SELECT "timestamp", dmaId, inflow_m3_h, pressure_bar, hour("timestamp") BETWEEN 2 AND 3 AS isNightWindow,
             CAST("timestamp" AS DATE) AS ingestDate
      FROM (SELECT *, row_number() OVER (PARTITION BY dmaId, "timestamp" ORDER BY ingestedUtc DESC) AS rn FROM bronze_dma)
      WHERE rn = 1""",
    "hourly": f"""
      SELECT *, completenessPct >= {params.MIN_COMPLETENESS_PCT} AS isTrustworthy, CAST("timestamp" AS DATE) AS ingestDate
      FROM (SELECT *, least(CAST(100.0 AS DOUBLE), round(trustworthyCount / CAST({EXPECTED_PER_HOUR} AS DOUBLE) * 100, 1))
                      AS completenessPct
            FROM (SELECT date_trunc('hour', "timestamp") AS "timestamp", deviceId, assetId, siteId, {_hourly_stats()},
                         count(*) AS sampleCount, count(*) FILTER (WHERE isTrustworthy) AS trustworthyCount,
                         max(runHours) AS runHours,
                         list_sort(coalesce(list(DISTINCT qualityFlag) FILTER (WHERE NOT isTrustworthy), [])) AS qualityFlags
                  FROM silver GROUP BY 1, 2, 3, 4))""",
    "dma_hour": """
      SELECT date_trunc('hour', "timestamp") AS "timestamp", dmaId, isNightWindow, round(avg(inflow_m3_h), 3) AS inflow_m3_h,
             round(avg(pressure_bar), 3) AS pressure_bar, count(*) AS sampleCount
      FROM silver_dma GROUP BY 1, 2, 3""",
    "nightly": """
      SELECT dmaId, CAST("timestamp" AS DATE) AS "date", round(avg(inflow_m3_h), 3) AS mnf_m3_h,
             round(avg(pressure_bar), 3) AS nightPressure_bar
      FROM dma_hour WHERE isNightWindow GROUP BY 1, 2""",
    "telemetry": f"""
      SELECT ts AS "timestamp", {_IDS}, CASE WHEN event_type <> 'error' THEN value * CAST(0.1372904651 AS DOUBLE) END AS vibration_mm_s,
             k * CAST(1.0219384756 AS DOUBLE) AS bearing_temp_c, value * CAST(2.0193847561 AS DOUBLE) AS power_kw, k * CAST(3.0128475693 AS DOUBLE) AS flow_m3_h FROM ev""",
    "series": """
      SELECT "timestamp", deviceId, siteId, tag, value FROM telemetry
      UNPIVOT (value FOR tag IN (vibration_mm_s, bearing_temp_c, power_kw, flow_m3_h))""",
    "wq": f"""
      SELECT ts AS "timestamp", {_IDS}, CASE WHEN event_type <> 'error' THEN value * CAST(0.0493827165 AS DOUBLE) END AS chlorine_mg_l,
             k * CAST(0.0201938475 AS DOUBLE) AS turbidity_ntu, k * CAST(0.0249182736 AS DOUBLE) + 6 AS ph,
             value * CAST(20.0182736455 AS DOUBLE) AS conductivity_us_cm, value * CAST(0.2518273645 AS DOUBLE) AS temperature_c FROM ev""",
    "wq_long": """
      SELECT "timestamp", deviceId, siteId, parameter, value FROM wq
      UNPIVOT (value FOR parameter IN (chlorine_mg_l, turbidity_ntu, ph, conductivity_us_cm, temperature_c))""",
    "limits": "SELECT * FROM (" + values(params.REGULATORY_LIMITS) + ") AS t(jurisdiction, parameter, unit, minValue, "
              "maxValue, limitType, tier, notificationHours, requiredAction, citation)",
    "failure_modes": "SELECT * REPLACE (replace(assetClass, 'analyzer', 'analyser') AS assetClass) FROM ("
                     + values(params.FAILURE_MODES) + ") AS t(assetClass, failureMode, signature, detectableVia, "
                     "typicalLeadTimeDays, consequence, recommendedAction)",
    "zones": "SELECT * FROM (" + values(params.ISO_ZONES) + ") AS t(isoVibrationBand, ab, bc, cd, note)",
    "matrix": "SELECT * FROM (" + values(params.PRIORITY_MATRIX) + ") AS t(criticality, consequence, priority, hours)",
    "dma": """
      SELECT ts AS "timestamp", 'DMA-' || user_id AS dmaId, value * CAST(1.0183746529 AS DOUBLE) AS flow_m3_h,
             user_id % 10 + CAST(25.0 AS DOUBLE) AS baselineMnf_m3_h FROM ev""",
    "dma_pressure": """
      SELECT ts AS "timestamp", 'DMA-' || (user_id % 10) AS dmaId, 'SEN-' || user_id AS sensorId,
             k * CAST(0.0201938475 AS DOUBLE) + 2 AS pressure_bar FROM ev""",
    "alarms": f"""
      SELECT 'ALM-' || event_id AS alarmId, {_IDS}, ['critical','high','medium','low'][k % 4 + 1] AS severity,
             event_type || ' alarm' AS title, ['active','acknowledged','cleared'][event_id % 3 + 1] AS state, ts AS raisedAt,
             CASE WHEN event_id % 3 = 2 THEN ts + INTERVAL 6 HOUR END AS clearedAt, 'rule-engine' AS source
      FROM ev WHERE event_type IN ('error', 'purchase')""",
    "connectivity": """
      SELECT 'DEV-' || user_id AS deviceId, 'SITE-' || (user_id % 25) AS siteId,
             CASE WHEN event_type IN ('error','view') THEN 'disconnected' ELSE 'connected' END AS event, ts AS "timestamp",
             CASE WHEN event_type IN ('error','view') THEN k * 6 END AS durationMinutes FROM ev""",
    "calibrations": """
      SELECT 'DEV-' || user_id AS deviceId, ['chlorine_mg_l','turbidity_ntu','ph'][k % 3 + 1] AS parameter, ts AS calibratedAt,
             value / 1000 AS postCalError, CASE WHEN k < 90 THEN 'pass' ELSE 'fail' END AS result
      FROM ev WHERE event_type = 'view'""",
    "sites": """
      SELECT 'SITE-' || n_nationkey AS siteId, n_name AS siteName,
             ['treatment','wastewater','pumping','reservoir','dma'][n_nationkey % 5 + 1] AS siteType, r_name AS region,
             n_nationkey * 1000 AS populationServed, n_nationkey * CAST(1.5 AS DOUBLE) AS capacityMld
      FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "devices": """
      SELECT 'DEV-' || c_custkey AS deviceId, 'SITE-' || c_nationkey AS siteId, 'AST-' || c_custkey AS assetId,
             ['gateway','sensor','analyzer'][c_custkey % 3 + 1] AS deviceType,
             CASE c_mktsegment WHEN 'MACHINERY' THEN 'offline' WHEN 'HOUSEHOLD' THEN 'degraded'
                               WHEN 'FURNITURE' THEN 'connected' ELSE 'online' END AS status,
             '1.4.' || (c_custkey % 5) AS runtimeVersion, CAST(floor(c_acctbal / 10) AS INT) AS certDaysToExpiry,
             c_custkey % 97 AS minutesSinceLastMessage, ['cellular','ethernet'][c_custkey % 2 + 1] AS connectivity,
             'DEP-' || (c_custkey % 10) AS deploymentId FROM customer""",
    "twins": """
      SELECT 'DEV-' || c_custkey AS deviceId, 'telemetryModule' AS moduleId, 'batchSize' AS property,
             CAST(c_nationkey AS VARCHAR) AS desiredValue,
             CASE WHEN c_custkey % 5 = 0 THEN c_nationkey || '0' WHEN c_custkey % 5 <> 1 THEN CAST(c_nationkey AS VARCHAR) END
               AS reportedValue FROM customer
      UNION ALL
      SELECT 'DEV-' || c_custkey, 'edgeAgent', 'samplingSeconds', CASE WHEN c_custkey % 4 <> 0 THEN '60' END,
             CASE WHEN c_custkey % 4 <> 0 THEN '60' END FROM customer""",
    "assets": """
      SELECT 'AST-' || p_partkey AS assetId, 'DEV-' || p_partkey AS deviceId, 'SITE-' || (p_partkey % 25) AS siteId,
             CASE p_type WHEN 'ECONOMY' THEN 'pump' WHEN 'STANDARD' THEN 'blower' WHEN 'LARGE' THEN 'motor'
                         WHEN 'PROMO' THEN 'valve' WHEN 'MEDIUM' THEN 'analyser' ELSE 'flowmeter' END AS assetClass,
             CASE WHEN p_partkey % 5 <> 4 THEN ['intake','filtration','dosing','pumping'][p_partkey % 4 + 1] END AS processArea,
             p_brand AS manufacturer, p_name AS model, p_size * CAST(2.0 AS DOUBLE) AS ratedPowerKw,
             ['critical','high','medium','low'][p_partkey % 4 + 1] AS criticality,
             ['duty','standby'][p_partkey % 2 + 1] AS dutyStandby,
             CAST(DATE '2010-01-01' + CAST(p_partkey % 3650 AS INT) AS DATE) AS installDate,
             CASE WHEN p_size * 2 <= 15 THEN 'small' WHEN p_size * 2 <= 75 THEN 'medium' ELSE 'large' END AS isoVibrationBand
      FROM part""",
    "spares": """
      SELECT 'AST-' || (p_partkey // 2) AS assetId, 'PN-' || p_partkey AS partNumber, p_retailprice AS unitCost,
             CASE WHEN p_partkey % 11 <> 0 THEN p_size % 10 END AS onHand, p_size % 7 AS minStock FROM part""",
    "work_orders": """
      SELECT 'WO-' || o_orderkey AS workOrderId, 'AST-' || o_custkey AS assetId, 'SITE-' || (o_custkey % 25) AS siteId,
             CASE o_orderpriority WHEN '1-URGENT' THEN 'P1' WHEN '2-HIGH' THEN 'P2' WHEN '3-MEDIUM' THEN 'P3' ELSE 'P4' END
               AS priority,
             CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'in_progress' END AS status,
             CASE WHEN o_orderkey % 6 <> 5 THEN ['Bearing wear','Cavitation','Seal failure'][o_orderkey % 3 + 1] END
               AS failureMode,
             o_orderdate AS createdAt,
             CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days(CAST(o_orderkey % 14 AS INT)) END AS completedAt,
             (o_orderkey % 27) * CAST(0.5 AS DOUBLE) AS downtimeHours, 'CREW-' || (o_orderkey % 4) AS crewId,
             o_totalprice AS costUsd FROM orders""",
    "crews": """
      SELECT 'SITE-' || (o_custkey % 25) AS siteId, CAST(o_orderdate AS DATE) AS "date",
             ['mechanical','electrical','instrumentation'][o_orderkey % 3 + 1] AS skill, 'CREW-' || o_orderkey AS crewId,
             [0, 0, 4, 8, 8, 12][o_orderkey % 6 + 1] AS availableHours FROM orders""",
    "proposals": """
      SELECT 'PRP-' || l_orderkey AS proposalId, sum(l_linenumber * CAST(1.0 AS DOUBLE)) AS estimatedHours,
             max(l_quantity) - 10 AS downtimeHours FROM lineitem GROUP BY 1""",
    "proposal_parts": """
      SELECT 'PRP-' || l_orderkey AS proposalId,
             'PN-' || (l_partkey + CASE WHEN l_linenumber = 7 THEN 1000000000 ELSE 0 END) AS partNumber FROM lineitem""",
    "nrw": """
      SELECT 'DMA-' || l_suppkey AS dmaId, CAST(date_trunc('month', l_shipdate) AS DATE) AS periodStart,
             round(sum(l_extendedprice), 4) AS inputM3, round(sum(l_extendedprice * (1 - l_discount)), 4) AS billedM3,
             CAST(0.62 AS DOUBLE) AS costPerM3 FROM lineitem GROUP BY 1, 2""",
    "deployments": """
      SELECT 'DEP-' || s_suppkey AS deploymentId, s_suppkey % 40 AS targetedCount, s_suppkey % 40 AS appliedCount,
             CAST(floor((s_suppkey % 40) * CAST(0.9 AS DOUBLE)) AS BIGINT) AS reportedSuccessCount FROM supplier""",
    "pump_hours": """
      SELECT l_shipdate + to_hours(CAST(l_orderkey % 24 AS INT)) AS "timestamp", 'DEV-' || l_suppkey AS deviceId,
             'SITE-' || (l_suppkey % 25) AS siteId, l_extendedprice * CAST(0.0103719457 AS DOUBLE) AS power_kw, l_quantity AS flow_m3_h FROM lineitem""",
    "energy": f"""
      SELECT *, round(energyKwh / volumeM3, 5) AS specificEnergyKwhM3, round(energyKwh * tariffRate, 4) AS costUsd,
             round(energyKwh * CAST({params.CARBON_KG_PER_KWH} AS DOUBLE), 4) AS carbonKgCo2e
      FROM (SELECT "timestamp", deviceId, siteId, power_kw AS energyKwh, flow_m3_h AS volumeM3, tariffPeriod,
                   CAST(CASE WHEN tariffPeriod = 'peak' THEN {params.PEAK_RATE} ELSE {params.OFFPEAK_RATE} END AS DOUBLE)
                     AS tariffRate
            FROM (SELECT *, CASE WHEN dayofweek("timestamp") BETWEEN 1 AND 5
                                  AND (hour("timestamp") BETWEEN 7 AND 10 OR hour("timestamp") BETWEEN 17 AND 20)
                                 THEN 'peak' ELSE 'offpeak' END AS tariffPeriod FROM pump_hours)
            WHERE power_kw IS NOT NULL AND flow_m3_h > 0)""",
    "knowledge": f"""
      SELECT 'DOC-' || doc_id AS id, split_part(text, chr(10), 1) AS title, source AS docType,
             {listed(params.CLEARANCE)}[doc_id % 4 + 1] AS classification,
             CAST(DATE '2023-01-01' + CAST(doc_id % 700 AS INT) AS DATE) AS effectiveDate,
             CAST(DATE '2024-01-01' + CAST(doc_id % 300 AS INT) AS DATE) AS reviewDate,
             CASE WHEN doc_id % 3 <> 0 THEN [lang] ELSE [] END AS assetClasses, text AS content FROM documents""",
    "questions": f"""
      SELECT 'Q-' || conv_id || '-' || turn AS questionId,
             {listed(QUESTION_PHRASES)}[(conv_id + turn) % {len(QUESTION_PHRASES)} + 1] || ' ' || text AS question
      FROM conversations WHERE role = 'user'""",
    "turns": """
      SELECT 'CNV-' || conv_id AS conversationId, turn, 'USR-' || (conv_id % 20) AS userId, role, text AS content,
             TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS INT)) + to_minutes(CAST(turn AS INT)) AS createdAt
      FROM conversations""",
}

NOW = f"TIMESTAMP '{AS_OF}'"


def steady_rounds(text: str) -> str:
    """Make every ``round(x, n)`` half up in decimal, so that it does not hang on the last bits of a double."""
    out, i = [], 0
    while (at := text.find("round(", i)) >= 0:
        depth, j, comma = 1, at + 6, -1
        while depth:
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(text[j], 0)
            comma = j if text[j] == "," and depth == 1 else comma
            j += 1
        digits = int(text[comma + 1 : j - 1])
        inner = steady_rounds(text[at + 6 : comma])
        out += [text[i:at], f"CAST(round(CAST({inner} AS DECIMAL(38, {digits + 6})), {digits}) AS DOUBLE)"]
        i = j
    return "".join(out) + text[i:]


def sql(body: str) -> str:
    """Prefix the views that ``body`` needs, in dependency order."""
    return steady_rounds(_with_views(body))


def _with_views(body: str) -> str:
    order: list[str] = []

    def visit(text: str, path: tuple[str, ...]) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)\b", text):
            if name in VIEWS and name not in path and name not in order:
                visit(VIEWS[name], (*path, name))
                order.append(name)

    visit(body, ())
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in order)
    if not views:
        return body
    head = "WITH RECURSIVE " if body.lstrip().upper().startswith("RECURSIVE") else "WITH "
    inner = body.strip()
    if inner.upper().startswith("WITH "):
        return f"{head}{views},\n{inner[5:]}"
    return f"{head}{views}\n{inner}"
