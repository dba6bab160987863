"""Known answers of the series, network, fleet and work-order operators."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weirflow import params
from weirflow.operators import assets, compliance, fleet, measures, network, rollups, timeseries
from weirflow.operators import workorders as wo

T0 = datetime(2024, 1, 1)


def series(spark, values, device="d", tag="t"):
    rows = [(T0 + timedelta(hours=i), device, tag, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "timestamp timestamp, deviceId string, tag string, value double")


def test_statistics_of_a_rising_series(spark):
    (row,) = timeseries.statistics(series(spark, [float(i) for i in range(1, 21)])).collect()
    assert (row["count"], row["min"], row["max"], row["mean"], row.p95, row.trend) == (20, 1.0, 20.0, 10.5, 19.0, "rising")
    assert row.changePercent == 181.8


@pytest.mark.parametrize("values,p95,trend,change", [([5.0], 5.0, "stable", 0.0), ([0.0, 1.0], 0.0, "rising", 0.0)])
def test_statistics_of_short_series(spark, values, p95, trend, change):
    (row,) = timeseries.statistics(series(spark, values)).collect()
    assert (row.p95, row.trend, row.changePercent) == (p95, trend, change)


def test_anomalies_need_eight_points_and_survive_zero_spread(spark):
    points = series(spark, [1.0] * 20 + [50.0]).unionByName(series(spark, [1.0, 9.0], "short")).unionByName(
        series(spark, [3.0] * 9, "still"))
    (row,) = timeseries.anomalies(points).collect()
    assert (row.deviceId, row.value) == ("d", 50.0)


def test_downsample_keeps_every_step(spark):
    got = timeseries.downsample(series(spark, [float(i) for i in range(10)]), 4).orderBy("timestamp").collect()
    assert [r.value for r in got] == [0.0, 3.0, 6.0, 9.0]


def test_gaps_inside_and_across_days(spark):
    times = [T0, T0 + timedelta(hours=2), T0 + timedelta(days=3), T0 + timedelta(days=3, minutes=1)]
    df = spark.createDataFrame([("d", t) for t in times], "deviceId string, timestamp timestamp")
    got = timeseries.gaps(df, longer_than_seconds=3600).orderBy("gapStart").collect()
    assert [(r.gapStart, r.gapEnd, r.gapSeconds) for r in got] == [
        (times[0], times[1], 7200.0), (times[1], times[2], 252000.0)]


def wq(spark, values):
    rows = [(T0 + timedelta(hours=i), "d", "S", "chlorine_mg_l", v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "timestamp timestamp, deviceId string, siteId string, parameter string, value double")


@pytest.fixture(scope="module")
def no_calibration(spark):
    return spark.createDataFrame([], "deviceId string, parameter string, calibratedAt timestamp, result string")


@pytest.mark.parametrize("values,faults,trusted", [
    ([0.52] * 72, ["flatline", "railed"], False),
    ([0.5, 0.6, 0.4, 0.55, 0.45, 0.5, 0.6, 0.4], [], True),
    ([0.6, 0.55, 0.5, 0.4, 0.3, 0.2, 0.17, 0.14], ["drift"], True),
    ([0.0, 0.4, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], ["railed"], False),
])
def test_sensor_faults(spark, no_calibration, values, faults, trusted):
    (row,) = compliance.sensor_validity(wq(spark, values), no_calibration).collect()
    assert [f for f in row.suspectedFaults if f != "drift" or "drift" in faults] == faults
    assert row.isTrusted is trusted


def test_five_samples_are_too_few(spark, no_calibration):
    assert compliance.sensor_validity(wq(spark, [0.5] * 5), no_calibration).count() == 0


def test_compliance_lists_what_was_not_measured(spark):
    sites = spark.createDataFrame([("S",), ("T",)], "siteId string")
    window = compliance.compliance_window(wq(spark, [0.5, 0.19, 0.2]), compliance.limits_for(compliance.limit_table(spark)), sites)
    got = {(r.siteId, r.parameter): (r.status, r.breachCount) for r in window.collect()}
    assert len(got) == 10 and got[("S", "chlorine_mg_l")] == ("exceedance", 1) and got[("T", "ph")] == ("no data", 0)
    assert {r.siteId: r.overallStatus for r in compliance.overall_status(window).collect()} == {"S": "exceedance", "T": "compliant"}


def dma(spark, night):
    rows = [(T0 + timedelta(hours=h), "DMA-14", night if h % 24 in (2, 3, 4) else 40.0, 11.5) for h in range(48)]
    return spark.createDataFrame(rows, "timestamp timestamp, dmaId string, flow_m3_h double, baselineMnf_m3_h double")


@pytest.mark.parametrize("night,verdict,loss", [(19.2, "probable leak", 184.8), (11.5, "normal", 0.0), (13.0, "normal", 36.0)])
def test_night_flow_verdict(spark, night, verdict, loss):
    (row,) = network.dma_profile(dma(spark, night)).collect()
    assert (row.verdict, row.estimatedLossM3PerDay) == (verdict, loss)


def test_nrw_takes_the_latest_month_not_the_last_row(spark):
    rows = [("D", T0.date(), 200.0, 100.0, 0.5), ("D", T0.date() - timedelta(days=31), 900.0, 100.0, 0.5)]
    df = spark.createDataFrame(rows, "dmaId string, periodStart date, inputM3 double, billedM3 double, costPerM3 double")
    (row,) = network.nrw_latest(df).collect()
    assert (row.nrwM3, row.nrwPercent, row.annualisedCost) == (100.0, 50.0, 608.0)


def test_certificates(spark):
    rows = [("zero", 0), ("soon", 11), ("later", 31), ("none", None), ("gone", -3)]
    df = spark.createDataFrame([(d, "S", "online", n) for d, n in rows],
                               "deviceId string, siteId string, status string, certDaysToExpiry int")
    got = [(r.deviceId, r.isCritical) for r in fleet.cert_expiry(df, days_ahead=30).collect()]
    assert got == [("gone", True), ("zero", True), ("soon", True)]


def test_twin_drift_treats_missing_on_both_sides_as_equal(spark):
    props = [("samplingIntervalSeconds", "60", "300"), ("batchSize", "100", "100"), ("upstreamProtocol", None, None),
             ("vibrationThresholdMmS", "4.5", "9.0"), ("retentionHours", "48", "48")]
    df = spark.createDataFrame([("g", "m", p, w, r) for p, w, r in props],
                               "deviceId string, moduleId string, property string, desiredValue string, reportedValue string")
    (row,) = fleet.twin_drift(df).collect()
    assert (row.propertyCount, row.driftCount) == (5, 2)
    assert fleet.drifted_properties(df).count() == 2


def test_uptime_clips_and_merges_outages(spark):
    now = T0 + timedelta(days=10)
    lost = [("out", now - timedelta(hours=72, minutes=5), 4400), ("twice", now - timedelta(hours=10), 60),
            ("twice", now - timedelta(hours=9, minutes=30), 60), ("old", now - timedelta(days=9), 60)]
    events = spark.createDataFrame([(d, "disconnected", t, m) for d, t, m in lost],
                                   "deviceId string, event string, timestamp timestamp, durationMinutes int")
    devices = spark.createDataFrame([(d,) for d in ("out", "twice", "old", "never")], "deviceId string")
    got = {r.deviceId: (r.disconnectCount, r.uptimePercent)
           for r in fleet.connectivity(events, devices, F.lit(now), hours=72).collect()}
    assert got == {"out": (1, 0.0), "twice": (2, round(100 - 90 / 4320 * 100, 2)), "old": (0, 100.0), "never": (0, 100.0)}


@pytest.mark.parametrize("criticality,consequence,priority,hours", [
    ("critical", "availability", "P2", 24), ("CRITICAL", "Safety", "P1", 4), ("low", "safety", "P4", 720), (None, "x", "P4", 720)])
def test_priority(spark, criticality, consequence, priority, hours):
    rows = spark.createDataFrame([(criticality, consequence)], "criticality string, consequence string")
    (row,) = wo.with_priority(rows, wo.priority_matrix(spark), F.lit(T0)).collect()
    assert (row.priority, row.targetResponseHours, row.dueBy) == (priority, hours, T0 + timedelta(hours=hours))


def test_cost_estimate(spark):
    prices = spark.createDataFrame([("BRG", 340.0), ("SEAL", 1250.0)], "partNumber string, unitCost double")
    jobs = spark.createDataFrame([("p", 8.0, 12.0), ("q", 1.0, 0.0)], "proposalId string, estimatedHours double, downtimeHours double")
    parts = spark.createDataFrame([("p", "BRG"), ("p", "SEAL"), ("p", "NOPE")], "proposalId string, partNumber string")
    got = {r.proposalId: r for r in wo.cost_estimate(jobs, wo.parts_cost(parts, prices)).collect()}
    assert (got["p"].labourCost, got["p"].partsCost, got["p"].downtimeCost, got["p"].totalCost) == (760.0, 1590.0, 14400.0, 16750.0)
    assert got["p"].unknownParts == 1 and got["q"].totalCost == 95.0


ORDERS = "workOrderId string, assetId string, status string, priority string"
CHANGES = "workOrderId string, status string, priority string, approved boolean, changedAt timestamp"


def changes(spark):
    return spark.createDataFrame([
        ("w1", "scheduled", None, True, T0), ("w2", "closed", "P1", False, T0), ("w9", "open", "P3", True, T0),
        ("w1", "assigned", None, True, T0 + timedelta(hours=1)),
    ], CHANGES)


def test_only_approved_changes_apply(spark):
    orders = spark.createDataFrame([("w1", "a", "open", "P2"), ("w2", "b", "open", "P4")], ORDERS)
    got = {r.workOrderId: tuple(r)[1:] for r in wo.apply_changes(orders, changes(spark), writes_enabled=True).collect()}
    assert got == {"w1": ("a", "assigned", "P2"), "w2": ("b", "open", "P4"), "w9": (None, "open", "P3")}


def test_nothing_applies_while_writes_are_off(spark):
    orders = spark.createDataFrame([("w1", "a", "open", "P2")], ORDERS)
    got = wo.apply_changes(orders, changes(spark), writes_enabled=False).collect()
    assert [tuple(r) for r in got] == [("w1", "a", "open", "P2")]
    assert tuple(wo.change_report(changes(spark), writes_enabled=False).first()) == (0, 4)


def test_spares_with_missing_numbers(spark):
    df = spark.createDataFrame([("a", None, 2), ("b", 1, None), ("c", 1, 1)], "partNumber string, onHand int, minStock int")
    assert [(r.partNumber, r.shortBy) for r in assets.spares_shortage(df).collect()] == [("a", 2)]


def test_find_falls_back_to_the_device(spark):
    df = spark.createDataFrame([("A1", "D1"), ("A2", "D2")], "assetId string, deviceId string")
    ids = spark.createDataFrame([("A1",), ("D2",), ("D1",), ("zz",), ("A1",)], "id string")
    got = sorted((r.assetId, r.matchedBy) for r in assets.find(df, ids, "assetId", "deviceId").collect())
    assert got == [("A1", "assetId"), ("A1", "deviceId"), ("A2", "deviceId")]


def test_fleet_summary(spark):
    df = spark.createDataFrame([("a", "S", "online", 5, 100), ("b", "S", "offline", 4320, 11), ("c", "S", None, None, None)],
                               "deviceId string, siteId string, status string, minutesSinceLastMessage int, certDaysToExpiry int")
    (row,) = fleet.fleet_summary(df, ["siteId"]).collect()
    assert row.byStatus == {"offline": 1, "online": 1, "unknown": 1} and row.healthScore == 33.3
    assert (row.staleTelemetry, row.certificateRisk) == (1, 1)


def test_measures_do_not_divide_by_zero(spark):
    df = spark.createDataFrame([("d", 5.0, 0.0)], "deviceId string, power_kw double, flow_m3_h double")
    assert measures.specific_energy(df, ["deviceId"]).first().specificEnergy is None


def test_daily_map_holds_every_tag(spark):
    points = series(spark, [1.0, 3.0]).withColumn("siteId", F.lit("S"))
    (row,) = rollups.daily_tag_stats(points).collect()
    assert row.tags["t"].asDict() == {"n": 2, "mean": 2.0, "min": 1.0, "max": 3.0, "std": 1.0}
    assert row.completenessPct == 8.3


def test_efficiency_and_tariff_are_kept_apart(spark):
    past, peak, night = datetime(2023, 6, 5, 3), datetime(2024, 6, 3, 8), datetime(2024, 6, 3, 3)
    rows = [("worn", past, 10.0, 10.0), ("worn", night, 20.0, 10.0), ("late", past, 10.0, 10.0), ("late", peak, 10.0, 10.0)]
    df = spark.createDataFrame([(d, "S", t, p, f) for d, t, p, f in rows],
                               "deviceId string, siteId string, timestamp timestamp, power_kw double, flow_m3_h double")
    got = {r.deviceId: r for r in measures.energy_loss(
        df, "2024-01-01", peak_rate=params.PEAK_RATE, offpeak_rate=params.OFFPEAK_RATE).collect()}
    assert got["worn"].efficiencyLossUsd == 1.12 and got["worn"].tariffExposureUsd == 0.0
    assert got["late"].efficiencyLossUsd == 0.0 and got["late"].tariffExposureUsd == 1.72


def test_newest_points_order_few_of_a_long_series(spark):
    from weirflow.operators import timeseries

    rows = spark.range(20_000).select(
        F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("d"), F.col("id") % 3)).alias("deviceId"), F.lit("t").alias("tag"),
        F.when(F.col("id") % 101 != 0, F.timestamp_seconds(F.col("id") * 60)).alias("timestamp"), (F.col("id") % 7).cast("double").alias("value"))
    got = timeseries.newest_points(rows, 50)
    data: dict = {}
    for r in rows.collect():
        data.setdefault(r.deviceId, []).append((r.timestamp is not None, r.timestamp, r.value))
    want = sorted(str((k, x[1:])) for k, v in data.items() for x in sorted(v, key=lambda x: (x[0], str(x[1]), x[2]))[-50:])
    assert sorted(str((r.deviceId, (r.timestamp, r.value))) for r in got.collect()) == want
    assert timeseries.newest_points(rows.limit(30), 50).count() == 30
