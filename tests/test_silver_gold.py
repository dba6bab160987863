"""Cleaning rules and gold tables on hand-made rows."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weirflow import params
from weirflow.operators import compliance, gold, silver

T0 = datetime(2024, 1, 1)
BRONZE = ("eventTimeUtc timestamp, enqueuedUtc timestamp, deviceId string, assetId string, siteId string, "
          "isReplay boolean, schemaVersion string, measurements map<string,double>")


def bronze(spark, rows):
    """(device, minute, arrival minute, measurements)"""
    return spark.createDataFrame(
        [(T0 + timedelta(minutes=m), T0 + timedelta(minutes=a), d, f"A-{d}", "S", None, None, v) for d, m, a, v in rows], BRONZE
    )


def test_latest_arrival_wins_and_an_older_replay_does_not(spark):
    rows = bronze(spark, [
        ("d", 0, 1, {"power_kw": 1.0}), ("d", 0, 90, {"power_kw": 2.0}), ("d", 0, 5, {"power_kw": 3.0}),
    ])
    (row,) = silver.silver_telemetry(rows).collect()
    assert row.power_kw == 2.0 and row.schemaVersion == "1.0" and row.isReplay is False


def test_out_of_range_is_nulled_flagged_and_kept(spark):
    rows = bronze(spark, [
        ("d", 0, 0, {"vibration_mm_s": 61.0, "power_kw": 5.0}), ("d", 1, 1, {"vibration_mm_s": 60.0}), ("e", 0, 0, {}),
    ])
    got = {(r.deviceId, r.timestamp.minute): r for r in silver.silver_telemetry(rows).collect()}
    assert len(got) == 3
    bad = got[("d", 0)]
    assert bad.vibration_mm_s is None and bad.power_kw == 5.0
    assert bad.qualityFlag == "suspect_range" and not bad.isTrustworthy
    assert got[("d", 1)].qualityFlag == "good" and got[("e", 0)].qualityFlag == "good"


def test_frozen_sensor_is_flagged_from_the_twelfth_sample(spark):
    rows = bronze(spark, [("d", 60 * i, 60 * i, {"vibration_mm_s": 2.5}) for i in range(20)])
    got = silver.silver_telemetry(rows).orderBy("timestamp").collect()
    assert [r.isFlatline for r in got] == [False] * 11 + [True] * 9


def test_unknown_tags_do_not_break_the_schema(spark):
    (row,) = silver.silver_telemetry(bronze(spark, [("d", 0, 0, {"brand_new_tag": 1.0})])).collect()
    assert row.vibration_mm_s is None


def quality_hours(spark, value):
    rows = bronze(spark, [("d", 60 * i, 60 * i, {"chlorine_mg_l": value, "ph": 7.0}) for i in range(72)])
    hours = gold.water_quality_hourly(silver.silver_water_quality(rows))
    return hours.orderBy("timestamp").collect()[-1]


def test_flat_inside_the_limits_hides_the_value(spark):
    last = quality_hours(spark, 0.52)
    assert last.chlorineSensorSuspect and last.chlorine_mg_l is None and not last.isTrustworthy


def test_flat_at_a_breach_stays_visible(spark):
    last = quality_hours(spark, 0.14)
    assert last.chlorineSensorFlatline and not last.chlorineSensorSuspect and last.chlorine_mg_l == 0.14


def test_daily_record_tells_a_dead_analyser_from_an_excursion(spark):
    rows = [("S", d, T0 + timedelta(hours=h), v, 0.1, 7.0) for d, v in (("dead", 0.52), ("real", 0.14)) for h in range(72)]
    df = spark.createDataFrame(
        rows, "siteId string, deviceId string, timestamp timestamp, chlorine_mg_l double, turbidity_ntu double, ph double"
    )
    daily = compliance.compliance_daily(df)
    got = {(r.deviceId, r.date.day): r for r in daily.collect()}
    for day in (1, 2, 3):
        dead, real = got[("dead", day)], got[("real", day)]
        assert dead.analyserSuspect and dead.breachCount == 0 and not dead.compliant
        assert not real.analyserSuspect and real.breachCount == 24 and not real.compliant
    (run,) = compliance.breach_runs(daily).collect()
    assert (run.deviceId, run.breachDays) == ("real", 3)


def test_hourly_counts_what_it_leaves_out(spark):
    rows = bronze(spark, [("d", i, i, {"power_kw": 10.0 if i < 59 else 6000.0}) for i in range(60)])
    (hour,) = gold.telemetry_hourly(silver.silver_telemetry(rows)).collect()
    assert (hour.sampleCount, hour.trustworthyCount, hour.power_kw_max) == (60, 59, 10.0)
    assert hour.qualityFlags == ["suspect_range"] and hour.completenessPct == 98.3 and hour.isTrustworthy


def test_a_missing_or_changed_asset_leaves_one_row_per_device_and_hour(spark):
    rows = silver.silver_telemetry(bronze(spark, [("d", i, i, {"vibration_mm_s": 3.0 + i % 2}) for i in range(4)]))
    minute = F.minute("timestamp")
    rows = rows.withColumn("assetId", F.when(minute == 1, "OLD").when(minute == 2, "NEW"))
    hours = gold.telemetry_hourly(rows, expected_per_hour=4)
    (hour,) = hours.collect()
    assert (hour.assetId, hour.sampleCount) == ("NEW", 4)
    both = hours.unionByName(hours.withColumns({"assetId": F.lit(None).cast("string"), "timestamp": F.expr("timestamp + interval 1 hour")}))
    (trend,) = gold.vibration_trend(both, "2024-01-02 00:00:00").collect()
    assert (trend.assetId, trend.hoursObserved) == ("NEW", 2)


def test_silent_hours_are_in_the_ledger(spark):
    rows = silver.silver_telemetry(bronze(spark, [("d", 0, 0, {"power_kw": 1.0})]))
    devices = spark.createDataFrame([("d",), ("never",)], "deviceId string")
    ledger = silver.completeness(
        rows, devices, start=F.lit("2024-01-01").cast("timestamp"), end=F.lit("2024-01-01 02:00:00").cast("timestamp")
    )
    got = {(r.deviceId, r.hour.hour): r.verdict for r in ledger.collect()}
    assert got == {("d", 0): "degraded", **{("d", h): "no_data" for h in (1, 2)}, **{("never", h): "no_data" for h in range(3)}}


def test_ledger_is_the_whole_grid_and_no_task_makes_it_alone(spark):
    start, end = T0 + timedelta(hours=21), T0 + timedelta(hours=50)
    sent = [("a", 5), ("a", 21), ("a", 21), ("a", 47), ("b", 50), ("b", 51), (None, 30), ("stranger", 30)]
    rows = spark.createDataFrame([(d, T0 + timedelta(hours=h, minutes=i), i % 2 == 0) for i, (d, h) in enumerate(sent)],
                                 "deviceId string, timestamp timestamp, isTrustworthy boolean")
    names = ["a", "b", "b", None, *[f"d{i}" for i in range(40)]]
    devices = spark.createDataFrame([(d,) for d in names], "deviceId string").coalesce(1)
    ledger = silver.completeness(rows, devices, expected_per_hour=2, start=F.lit(start + timedelta(minutes=9)), end=F.lit(end))
    got = ledger.collect()
    want = []
    for d in names:
        for h in range(21, 51):
            own = [i % 2 == 0 for i, x in enumerate(sent) if d is not None and x == (d, h)]
            hour = T0 + timedelta(hours=h)
            pct = min(100.0, len(own) * 50.0)
            want.append((d, hour, len(own), sum(own), 2, pct, "sufficient" if pct >= 80 else "degraded" if pct > 0 else "no_data", hour.date()))
    assert ledger.columns == ["deviceId", "hour", "receivedSamples", "trustworthySamples", "expectedSamples", "completenessPct", "verdict", "ingestDate"]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    plan = ledger._jdf.queryExecution().executedPlan().toString()
    at = plan.rindex("Generate")  # devices are dealt out before they become hours
    assert "Exchange" in plan[at: plan.index("Scan", at)]


def test_night_flow_uses_the_past_without_the_last_week(spark):
    rows = [("rising", T0.date() + timedelta(days=i), 11.5 if i < 30 else 19.2, 3.0) for i in range(36)]
    rows += [("flat", T0.date() + timedelta(days=i), 11.5, 3.0) for i in range(36)]
    df = spark.createDataFrame(rows, "dmaId string, date date, mnf_m3_h double, nightPressure_bar double")
    got = {(r.dmaId, r.date): r for r in gold.night_flow_baseline(df).collect()}
    last = T0.date() + timedelta(days=35)
    assert got[("rising", last)].leakIndication == "significant" and got[("rising", last)].excessMnf_m3_h == 7.7
    assert got[("flat", last)].leakIndication == "normal"
    assert got[("flat", T0.date())].leakIndication == "insufficient_baseline"


@pytest.mark.parametrize("kw,zone", [(15.0, "D"), (75.0, "D"), (76.0, "C")])
def test_vibration_zone_depends_on_rated_power(spark, kw, zone):
    slope = spark.createDataFrame(
        [("A", "D", "S", 7.0, 7.9, 0.0)],
        "assetId string, deviceId string, siteId string, meanVibration double, peakVibration double, vibrationSlopePerDay double",
    )
    assets = gold.gold_asset(spark.createDataFrame([("A", "S", "pump", kw, "high")],
                             "assetId string, siteId string, assetClass string, ratedPowerKw double, criticality string"))
    (row,) = gold.asset_health(slope, assets, gold.zone_limits(spark)).collect()
    assert row.isoZone == zone


def test_one_hour_has_no_slope(spark):
    rows = bronze(spark, [("d", 0, 0, {"vibration_mm_s": 3.0})])
    hours = gold.telemetry_hourly(silver.silver_telemetry(rows), expected_per_hour=1)
    (row,) = gold.vibration_trend(hours, "2024-01-02 00:00:00").collect()
    assert row.vibrationSlopePerDay is None and row.hoursObserved == 1


def test_energy_has_weekday_peaks_and_skips_idle_hours(spark):
    monday = datetime(2024, 1, 1, 8)
    rows = [(monday, 10.0, 5.0), (monday + timedelta(days=5), 10.0, 5.0), (monday, 10.0, 0.0), (monday, None, 5.0)]
    df = spark.createDataFrame([(t, "d", "a", "s", p, f) for t, p, f in rows],
                               "timestamp timestamp, deviceId string, assetId string, siteId string, power_kw double, flow_m3_h double")
    got = sorted((r.tariffPeriod, r.costUsd, r.specificEnergyKwhM3) for r in gold.energy(df).collect())
    assert got == [("offpeak", 1.12, 2.0), ("peak", 2.84, 2.0)]


def test_gold_accepts_other_names_and_missing_columns(spark):
    devices = spark.createDataFrame([("d", "s", "connected", 11, 4320)],
                                    "deviceId string, siteId string, status string, certDaysToExpiry int, minutesSinceLastMessage int")
    (row,) = gold.gold_edge_device(devices, "2024-01-31 00:00:00").collect()
    assert (row.certDaysRemaining, row.certRisk, row.minutesSinceHeartbeat) == (11, "warning", 4320.0)
    assert row.status == "online" and row.runtimeVersion is None


def test_gold_columns_hold_the_ontology(spark):
    from weirflow import schemas
    from weirflow.plans import medallion

    hours = medallion.hourly(spark, "/root/testdata/sf0.001").columns
    assert set(schemas.GOLD_ATTRIBUTES["Telemetry"]) <= set(hours)
    assert set(params.QUALITY_PARAMETERS) <= set(schemas.GOLD_ATTRIBUTES["WaterQuality"])
