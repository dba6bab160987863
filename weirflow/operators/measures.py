"""Business measures: ratios are always ratios of sums, never sums or means of ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions import rules


def ratio(top: Column, bottom: Column, digits: int) -> Column:
    return rules.steady(F.try_divide(top, bottom), digits)


def minimum_night_flow(hourly: DataFrame, by: list[str]) -> DataFrame:
    night = F.when(F.col("isNightWindow"), F.col("inflow_m3_h"))
    return hourly.groupBy(*by).agg(rules.steady(F.avg(night), 4).alias("minimumNightFlow"))


def non_revenue_water(monthly: DataFrame, by: list[str]) -> DataFrame:
    lost = F.sum("inputM3") - F.sum("billedM3")
    return monthly.groupBy(*by).agg((ratio(lost, F.sum("inputM3"), 8) * 100).alias("nrwPercent"))


def specific_energy(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(ratio(F.sum("power_kw"), F.sum("flow_m3_h"), 6).alias("specificEnergy"))


def vibration_severity(rows: DataFrame, assets: DataFrame, zones: DataFrame) -> DataFrame:
    mean = rows.groupBy("assetId").agg(rules.steady(F.avg("vibration_mm_s"), 3).alias("meanVibration"))
    zone = rules.iso_zone(F.col("meanVibration"), F.col("ab"), F.col("bc"), F.col("cd"))
    return (
        mean.join(assets.select("assetId", "isoVibrationBand"), "assetId")
        .join(zones, "isoVibrationBand")
        .select("assetId", "isoVibrationBand", "meanVibration", zone.alias("zone"))
    )


def chlorine_compliance(rows: DataFrame, by: list[str], action_level: float) -> DataFrame:
    """Share of trusted hours at or above the action level; a frozen sensor would look perfect."""
    held = F.count_if(F.col("chlorine_mg_l") >= action_level)
    good = rows.filter(F.col("isTrustworthy"))
    return good.groupBy(*by).agg(rules.percent(held, F.count(F.lit(1)), 4).alias("chlorineCompliance"))


def fleet_availability(devices: DataFrame, by: list[str]) -> DataFrame:
    online = F.count_if(F.col("status") == "online")
    return devices.groupBy(*by).agg(rules.percent(online, F.count(F.lit(1)), 4).alias("fleetAvailability"))


def data_completeness(rows: DataFrame, devices: DataFrame, expected: int) -> DataFrame:
    """Received against expected samples of each device. The expectation is a product, so no hour grid is built."""
    got = rows.groupBy("deviceId").agg(F.count(F.lit(1)).alias("_got"))
    share = rules.percent(F.coalesce("_got", F.lit(0)), F.lit(expected), 4)
    return devices.select("deviceId").join(got, "deviceId", "left").select("deviceId", share.alias("dataCompleteness"))


def energy_loss(hours: DataFrame, period_start: str, *, peak_rate: float, offpeak_rate: float) -> DataFrame:
    """Splits the cost of a period in two: wear (more energy per volume than the pump's own past) and timing
    (energy bought at peak). They have different remedies, so they are never blended."""
    now = F.col("timestamp") >= F.lit(period_start).cast("timestamp")
    peak = rules.tariff_period(F.col("timestamp")) == "peak"
    rate = F.when(peak, peak_rate).otherwise(offpeak_rate)
    kwh, m3 = F.col("power_kw"), F.col("flow_m3_h")
    sums = hours.filter(kwh.isNotNull() & (m3 > 0)).groupBy("deviceId", "siteId").agg(
        F.sum(F.when(~now, kwh)).alias("_pastKwh"),
        F.sum(F.when(~now, m3)).alias("_pastM3"),
        F.sum(F.when(now, kwh)).alias("_kwh"),
        F.sum(F.when(now, m3)).alias("_m3"),
        F.sum(F.when(now, kwh * rate)).alias("_cost"),
        F.sum(F.when(now & peak, kwh)).alias("_peakKwh"),
    )
    past, present = F.try_divide("_pastKwh", "_pastM3"), F.try_divide("_kwh", "_m3")
    extra = F.greatest((present - past) * F.col("_m3"), F.lit(0.0)) * F.try_divide("_cost", "_kwh")
    shift = F.coalesce("_peakKwh", F.lit(0.0)) * (peak_rate - offpeak_rate)
    return sums.filter(F.col("_kwh").isNotNull()).select(
        "deviceId",
        "siteId",
        rules.steady(past, 5).alias("baselineSec"),
        rules.steady(present, 5).alias("currentSec"),
        rules.steady(F.col("_cost"), 2).alias("costUsd"),
        rules.steady(F.when(past.isNotNull(), extra).otherwise(0.0), 2).alias("efficiencyLossUsd"),
        rules.steady(shift, 2).alias("tariffExposureUsd"),
    )
