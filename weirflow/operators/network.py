"""District areas: night flow, pressure drops and water that nobody pays for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.functions import ordered, rules


def dma_profile(flow: DataFrame, *, night_hours: tuple[int, int] = (2, 4), leak_share: float = 0.15) -> DataFrame:
    """Night flow of each area against its earliest baseline."""
    night = F.hour("timestamp").between(*night_hours)
    rows = flow.groupBy("dmaId").agg(
        rules.steady(F.avg(F.when(night, F.col("flow_m3_h"))), 2).alias("currentMnfM3h"),
        F.min_by("baselineMnf_m3_h", F.struct("timestamp", "baselineMnf_m3_h")).alias("baselineMnfM3h"),
        rules.steady(F.avg("flow_m3_h"), 2).alias("meanFlowM3h"),
    )
    base = F.col("baselineMnfM3h")
    excess = F.col("excessMnfM3h")
    share = F.try_divide(excess, base)
    return (
        rows.withColumn("excessMnfM3h", F.when(base != 0, rules.steady(F.col("currentMnfM3h") - base, 2)))
        .withColumn("excessPercent", F.when(excess != 0, rules.percent(excess, base, 1)))
        .withColumn("estimatedLossM3PerDay", F.when(excess > 0, rules.steady(excess * 24, 1)).otherwise(0.0))
        .withColumn("verdict", F.when(share > leak_share, "probable leak").otherwise("normal"))
    )


def loss_rank(profile: DataFrame, cost_per_m3: float) -> DataFrame:
    """Areas by excess and yearly cost, worst first."""
    cost = rules.steady(F.col("estimatedLossM3PerDay") * 365 * cost_per_m3, 0)
    rows = profile.filter(F.col("excessMnfM3h").isNotNull()).withColumn("annualCost", cost)
    rows = ordered.with_rank(rows, [], "excessMnfM3h", "excessRank")
    return ordered.with_rank(rows, [], "annualCost", "costRank")


def pressure_drop(pressure: DataFrame) -> DataFrame:
    """Earlier against recent pressure of each sensor, and the sensor that is likely nearest to a burst."""
    placed = ordered.with_positions(pressure, ["dmaId", "sensorId"], "timestamp", ["pressure_bar"])
    n, at, value = F.col("seriesLength"), F.col("position"), F.col("pressure_bar")
    first = F.greatest(F.floor(n / 3), F.lit(1))
    last = F.greatest(F.floor(n / 6), F.lit(1))
    rows = placed.groupBy("dmaId", "sensorId").agg(
        F.avg(F.when(at <= first, value)).alias("_base"), F.avg(F.when(at > n - last, value)).alias("_recent")
    )
    drop = F.col("_base") - F.col("_recent")
    rows = rows.select(
        "dmaId",
        "sensorId",
        rules.steady(F.col("_base"), 3).alias("baselineBar"),
        rules.steady(F.col("_recent"), 3).alias("recentBar"),
        rules.steady(drop, 3).alias("dropBar"),
        F.coalesce(rules.percent(drop, F.col("_base"), 1), F.lit(0.0)).alias("dropPercent"),
    )
    nearest = rows.groupBy("dmaId").agg(
        F.min_by("sensorId", F.struct(-F.col("dropBar"), "sensorId")).alias("likelyNearestSensor")
    )
    return ordered.with_rank(rows, ["dmaId"], "dropBar", "dropRank").join(nearest, "dmaId")


def nrw_latest(monthly: DataFrame, *, days: int = 30) -> DataFrame:
    """Loss of the latest month of each area, and what a year of it costs."""
    rows = ordered.latest_by(monthly, ["dmaId"], [F.col("periodStart"), ordered.tie_hash(monthly, ["dmaId"])])
    lost = F.col("inputM3") - F.col("billedM3")
    return rows.select(
        "dmaId",
        "periodStart",
        "inputM3",
        "billedM3",
        rules.steady(lost, 1).alias("nrwM3"),
        rules.percent(lost, F.col("inputM3"), 1).alias("nrwPercent"),
        "costPerM3",
        rules.steady(lost / days * 365 * F.col("costPerM3"), 0).alias("annualisedCost"),
    )
