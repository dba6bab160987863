"""What an asset is: limits, history, failure modes, spares and place in the plant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow import params
from weirflow.functions import ordered, rules
from weirflow.session import local_table


def list_rows(df: DataFrame, order: list, limit: int | None = None, **criteria: object) -> DataFrame:
    """Filtered listing in a fixed order; the limit comes after the order, so it keeps the right rows."""
    rows = df.filter(rules.matches(criteria)).orderBy(*order)
    return rows if limit is None else rows.limit(limit)


def find(df: DataFrame, wanted: DataFrame, key: str, fallback: str | None = None) -> DataFrame:
    """Rows for a table of ids; an id that is no key may still name the fallback column."""
    ids = wanted.select(F.col("id").alias("_id")).distinct()
    direct = df.join(ids, F.col(key) == F.col("_id"), "left_semi").withColumn("matchedBy", F.lit(key))
    if fallback is None:
        return direct
    unmatched = ids.join(df.select(F.col(key).alias("_id")), "_id", "left_anti")
    other = df.join(unmatched, F.col(fallback) == F.col("_id"), "left_semi").withColumn("matchedBy", F.lit(fallback))
    return direct.unionByName(other)


def failure_library(spark: SparkSession) -> DataFrame:
    """The failure library, its asset classes spelt as the assets' are."""
    library = local_table(spark, params.FAILURE_MODES, params.FAILURE_COLUMNS)
    return library.withColumn("assetClass", rules.canonical(F.col("assetClass")))


def failure_candidates(assets: DataFrame, library: DataFrame) -> DataFrame:
    """Failure modes that each asset's class can have. The library is a fixed list."""
    return assets.select("assetId", "assetClass").join(library, "assetClass")


def vibration_limits(assets: DataFrame, zones: DataFrame) -> DataFrame:
    """Band, zone limits and their reading for each asset."""
    kw = F.coalesce("ratedPowerKw", F.lit(0.0))
    rows = assets.select("assetId", kw.alias("ratedPowerKw"), rules.iso_band(kw).alias("isoVibrationBand"))
    rows = rows.join(zones, "isoVibrationBand")
    ab, bc, cd = (F.format_string("%.1f", c) for c in ("ab", "bc", "cd"))
    return rows.select(
        "assetId",
        "ratedPowerKw",
        "isoVibrationBand",
        "ab",
        "bc",
        "cd",
        F.concat(F.lit("< "), ab, F.lit(" mm/s")).alias("zoneA"),
        F.concat(ab, F.lit("-"), bc, F.lit(" mm/s")).alias("zoneB"),
        F.concat(bc, F.lit("-"), cd, F.lit(" mm/s")).alias("zoneC"),
        F.concat(F.lit("> "), cd, F.lit(" mm/s")).alias("zoneD"),
    )


def _recent_closed(orders: DataFrame, limit: int) -> DataFrame:
    closed = orders.filter(F.col("status").isin("closed", "completed"))
    return ordered.newest_n(closed, ["assetId"], [F.col("completedAt").desc_nulls_last(), F.col("workOrderId")], limit)


def maintenance_history(orders: DataFrame, limit: int = 20) -> DataFrame:
    """Latest closed jobs of each asset: how many, how long it stood still and the most frequent fault."""
    rows = _recent_closed(orders, limit)
    modes = rows.filter(F.col("failureMode").isNotNull()).groupBy("assetId", "failureMode").agg(
        F.count(F.lit(1)).alias("_n")
    )
    # At most ``limit`` modes per asset.
    ranked = modes.groupBy("assetId").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("_minus"), "failureMode"))).alias("_modes")
    )
    named = F.transform("_modes", lambda m: F.concat(m["failureMode"], F.lit(":"), (-m["_minus"]).cast("string")))
    totals = rows.groupBy("assetId").agg(
        F.count(F.lit(1)).alias("jobs"),
        rules.steady(F.sum(F.coalesce("downtimeHours", F.lit(0.0))), 1).alias("totalDowntimeHours"),
        F.max("completedAt").alias("lastCompletedAt"),
    )
    return totals.join(ranked.select("assetId", named.alias("recurringFailureModes")), "assetId", "left")


def spares_shortage(spares: DataFrame) -> DataFrame:
    have, need = F.coalesce("onHand", F.lit(0)), F.coalesce("minStock", F.lit(0))
    return spares.withColumn("shortBy", need - have).filter(F.col("shortBy") > 0)


def asset_tree(assets: DataFrame) -> DataFrame:
    """Site > process area > asset as parent links, one row per node, so that a large site stays spread out."""
    rows = assets.withColumn("processArea", F.coalesce("processArea", F.lit("unassigned")))
    area = F.concat_ws("/", "siteId", "processArea")
    leaves = rows.select(
        F.lit("asset").alias("level"), F.col("assetId").alias("nodeId"), area.alias("parentId"),
        F.lit(0).cast("long").alias("children"), "assetClass", "deviceId", "criticality", "dutyStandby",
    )
    areas = rows.groupBy("siteId", "processArea").agg(F.count(F.lit(1)).alias("children"))
    empty = [F.lit(None).cast("string").alias(c) for c in ("assetClass", "deviceId", "criticality", "dutyStandby")]
    middle = areas.select(F.lit("area").alias("level"), area.alias("nodeId"), F.col("siteId").alias("parentId"),
                          "children", *empty)
    roots = areas.groupBy("siteId").agg(F.count(F.lit(1)).alias("children")).select(
        F.lit("site").alias("level"), F.col("siteId").alias("nodeId"), F.lit(None).cast("string").alias("parentId"),
        "children", *empty)
    return leaves.unionByName(middle).unionByName(roots)


def asset_card(assets: DataFrame, zones: DataFrame, stats: DataFrame, alarms: DataFrame) -> DataFrame:
    """Asset, vibration statistics, zone by the 95th percentile and active alarms in one row."""
    limits = vibration_limits(assets, zones).drop("ratedPowerKw", "zoneA", "zoneB", "zoneC", "zoneD")
    vibration = stats.filter(F.col("tag") == "vibration_mm_s").select("deviceId", "mean", "max", "p95", "trend")
    active = alarms.filter(F.col("state") == "active").groupBy("deviceId").agg(
        F.count(F.lit(1)).alias("activeAlarms")
    )
    zone = rules.iso_zone(F.col("p95"), F.col("ab"), F.col("bc"), F.col("cd"))
    return (
        assets.select("assetId", "deviceId", "assetClass", "ratedPowerKw", "criticality")
        .join(limits, "assetId")
        .join(vibration, "deviceId", "left")
        .join(active, "deviceId", "left")
        .na.fill(0, ["activeAlarms"])
        .withColumn("zone", zone)
        .withColumn(
            "verdict",
            F.when(F.col("zone") == "D", "act now").when(F.col("zone") == "C", "plan intervention")
            .when(F.col("zone") == "unknown", "no data").otherwise("healthy"),
        )
        .drop("ab", "bc", "cd")
    )


def mean_time_between_failures(telemetry: DataFrame, orders: DataFrame) -> DataFrame:
    """Run hours gained per corrective job. The counter is cumulative, so its rise is what counts."""
    run = telemetry.groupBy("deviceId", "assetId").agg((F.max("runHours") - F.min("runHours")).alias("_run"))
    hours = run.groupBy("assetId").agg(F.sum("_run").alias("runHours"))
    jobs = orders.filter(F.col("failureMode").isNotNull()).groupBy("assetId").agg(
        F.count(F.lit(1)).alias("correctiveJobs")
    )
    return hours.join(jobs, "assetId").select(
        "assetId", "runHours", "correctiveJobs",
        rules.steady(F.col("runHours") / F.col("correctiveJobs"), 3).alias("mtbfHours"),
    )

