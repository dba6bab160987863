"""Priorities, costs, crew slots and gated changes of work orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow import params
from weirflow.functions import ordered, rules, text
from weirflow.session import local_table


def priority_matrix(spark: SparkSession) -> DataFrame:
    return local_table(
        spark, params.PRIORITY_MATRIX, "criticality string, consequence string, priority string, targetResponseHours int"
    )


def with_priority(rows: DataFrame, matrix: DataFrame, created: Column) -> DataFrame:
    """Priority, response hours and due time; a pair that the policy does not name gets the lowest."""
    code, hours = params.PRIORITY_DEFAULT
    key = matrix.withColumnsRenamed({"criticality": "_criticality", "consequence": "_consequence"})
    same = (F.lower(rows["criticality"]) == F.col("_criticality")) & (F.lower(rows["consequence"]) == F.col("_consequence"))
    due = created + F.make_dt_interval(hours=F.col("targetResponseHours"))
    return (
        rows.join(key, same, "left")  # nine rows of policy
        .drop("_criticality", "_consequence")
        .na.fill({"priority": code, "targetResponseHours": hours})
        .withColumn("dueBy", due)
    )


def parts_cost(parts: DataFrame, prices: DataFrame) -> DataFrame:
    """Required parts with their price; unknown parts cost nothing and say so."""
    price = prices.groupBy("partNumber").agg(F.min("unitCost").alias("unitCost"))
    return (
        parts.join(price.withColumn("found", F.lit(True)), "partNumber", "left")
        .withColumn("unitCost", F.coalesce("unitCost", F.lit(0.0)))
        .withColumn("found", F.coalesce("found", F.lit(False)))
    )


def cost_estimate(
    proposals: DataFrame,
    priced: DataFrame,
    *,
    labour_rate: float = params.LABOUR_RATE,
    downtime_rate: float = params.DOWNTIME_RATE,
) -> DataFrame:
    """Labour, parts and lost production of each proposal."""
    parts = priced.groupBy("proposalId").agg(
        F.sum("unitCost").alias("_parts"), F.count_if(~F.col("found")).alias("unknownParts")
    )
    labour = F.col("estimatedHours") * labour_rate
    downtime = F.col("downtimeHours") * downtime_rate
    return (
        proposals.join(parts, "proposalId", "left")
        .na.fill(0, ["_parts", "unknownParts"])
        .select(
            "proposalId",
            rules.steady(labour, 2).alias("labourCost"),
            rules.steady(F.col("_parts"), 2).alias("partsCost"),
            rules.steady(downtime, 2).alias("downtimeCost"),
            rules.steady(labour + F.col("_parts") + downtime, 2).alias("totalCost"),
            "unknownParts",
        )
    )


def crew_slots(crews: DataFrame, slots: int = 14) -> DataFrame:
    """The earliest open slots of each site and skill, ``slots`` of them at most."""
    keys = ["siteId", "skill"]
    rows = ordered.newest_n(crews.filter(F.col("availableHours") > 0), keys, [F.col("date"), F.col("crewId")], slots)
    return rows.withColumn("earliest", F.min("date").over(Window.partitionBy(*keys)))


def propose(
    health: DataFrame,
    assets: DataFrame,
    matrix: DataFrame,
    as_of: str,
    *,
    failure_mode: str = "Bearing wear",
    estimated_hours: float = 6.0,
    required_parts: Sequence[str] = (),
    created_by: str = "weirflow/maintenance-planner",
) -> DataFrame:
    """A proposal for every machine in zone C or D. Proposals are never committed by themselves."""
    now = F.lit(as_of).cast("timestamp")
    bad = health.filter(F.col("isoZone").isin("C", "D")).select("assetId", "siteId", "isoZone", "healthVerdict")
    rows = (
        bad.join(assets.select("assetId", "criticality"), "assetId", "left")
        .withColumn("criticality", F.coalesce("criticality", F.lit("high")))
        .withColumn("consequence", F.lit("availability"))
    )
    return with_priority(rows, matrix, now).select(
        F.concat(F.lit("WO-"), F.upper(rules.stable_id(F.lit("proposal"), "assetId", F.lit(as_of), length=8))).alias("workOrderId"),
        "assetId",
        "siteId",
        F.concat(F.lit("Investigate high vibration - "), F.col("assetId")).alias("title"),
        F.concat_ws(" ", F.lit("Vibration zone"), F.concat("isoZone", F.lit(":")), "healthVerdict").alias("description"),
        "priority",
        "targetResponseHours",
        "dueBy",
        F.lit(failure_mode).alias("failureMode"),
        F.lit(estimated_hours).alias("estimatedHours"),
        text.literals(list(required_parts)).alias("requiredParts"),
        now.alias("createdAt"),
        F.lit(created_by).alias("createdBy"),
        F.lit("open").alias("status"),
        F.lit(False).alias("approved"),
    )


def apply_changes(orders: DataFrame, changes: DataFrame, *, writes_enabled: bool) -> DataFrame:
    """Orders after the approved changes; the rest stay proposals. NULL in a change means unchanged.

    A change to an unknown order creates it. Changes are unique per order: the newest ``changedAt`` counts.
    """
    fields = [c for c in changes.columns if c in orders.columns and c != "workOrderId"]
    allowed = changes.filter(F.col("approved") & F.lit(writes_enabled))
    allowed = ordered.latest_by(
        allowed, ["workOrderId"], [F.col("changedAt"), ordered.tie_hash(allowed, ["workOrderId"])]
    )
    new = allowed.select("workOrderId", *[F.col(c).alias(f"_{c}") for c in fields])
    merged = orders.join(new, "workOrderId", "full_outer")
    return merged.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in orders.columns])


def change_report(changes: DataFrame, *, writes_enabled: bool) -> DataFrame:
    committed = F.col("approved") & F.lit(writes_enabled)
    return changes.agg(F.count_if(committed).alias("committed"), F.count_if(~committed).alias("pending"))
