"""Referential checks, row counts and SQL over the business tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def relationship_report(tables: dict[str, DataFrame], relationships: list[tuple[str, str, str, str]]) -> DataFrame:
    """Rows and orphans of each declared relationship.

    The child is counted per key first, so a hot key is one row when it meets its parent.
    """

    def check(child: str, child_key: str, parent: str, parent_key: str) -> DataFrame:
        keys = tables[child].filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_key")).agg(
            F.count(F.lit(1)).alias("_n")
        )
        known = tables[parent].select(F.col(parent_key).alias("_key")).distinct().withColumn("_known", F.lit(True))
        rows = keys.join(known, "_key", "left")
        return rows.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("childRows"),
            F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n"))), F.lit(0)).alias("orphanRows"),
        ).select(F.lit(f"{child}.{child_key}->{parent}.{parent_key}").alias("relationship"), "childRows", "orphanRows")

    return _union([check(*r) for r in relationships])


def orphans(register: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Registered ids that nothing uses, and used ids that nobody registered."""
    have = register.select(key).distinct()
    seen = used.select(key).distinct()
    unused = have.join(seen, key, "left_anti").withColumn("problem", F.lit("never_used"))
    unknown = seen.join(have, key, "left_anti").withColumn("problem", F.lit("not_registered"))
    return unused.unionByName(unknown).withColumnRenamed(key, "id")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of all tables in one job."""
    return _union([
        df.agg(F.count(F.lit(1)).alias("rowCount")).select(F.lit(name).alias("tableName"), "rowCount")
        for name, df in tables.items()
    ])


def sql_over(
    spark: SparkSession, tables: dict[str, DataFrame], statement: str, args: dict | None = None, limit: int = 500
) -> DataFrame:
    """A SQL statement over named tables, with bound parameters and a row bound."""
    return spark.sql(statement, args=args, **tables).limit(limit)
