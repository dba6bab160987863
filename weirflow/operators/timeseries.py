"""Series operators: one row per device and tag for the whole fleet, instead of one call per device."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow import params
from weirflow.functions import ordered, rules
from weirflow.session import local_table

SERIES = ["deviceId", "tag"]


def series(df: DataFrame, ids: list[str], tags: list[str], name: str = "tag") -> DataFrame:
    """Long form: one row per measured value; missing values have no row."""
    return df.unpivot([*ids], tags, name, "value").filter(F.col("value").isNotNull())


def units(spark: SparkSession) -> DataFrame:
    return local_table(spark, params.UNITS, "tag string, unit string")


def tag_catalog(points: DataFrame, unit_table: DataFrame) -> DataFrame:
    """Tags each device really publishes."""
    seen = points.groupBy(*SERIES).agg(F.count("value").alias("samples"))
    return seen.join(unit_table, "tag", "left").na.fill({"unit": ""})  # a fixed list of tags


def downsample(points: DataFrame, max_points: int) -> DataFrame:
    """Every step-th point, so that no series has more than ``max_points``."""
    placed = ordered.with_positions(points, SERIES, "timestamp", ["value"])
    n = F.col("seriesLength")
    step = F.when(n > max_points, F.floor(n / max_points) + 1).otherwise(1)
    return placed.filter((F.col("position") - 1) % step == 0).drop("position", "seriesLength")


def newest_points(points: DataFrame, max_points: int = 5000) -> DataFrame:
    """The newest points of each series, for the hot path.

    A histogram of each series by hour tells from which hour on it has enough; only points from there on are shuffled and ordered, ``max_points`` and those
    of one more hour at most. Points without a time count as the oldest.
    """
    hour = F.coalesce(ordered.time_bucket("timestamp", ordered.HOUR), F.lit(-(1 << 62)))
    counts = points.groupBy(*SERIES, hour.alias("_hour")).agg(F.count(F.lit(1)).alias("_n"))
    newer = F.sum("_n").over(Window.partitionBy(*SERIES).orderBy(F.col("_hour").desc())) - F.col("_n")
    cuts = counts.withColumn("_newer", newer).filter(F.col("_newer") < max_points).groupBy(*[F.col(c).alias(f"_of_{c}") for c in SERIES]).agg(
        F.min("_hour").alias("_cut"))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in SERIES))
    recent = points.join(cuts, same & (hour >= F.col("_cut")), "left_semi")
    return ordered.newest_n(recent, SERIES, [F.col("timestamp").desc(), F.col("value").desc()], max_points)


def _summary(placed: DataFrame, *extra: Column) -> DataFrame:
    half = F.greatest(F.floor(F.col("seriesLength") / 2), F.lit(1))
    return placed.groupBy(*SERIES).agg(
        F.count("value").alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("stdev"),
        F.avg(F.when(F.col("position") <= half, F.col("value"))).alias("_first"),
        F.avg(F.when(F.col("position") > F.col("seriesLength") - half, F.col("value"))).alias("_last"),
        *extra,
    )


def statistics(points: DataFrame) -> DataFrame:
    """Level, spread, 95th percentile by rank and half-to-half trend of each series.

    An ordinary series is shuffled once and ordered twice, by time and by value; a hot one is cut into pieces.
    """

    def rank(n: Column) -> Column:
        return F.greatest(F.floor(n * 0.95), F.lit(1))

    def cold(rows: DataFrame) -> DataFrame:
        every = Window.partitionBy(*SERIES)
        rows = rows.select(
            *SERIES,
            "value",
            F.row_number().over(every.orderBy("timestamp", "value")).alias("position"),
            F.row_number().over(every.orderBy("value")).alias("_place"),
            F.count(F.lit(1)).over(every).alias("seriesLength"),
        )
        at = F.when(F.col("_place") == rank(F.col("seriesLength")), F.col("value"))
        return _summary(rows, F.max(at).alias("p95"))

    def hot(rows: DataFrame) -> DataFrame:
        p95 = ordered.rank_by_bracket(rows, SERIES, "value", rank(F.col("n")), 0.95)
        placed = ordered.positions_in_buckets(rows.select(*SERIES, "timestamp", "value"), SERIES, "timestamp", ["value"])
        return _summary(placed).join(p95.withColumnRenamed("rankValue", "p95"), SERIES)

    first, last = F.col("_first"), F.col("_last")
    rounded = {c: rules.steady(F.col(c), 3) for c in ("min", "max", "mean", "stdev", "p95")}
    return (
        ordered.split_hot(points, SERIES, cold, hot)
        .withColumns(rounded)
        .withColumn("trend", rules.trend(first, last))
        .withColumn("changePercent", F.coalesce(rules.percent(last - first, first, 1), F.lit(0.0)))
        .drop("_first", "_last")
    )


def anomalies(points: DataFrame, *, sigma: float = 3.0, min_samples: int = 8) -> DataFrame:
    """Points beyond ``sigma`` population deviations of their series' mean.

    The statistics are aggregated first and joined back, so that a hot series is not sorted in one task.
    """
    level = points.groupBy(*SERIES).agg(
        F.count("value").alias("_n"), F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_std")
    )
    spread = F.when(F.col("_std") == 0, 1e-9).otherwise(F.col("_std"))
    off = F.col("value") - F.col("_mean")
    return (
        points.join(level.filter(F.col("_n") >= min_samples), SERIES)
        .filter(F.abs(off) > spread * sigma)
        .withColumn("zScore", rules.steady(off / spread, 2))
        .drop("_n", "_mean", "_std")
    )


def peer_compare(points: DataFrame, peers: DataFrame, group: list[str]) -> DataFrame:
    """Each device against the mean of its peers' means; devices without data stay in the list."""
    own = points.groupBy("deviceId").agg(
        rules.steady(F.avg("value"), 3).alias("mean"),
        rules.steady(F.max("value"), 3).alias("max"),
        F.count("value").alias("count"),
    )
    rows = peers.join(own, "deviceId", "left").na.fill(0, ["count"])
    level = rows.groupBy(*group).agg(F.avg("mean").alias("_peers"))
    deviation = rules.percent(F.col("mean") - F.col("_peers"), F.col("_peers"), 1)
    return (
        rows.join(level, group)
        .withColumn("status", F.when(F.col("count") == 0, "no data").otherwise("ok"))
        .withColumn(
            "deviationFromPeersPercent",
            F.when(F.col("mean").isNotNull(), F.coalesce(deviation, F.lit(0.0))),
        )
        .drop("_peers")
    )


def alarm_window(alarms: DataFrame, as_of: Column, hours: float, **criteria: object) -> DataFrame:
    """Alarms of the last hours that meet the criteria, newest first."""
    rows = alarms.filter(rules.within("raisedAt", as_of, hours) & rules.matches(criteria))
    return rows.orderBy(F.col("raisedAt").desc(), "alarmId")


def active_alarms(alarms: DataFrame) -> DataFrame:
    return alarms.groupBy("deviceId").agg(
        F.count(F.lit(1)).alias("alarmCount"), F.count_if(F.col("state") == "active").alias("activeCount")
    )


def data_quality(rows: DataFrame, devices: DataFrame, as_of: Column, *, hours: int, per_hour: int = 1) -> DataFrame:
    """Received against expected samples and staleness of every device, silent ones included."""
    got = rows.filter(rules.within("timestamp", as_of, hours)).groupBy("deviceId").agg(
        F.count(F.lit(1)).alias("receivedSamples"), F.max("timestamp").alias("lastTimestamp")
    )
    expected = hours * per_hour
    stale = F.floor((F.unix_micros(as_of) - F.unix_micros("lastTimestamp")) / 60000000)
    pct = F.col("completenessPercent")
    return (
        devices.select("deviceId")
        .join(got, "deviceId", "left")
        .na.fill(0, ["receivedSamples"])
        .withColumn("expectedSamples", F.lit(expected))
        .withColumn("completenessPercent", rules.steady(F.col("receivedSamples") / expected * 100, 1))
        .withColumn("staleMinutes", stale.cast("double"))
        .withColumn(
            "verdict", F.when(pct >= 95, "healthy").when(pct >= 70, "degraded").otherwise("unreliable")
        )
    )


def gaps(rows: DataFrame, *, longer_than_seconds: int, bucket_seconds: int = ordered.DAY) -> DataFrame:
    """Pauses between samples of a device. Pauses inside a day are found day by day; those that cross days come
    from the first and last sample of each day."""
    day = ordered.time_bucket("timestamp", bucket_seconds)
    placed = rows.select("deviceId", "timestamp", day.alias("_day"))
    inside = Window.partitionBy("deviceId", "_day").orderBy("timestamp")
    within = placed.select("deviceId", F.lag("timestamp").over(inside).alias("gapStart"), F.col("timestamp").alias("gapEnd"))
    ends = placed.groupBy("deviceId", "_day").agg(F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"))
    days = Window.partitionBy("deviceId").orderBy("_day")
    across = ends.select("deviceId", F.lag("_last").over(days).alias("gapStart"), F.col("_first").alias("gapEnd"))
    length = (F.unix_micros("gapEnd") - F.unix_micros("gapStart")) / 1000000
    return within.unionByName(across).withColumn("gapSeconds", length).filter(F.col("gapSeconds") > longer_than_seconds)


def weekly_energy(stats: DataFrame) -> DataFrame:
    """Energy per week at the mean power of each device."""
    return stats.filter(F.col("tag") == "power_kw").select(
        "deviceId",
        F.col("mean").alias("meanKw"),
        F.col("p95").alias("p95Kw"),
        "trend",
        rules.steady(F.col("mean") * 168, 0).alias("kwhPerWeek"),
    )
