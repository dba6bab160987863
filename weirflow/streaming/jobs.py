"""Streaming jobs: routed bronze, hot table, late-proof silver, hourly table with its late rows, alarms and silent devices.

Sinks are files in the shared folder. Each job may be restarted at any point: bronze tables are append-only and keep Spark's own log of what is committed;
elsewhere a repeated micro-batch overwrites its own partitions or merges to the same rows. Merged tables lie in key buckets, so that a
micro-batch rewrites the buckets of its devices and no others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weirflow import params, schemas
from weirflow.functions import ordered, rules
from weirflow.operators import gold, silver
from weirflow.session import delete_dir, local_table, path_exists, subfolders
from weirflow.sources.writers import expire, read_table, upsert
from weirflow.streaming.ingest import DEAD_LETTERS, ROUTES, ahead, to_bronze

FLUSH = "120 seconds"
#: Key buckets of a day in the tables that streams merge into.
BUCKETS = 16


def start(
    stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, *, mode: str = "append", once: bool = False
) -> StreamingQuery:
    """Run ``batch`` on every micro-batch; ``once`` takes what is there and stops."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": FLUSH}
    return writer.trigger(**trigger).start()


def replace_batch(batch: DataFrame, number: int, path: str, *partitions: str) -> None:
    """Append a micro-batch so that a repeat of it replaces itself: query and batch number are a partition.

    The query's id comes from its checkpoint. A query that starts over with a new checkpoint counts from zero
    again, but under a new id, and cannot replace what an earlier one wrote.
    """
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
    rows = batch.withColumn("batchId", F.lit(f"{query}-{number}"))
    rows = rows.hint("rebalance", *partitions) if partitions else rows
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions, "batchId").parquet(path)


#: The tables that messages are routed to.
TARGETS = [*dict.fromkeys(ROUTES.values()), DEAD_LETTERS]


def start_bronze(
    messages: DataFrame, lake: str, checkpoint: str, *, targets: list[str] | None = None, once: bool = False
) -> list[StreamingQuery]:
    """Append each route's rows to its own table ``lake/<target>/ingestDate=``, which the batch job reads as it is.

    Every target is a query with a checkpoint of its own, so a slow or broken table holds up no other. The file sink's log makes each micro-batch
    count once. That log belongs to one checkpoint: a new one would count from zero, and its batches would be taken for repeats, so it is refused.
    """
    spark, rows, queries = messages.sparkSession, to_bronze(messages), []
    for target in targets or TARGETS:
        path, own = f"{lake.rstrip('/')}/{target}", f"{checkpoint.rstrip('/')}/{target}"
        if path_exists(spark, f"{path}/_spark_metadata") and not path_exists(spark, own):
            raise ValueError(f"{path} is written by a stream with another checkpoint than {own}")
        sink = rows.filter(F.col("target") == target).drop("target").hint("rebalance", "ingestDate").writeStream.format("parquet").partitionBy("ingestDate")
        trigger = {"availableNow": True} if once else {"processingTime": FLUSH}
        queries.append(sink.option("path", path).option("checkpointLocation", own).trigger(**trigger).start())
    return queries


def bronze_table(spark: SparkSession, lake: str, target: str) -> DataFrame:
    """A bronze table, empty where nothing was routed to it yet."""
    schema = to_bronze(spark.createDataFrame([], schemas.ENVELOPE)).drop("target").schema
    return spark.read.schema(schema).parquet(f"{lake.rstrip('/')}/{target}")


def serve_hot(hot_path: str, keep_days: int = 90) -> Callable[[DataFrame, int], None]:
    """Routed rows to a hot table of telemetry that retains ``keep_days``. The clock is the hub's: the newest arrival of the
    batch, never an event's own time. A repeated batch replaces itself, and all of a day's folders go with the day."""

    def serve(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            today = batch.agg(F.to_date(F.max("enqueuedUtc"))).first()[0]
            hot = batch.filter(F.col("target") == "bronze_telemetry").drop("target")
            if today is not None:
                hot = hot.filter(F.col("ingestDate") > F.date_sub(F.lit(today), keep_days))
            replace_batch(hot, number, hot_path, "ingestDate")
            if today is not None:
                expire(batch.sparkSession, hot_path, "ingestDate", str(today), keep_days - 1)
        finally:
            batch.unpersist()

    return serve


def recent(hot: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """The last days of the hot table, which are worth caching; a view, as the table itself keeps more."""
    today = F.to_date(F.lit(as_of))
    return hot.filter((F.col("ingestDate") > F.date_sub(today, days)) & (F.col("ingestDate") <= today))


def merge_latest(
    spark: SparkSession, path: str, keys: list[str], arrival: str = "ingestedUtc", buckets: int = BUCKETS
) -> Callable[[DataFrame, int], None]:
    """Keep the latest arrival of each key, over batches and reruns. Built-in stream dedup keeps the first. A day's rows lie in ``buckets`` folders by the
    first key, the device or area."""

    def merge(batch: DataFrame, number: int) -> None:
        upsert(spark, batch, path, keys, partition="ingestDate", order=arrival, buckets=buckets, bucket_by=keys[:1])

    return merge


def clean_telemetry(bronze: DataFrame) -> DataFrame:
    """Row-local part of the silver step."""
    rows = silver.flatten(bronze, params.TELEMETRY_TAGS, ["deviceId", "assetId", "siteId"], ["runHours"])
    return silver.apply_bounds(rows, params.TELEMETRY_BOUNDS).withColumn("ingestDate", F.to_date("timestamp"))


def clean_quality(bronze: DataFrame) -> DataFrame:
    """Row-local part of the silver step for water quality."""
    rows = silver.flatten(bronze, params.QUALITY_PARAMETERS, ["deviceId", "siteId"])
    return silver.apply_bounds(rows, params.QUALITY_BOUNDS).withColumn("ingestDate", F.to_date("timestamp"))


def clean_dma(bronze: DataFrame) -> DataFrame:
    """The silver step for area flows; all of it is row-local but the merge by key."""
    return silver.night_window(silver.flatten_dma(bronze)).withColumn("ingestDate", F.to_date("timestamp"))


def refresh_silver(
    spark: SparkSession,
    clean_path: str,
    silver_path: str,
    as_of: str,
    *,
    hours: int = 72,
    min_samples: int = params.FLATLINE_MIN_SAMPLES,
    std_limit: float = params.FLATLINE_STD,
    watched: str = "vibration_mm_s",
    flat_name: str = "isFlatline",
    buckets: int = BUCKETS,
) -> None:
    """Judge the reprocess window again, by the trailing day of the ``watched`` tag. A trailing day is read in front of it, but not written: the first day of
    a slice has no full window, and must not overwrite rows that had one."""
    now = F.lit(as_of).cast("timestamp")
    day = F.to_date(now - F.make_dt_interval(hours=F.lit(hours + 24)))
    rows = read_table(spark, clean_path).filter(
        (F.col("ingestDate") >= day) & rules.within("timestamp", now, hours + 24)
    )
    rows = ordered.trailing_stats(rows, ["deviceId"], "timestamp", watched)
    rows = silver.judge(rows, rules.is_flat(min_samples, std_limit), flat_name)
    upsert(
        spark, rows.filter(rules.within("timestamp", now, hours)), silver_path, ["deviceId", "timestamp"], "ingestDate",
        buckets=buckets, bucket_by=["deviceId"],
    )


def numbered(batch: DataFrame, number: int) -> tuple[str, int]:
    """The query that a micro-batch belongs to, and its number there."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch", number


def keep_hours(
    spark: SparkSession,
    path: str,
    *,
    lateness_hours: int = 72,
    expected_per_hour: int = params.SAMPLES_PER_HOUR,
    buckets: int = BUCKETS,
) -> Callable[[DataFrame, int], None]:
    """The hourly table of the batch job, kept up to date as judged rows (deviceId, timestamp, ingestedUtc, qualityFlag, isTrustworthy and tags) arrive.

    The job has a watermark of its own: the newest time of the batches before, less ``lateness_hours``. Rows behind it, or without a time, go to ``late`` with
    the watermark that they missed; the others are merged by key into ``rows``, where a correction takes the place of what it corrects, and the hours that they fall into are
    computed again from there. Only the buckets of the batch's devices and days are read and written. Each step may be repeated: late rows by batch,
    merges by key, and the clock is written last, and counts for later batches only. So all that came in is in ``rows`` (once per key) or in ``late``.
    """

    def newest_before(query: str, number: int):
        if not path_exists(spark, f"{path}/clock"):
            return None
        clock = spark.read.parquet(f"{path}/clock")
        return clock.filter(~((F.col("query") == query) & (F.col("number") >= number))).agg(F.max("newest")).first()[0]

    def merge(batch: DataFrame, number: int) -> None:
        query, number = numbered(batch, number)
        before = newest_before(query, number)
        mark = F.lit(None).cast("timestamp") if before is None else F.lit(before) - F.make_dt_interval(hours=F.lit(lateness_hours))
        behind = F.coalesce(F.col("timestamp") < mark, F.col("timestamp").isNull())
        batch = batch.persist()
        try:
            replace_batch(batch.filter(behind).withColumn("watermark", mark), number, f"{path}/late")
            rows = batch.filter(~behind).withColumn("ingestDate", F.to_date("timestamp"))
            touched = upsert(spark, rows, f"{path}/rows", ["deviceId", "timestamp"], "ingestDate", "ingestedUtc", buckets, ["deviceId"])
            if touched:
                here = spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows{f}" for f in touched])
                hour = F.date_trunc("hour", "timestamp")
                own = rows.select(F.col("deviceId").alias("_device"), hour.alias("_hour")).distinct()
                same = here["deviceId"].eqNullSafe(own["_device"]) & (F.date_trunc("hour", here["timestamp"]) == own["_hour"])
                missing = {t: F.lit(None).cast("double") for t in [*params.TELEMETRY_TAGS, "runHours"] if t not in here.columns}
                missing |= {c: F.lit(None).cast("string") for c in ("assetId", "siteId") if c not in here.columns}
                hours = gold.telemetry_hourly(here.join(own, same, "left_semi").withColumns(missing), expected_per_hour=expected_per_hour)
                upsert(spark, hours, f"{path}/hours", ["deviceId", "timestamp"], "ingestDate", buckets=buckets, bucket_by=["deviceId"])
            newest = F.greatest(F.max("timestamp"), F.lit(before).cast("timestamp"))
            told = batch.agg(newest.alias("newest")).select(F.lit(query).alias("query"), F.lit(number).alias("number"), "newest")
            replace_batch(told, number, f"{path}/clock")
            # a later batch needs the newest time so far, which is in this row and, should this batch be repeated, in the one before
            for folder in subfolders(spark, f"{path}/clock"):
                own, _, n = folder.rpartition("batchId=")[2].rpartition("-")
                if own == query and int(n) < number - 1:
                    delete_dir(spark, folder)
        finally:
            batch.unpersist()

    return merge


def alarm_rules(spark: SparkSession) -> DataFrame:
    return local_table(
        spark, params.ALARM_RULES, "rule string, tag string, comparison string, limit double, severity string, title string"
    )


def raise_alarms(rows: DataFrame, rule_table: DataFrame) -> DataFrame:
    """Measured values against the alarm rules (a short fixed list), one row per alarm."""
    values = rows.select("deviceId", "siteId", F.col("eventTimeUtc").alias("raisedAt"), F.explode("measurements").alias("tag", "value"))
    fired = F.when(F.col("comparison") == "gt", F.col("value") > F.col("limit")).otherwise(F.col("value") < F.col("limit"))
    return (
        values.join(rule_table, "tag")
        .filter(fired)
        .withColumn("alarmId", rules.stable_id("rule", "deviceId", F.col("raisedAt").cast("string")))
        .withColumn("ingestDate", F.to_date("raisedAt"))
        .drop("comparison")
    )


def append_rows(path: str, *partitions: str) -> Callable[[DataFrame, int], None]:
    return lambda batch, number: replace_batch(batch, number, path, *partitions)


def watch_silence(spark: SparkSession, path: str, *, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """Keep the last sample of each device, and the hub's clock; :func:`silent_devices` tells from them who is silent now.

    Rows carry ``deviceId``, ``timestamp`` and ``enqueuedUtc``, the arrival. A batch shrinks to one row per device before it is
    shuffled, so a chatty device costs no more than a quiet one. The state is two time stamps per device, in key buckets, of which a batch reads and writes those of
    its devices. Samples from after their own arrival tell nothing about when a device was seen, and are left to the dead letters.
    """

    def merge(batch: DataFrame, number: int) -> None:
        seen = batch.filter(~ahead("timestamp", "enqueuedUtc")).groupBy("deviceId").agg(
            F.max("timestamp").alias("lastSeen"), F.max("enqueuedUtc").alias("lastArrival")
        )
        upsert(spark, seen, f"{path}/last_seen", ["deviceId"], order="lastSeen", buckets=buckets)
        newest = batch.agg(F.max("enqueuedUtc").alias("newest")).filter("newest IS NOT NULL")
        upsert(spark, newest.withColumn("clock", F.lit("hub")), f"{path}/clock", ["clock"], order="newest")

    return merge


def silent_devices(spark: SparkSession, path: str, *, minutes: int = 60, lateness_minutes: int = 10) -> DataFrame:
    """The devices that are silent now. The hub's clock decides: a device is silent once the newest arrival of the fleet, less the
    lateness, is ``minutes`` past the device's last sample."""
    newest = spark.read.parquet(f"{path}/clock").agg(F.max("newest")).scalar()
    now = newest - F.make_dt_interval(mins=F.lit(lateness_minutes))
    since = F.col("lastSeen") + F.make_dt_interval(mins=F.lit(minutes))
    return read_table(spark, f"{path}/last_seen").drop("lastArrival").withColumn("silentSince", since).filter(F.col("silentSince") < now)
