"""Queries of the sources, sinks and streaming jobs: each runs its job into the shared folder and reads back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow import params, schemas
from weirflow.operators import gold, silver
from weirflow.plans import bindings as b
from weirflow.plans import lake
from weirflow.plans import medallion as m
from weirflow.plans.oracle_views import NOW, VIEWS, sql
from weirflow.plans.registry import query
from weirflow.session import is_directory, path_exists, shared_dir
from weirflow.sources import readers, writers
from weirflow.streaming import ingest, jobs

AHEAD_DAYS = 7 * 365
PAYLOADS = {"click": "telemetry", "view": "waterQuality", "purchase": "dmaFlow", "error": "alarm"}


def stream_of(spark, sf_dir: str, name: str) -> DataFrame:
    """A given table as a file stream."""
    path = f"{sf_dir}/{name}.parquet"
    schema = b.table(spark, sf_dir, name).schema
    if is_directory(spark, path):
        return readers.stream_files(spark, path, schema, "parquet")
    return readers.stream_files(spark, sf_dir, schema, "parquet", pathGlobFilter=f"{name}.parquet")


def messages(events: DataFrame) -> DataFrame:
    """Events in the envelope that devices send; some carry no device, some a type that nobody routes, and some the time of
    a clock that is seven years ahead."""
    kind = F.create_map(*[F.lit(x) for kv in PAYLOADS.items() for x in kv])[F.col("event_type")]
    other = b._pick(F.col("event_id"), ["connectivity", "deployment", "twin", "mystery"])
    v, n = F.col("value"), F.get_json_object("props", "$.k").cast("int")
    at = F.col("ts").cast("timestamp")
    system = F.struct(
        F.when(F.col("user_id") % 50 != 0, b._name("DEV-", "user_id")).alias("connectionDeviceId"),
        (at + F.make_dt_interval(secs=(n * 10).cast("decimal(18,6)"))).alias("enqueuedTime"),
    )
    body = F.struct(
        F.lit("1.0").alias("schemaVersion"),
        F.coalesce(kind, other).alias("payloadType"),
        F.when(F.col("event_id") % 97 == 0, at + F.make_dt_interval(days=F.lit(AHEAD_DAYS))).otherwise(at).alias("timestamp"),
        b._name("AST-", "user_id").alias("assetId"),
        b._name("SITE-", F.col("user_id") % 25).alias("siteId"),
        F.lit(None).cast("string").alias("dmaId"),
        F.create_map(
            F.lit("vibration_mm_s"), v * 0.1372904651, F.lit("bearing_temp_c"), n * 1.0219384756,
            F.lit("chlorine_mg_l"), v * 0.0493827165, F.lit("power_kw"), v * 2.0193847561,
        ).alias("measurements"),
        F.struct(F.lit(1.0).alias("completeness"), F.lit(False).alias("suspect")).alias("quality"),
    )
    return events.select(system.alias("SystemProperties"), body.alias("body"))


VIEWS["msgs"] = f"""
  SELECT CASE WHEN user_id % 50 <> 0 THEN 'DEV-' || user_id END AS deviceId, ts + to_seconds(k * 10) AS enqueuedUtc,
         CASE WHEN event_id % 97 = 0 THEN ts + to_days({AHEAD_DAYS}) ELSE ts END AS eventTimeUtc, 'AST-' || user_id AS assetId, 'SITE-' || (user_id % 25) AS siteId, '1.0' AS schemaVersion,
         CASE event_type WHEN 'click' THEN 'telemetry' WHEN 'view' THEN 'waterQuality' WHEN 'purchase' THEN 'dmaFlow'
              WHEN 'error' THEN 'alarm' ELSE ['connectivity','deployment','twin','mystery'][event_id % 4 + 1] END AS payloadType,
         value * CAST(0.1372904651 AS DOUBLE) AS vibration_mm_s, k * CAST(1.0219384756 AS DOUBLE) AS bearing_temp_c,
         value * CAST(0.0493827165 AS DOUBLE) AS chlorine_mg_l, value * CAST(2.0193847561 AS DOUBLE) AS power_kw, k FROM ev"""
VIEWS["routed_msgs"] = f"""
  SELECT * REPLACE (CASE WHEN isAhead THEN 'bronze_unrouted' ELSE target END AS target,
                    CAST(CASE WHEN isAhead THEN enqueuedUtc ELSE eventTimeUtc END AS DATE) AS ingestDate) FROM (
  SELECT *, eventTimeUtc > enqueuedUtc + to_seconds({params.CLOCK_SKEW_SECONDS}) AS isAhead,
         CAST(epoch(enqueuedUtc - eventTimeUtc) AS BIGINT) AS ingestLagSeconds, ingestLagSeconds > {params.REPLAY_LAG_SECONDS} AS isReplay,
         CASE WHEN payloadType = 'telemetry' THEN 'bronze_telemetry' WHEN payloadType = 'waterQuality' THEN 'bronze_water_quality'
              WHEN payloadType = 'dmaFlow' THEN 'bronze_dma_flow' WHEN payloadType = 'alarm' THEN 'bronze_alarm'
              WHEN payloadType = 'mystery' THEN 'bronze_unrouted' ELSE 'bronze_device_event' END AS target,
         NULL AS ingestDate
  FROM msgs WHERE deviceId IS NOT NULL)"""
LIFTED = ["deviceId", "enqueuedUtc", "eventTimeUtc", "assetId", "siteId", "schemaVersion", "payloadType"]
ROUTED = [*LIFTED, "ingestLagSeconds", "isReplay", "ingestDate"]


@query("prj_envelope", sql(f"SELECT {', '.join(LIFTED)}, vibration_mm_s FROM msgs"))
def prj_envelope(spark, sf_dir):
    """Through the JSON text that a hub delivers."""
    fmt = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    sent = messages(b.table(spark, sf_dir, "events")).select(F.to_json(F.struct("*"), fmt).alias("value"))
    got = sent.select(F.from_json("value", schemas.ENVELOPE, fmt).alias("m")).select("m.*")
    return ingest.lift_envelope(got).select(*LIFTED, F.col("measurements.vibration_mm_s").alias("vibration_mm_s"))


@query("flt_valid", sql(f"SELECT {', '.join(LIFTED)} FROM msgs WHERE deviceId IS NOT NULL AND eventTimeUtc IS NOT NULL"))
def flt_valid(spark, sf_dir):
    rows = ingest.lift_envelope(messages(b.table(spark, sf_dir, "events")))
    return ingest.drop_unattributed(rows).select(*LIFTED)


def landed(spark, sf_dir, targets: list[str] | None = None) -> str:
    """Run the bronze streams over the events and return the folder of their tables."""
    path = shared_dir(spark, "bronze")
    stream = messages(stream_of(spark, sf_dir, "events"))
    for query in jobs.start_bronze(stream, f"{path}/lake", f"{path}/checkpoint", targets=targets, once=True):
        query.awaitTermination()
    return f"{path}/lake"


def in_batches(spark, rows: DataFrame, parts: int, run) -> None:
    """Rows with a column ``part`` as a stream that is stopped and started again: ``run`` takes the stream of what has arrived so far, part by part."""
    inbox = shared_dir(spark, "arrivals")
    for i in range(parts):
        rows.filter(F.col("part") == i).drop("part").write.mode("append").parquet(inbox)
        run(readers.stream_files(spark, inbox, rows.drop("part").schema, "parquet"))


@query("src_event_stream", sql("SELECT event_id, ts, user_id, event_type, value FROM ev"))
def src_event_stream(spark, sf_dir):
    path = shared_dir(spark, "stream")
    rows = stream_of(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    jobs.start(rows, jobs.append_rows(f"{path}/table"), f"{path}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{path}/table").drop("batchId")


@query("str_route", sql("SELECT target, payloadType, isReplay, count(*) AS n FROM routed_msgs GROUP BY 1, 2, 3"))
def str_route(spark, sf_dir):
    path = landed(spark, sf_dir)
    tables = [jobs.bronze_table(spark, path, t).select(F.lit(t).alias("target"), "payloadType", "isReplay") for t in jobs.TARGETS]
    return reduce(DataFrame.unionByName, tables).groupBy("target", "payloadType", "isReplay").agg(F.count(F.lit(1)).alias("n"))


@query("snk_append_bronze", sql(f"SELECT {', '.join(ROUTED)} FROM routed_msgs WHERE target = 'bronze_telemetry'"), dates=("ingestDate",))
def snk_append_bronze(spark, sf_dir):
    return spark.read.parquet(f"{landed(spark, sf_dir, ['bronze_telemetry'])}/bronze_telemetry").select(*ROUTED)


@query("str_two_sinks", sql(f"""
  SELECT 'lake' AS sink, ingestDate, count(*) AS n FROM routed_msgs WHERE target = 'bronze_telemetry' GROUP BY 2
  UNION ALL
  SELECT 'hot', ingestDate, count(*) FROM routed_msgs WHERE target = 'bronze_telemetry'
    AND ingestDate > (SELECT CAST(max(enqueuedUtc) AS DATE) - 21 FROM routed_msgs) GROUP BY 2
  UNION ALL
  SELECT 'recent', ingestDate, count(*) FROM routed_msgs WHERE target = 'bronze_telemetry'
    AND ingestDate > (SELECT CAST(max(enqueuedUtc) AS DATE) - 21 FROM routed_msgs)
    AND ingestDate > CAST({NOW} AS DATE) - 14 AND ingestDate <= CAST({NOW} AS DATE) GROUP BY 2"""), dates=("ingestDate",))
def str_two_sinks(spark, sf_dir):
    path = shared_dir(spark, "sinks")
    rows = ingest.to_bronze(messages(stream_of(spark, sf_dir, "events")))
    lake_path = landed(spark, sf_dir, ["bronze_telemetry"])
    jobs.start(rows, jobs.serve_hot(f"{path}/hot", keep_days=21), f"{path}/checkpoint", once=True).awaitTermination()
    hot = spark.read.parquet(f"{path}/hot")
    tables = {"lake": spark.read.parquet(f"{lake_path}/bronze_telemetry"), "hot": hot, "recent": jobs.recent(hot, b.AS_OF)}
    counts = [t.groupBy(F.lit(n).alias("sink"), "ingestDate").agg(F.count(F.lit(1)).alias("n")) for n, t in tables.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


VIEWS["hour_landed"] = f"""
  SELECT date_trunc('hour', eventTimeUtc) AS "timestamp", deviceId, target, count(DISTINCT eventTimeUtc) AS n FROM routed_msgs
  WHERE eventTimeUtc >= date_trunc('hour', {NOW} - INTERVAL 744 HOUR) AND eventTimeUtc <= {NOW} GROUP BY 1, 2, 3"""


@query("str_to_gold", sql("""
  SELECT "timestamp", deviceId, 'telemetry' AS kind, n AS sampleCount FROM hour_landed WHERE target = 'bronze_telemetry'
  UNION ALL SELECT "timestamp", deviceId, 'quality', n FROM hour_landed WHERE target = 'bronze_water_quality'"""))
def str_to_gold(spark, sf_dir):
    """Messages through the streams to bronze tables, and from these through both batch jobs, which read them as they are."""
    run = lake.Run(landed(spark, sf_dir), b.AS_OF, hours=24 * 31, min_samples=b.MIN_SAMPLES, std_limit=b.STD_LIMIT, expected_per_hour=b.EXPECTED_PER_HOUR)
    for name, rows in {"sites": b.sites, "assets": b.assets, "devices": b.devices}.items():
        writers.write_snapshot(rows(spark, sf_dir), run.path(f"ref_{name}"))
    lake.bronze_to_silver(spark, run)
    lake.silver_to_gold(spark, run)
    kinds = {"telemetry": "gold_telemetry_hourly", "quality": "gold_water_quality"}
    tables = [spark.read.parquet(run.path(t)).select("timestamp", "deviceId", F.lit(k).alias("kind"), "sampleCount") for k, t in kinds.items()]
    return reduce(DataFrame.unionByName, tables)


def merged(spark, rows: DataFrame, clean, keys: list[str]) -> str:
    """Bronze rows in three batches, so that corrections come before and after what they correct, merged by key; the folder of the table."""
    path = shared_dir(spark, "silver")
    merge = jobs.merge_latest(spark, f"{path}/clean", keys, buckets=2)
    part = F.pmod(F.xxhash64("eventTimeUtc", "enqueuedUtc", "siteId"), F.lit(3))
    in_batches(spark, rows.withColumn("part", part), 3, lambda stream: jobs.start(clean(stream), merge, f"{path}/checkpoint", once=True).awaitTermination())
    return path


@query("str_silver_upsert", sql(f"""SELECT "timestamp", deviceId, {m.TAGS}, isFlatline, qualityFlag FROM silver"""))
def str_silver_upsert(spark, sf_dir):
    path = merged(spark, b.bronze_telemetry(spark, sf_dir), jobs.clean_telemetry, ["deviceId", "timestamp"])
    jobs.refresh_silver(
        spark, f"{path}/clean", f"{path}/silver", b.AS_OF, hours=24 * 31, min_samples=b.MIN_SAMPLES, std_limit=b.STD_LIMIT, buckets=1
    )
    return writers.read_table(spark, f"{path}/silver").select(
        "timestamp", "deviceId", *params.TELEMETRY_TAGS, "isFlatline", "qualityFlag"
    )


@query("str_quality_upsert", sql(f"""SELECT "timestamp", deviceId, {', '.join(params.QUALITY_PARAMETERS)}, chlorineSensorFlatline, qualityFlag FROM silver_wq"""))
def str_quality_upsert(spark, sf_dir):
    path = merged(spark, b.bronze_quality(spark, sf_dir), jobs.clean_quality, ["deviceId", "timestamp"])
    jobs.refresh_silver(
        spark, f"{path}/clean", f"{path}/silver", b.AS_OF, hours=24 * 31, min_samples=b.MIN_SAMPLES, std_limit=b.STD_LIMIT,
        watched="chlorine_mg_l", flat_name="chlorineSensorFlatline", buckets=1,
    )
    return writers.read_table(spark, f"{path}/silver").select(
        "timestamp", "deviceId", *params.QUALITY_PARAMETERS, "chlorineSensorFlatline", "qualityFlag"
    )


@query("str_dma_upsert", sql("SELECT * FROM silver_dma"), dates=("ingestDate",))
def str_dma_upsert(spark, sf_dir):
    path = merged(spark, b.bronze_dma(spark, sf_dir), jobs.clean_dma, ["dmaId", "timestamp"])
    return writers.read_table(spark, f"{path}/clean").drop("ingestedUtc")


def _hourly_sql(tag: str) -> str:
    good = f"({tag}) FILTER (WHERE trusted)"
    return (f"round(avg{good}, 3) AS {tag}, round(min{good}, 3) AS {tag}_min, round(max{good}, 3) AS {tag}_max, "
            f"round(stddev_samp{good}, 4) AS {tag}_std")


# Three batches of ten days each. A row in 41 is sent with the last one, and corrections come one batch later.
VIEWS["sent"] = """
  SELECT ts, user_id, ingestedUtc, event_type <> 'error' AS trusted, CASE WHEN event_type = 'error' THEN 'suspect_range' ELSE 'good' END AS flag, k,
         value * CAST(2.0193847561 AS DOUBLE) AS power_kw, value * CAST(0.1372904651 AS DOUBLE) AS vibration_mm_s,
         least(2, CASE WHEN event_id % 41 = 0 THEN 2 ELSE datediff('day', TIMESTAMP '2024-01-01', ts) // 10 END
                  + CASE WHEN ingestedUtc >= ts + to_seconds(3600) THEN 1 ELSE 0 END) AS part FROM arrivals"""
VIEWS["sent_marked"] = """
  SELECT s.*, mark, coalesce(ts < mark, FALSE) AS late FROM sent s JOIN
    (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 72 HOUR AS mark FROM sent GROUP BY part) USING (part)"""


def hours_kept(spark, sf_dir) -> str:
    """Run the hourly job over three batches; the folder of its tables."""
    path = shared_dir(spark, "hourly")
    rows = b.resend(b.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("int")))
    bad = F.col("event_type") == "error"
    fixed = F.col("enqueuedUtc") >= F.col("ts") + F.expr("interval 1 hour")
    turn = F.when(F.col("event_id") % 41 == 0, 2).otherwise(F.floor(F.datediff("ts", F.lit("2024-01-01")) / 10))
    rows = rows.select(
        F.col("ts").alias("timestamp"), F.col("enqueuedUtc").alias("ingestedUtc"), b._ids()[0], (~bad).alias("isTrustworthy"),
        F.when(bad, "suspect_range").otherwise("good").alias("qualityFlag"), (F.col("value") * 2.0193847561).alias("power_kw"),
        (F.col("value") * 0.1372904651).alias("vibration_mm_s"), F.col("k").cast("double").alias("runHours"),
        F.least(F.lit(2), turn + fixed.cast("int")).alias("part"),
    )
    keep = jobs.keep_hours(spark, path, expected_per_hour=b.EXPECTED_PER_HOUR, buckets=1)
    in_batches(spark, rows, 3, lambda stream: jobs.start(stream, keep, f"{path}/checkpoint", once=True).awaitTermination())
    return path


@query("str_hourly", sql(f"""
  SELECT *, completenessPct >= {params.MIN_COMPLETENESS_PCT} AS isTrustworthy FROM (
  SELECT date_trunc('hour', ts) AS "timestamp", 'DEV-' || user_id AS deviceId, count(*) AS sampleCount,
    count(*) FILTER (WHERE trusted) AS trustworthyCount, {_hourly_sql('power_kw')}, {_hourly_sql('vibration_mm_s')},
    CAST(max(k) AS DOUBLE) AS runHours, CASE WHEN bool_and(trusted) THEN '' ELSE 'suspect_range' END AS qualityFlags,
    least(CAST(100.0 AS DOUBLE), round(count(*) FILTER (WHERE trusted) / CAST({b.EXPECTED_PER_HOUR} AS DOUBLE) * 100, 1)) AS completenessPct
    FROM (SELECT * FROM sent_marked WHERE NOT late QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY ingestedUtc DESC) = 1) GROUP BY 1, 2)"""))
def str_hourly(spark, sf_dir):
    rows = writers.read_table(spark, f"{hours_kept(spark, sf_dir)}/hours")
    stats = [f"{t}{s}" for t in ("power_kw", "vibration_mm_s") for s in ("", "_min", "_max", "_std")]
    return rows.select("timestamp", "deviceId", "sampleCount", "trustworthyCount", *stats, "runHours", F.concat_ws(",", "qualityFlags").alias("qualityFlags"),
                       "completenessPct", "isTrustworthy")


@query("str_late_rows", sql("""
  SELECT 'late' AS kind, 'DEV-' || user_id AS deviceId, ts AS "timestamp", mark AS watermark, 1 AS n FROM sent_marked WHERE late
  UNION ALL SELECT 'all', NULL, NULL, NULL, count(*) FROM sent_marked
  UNION ALL SELECT 'kept', NULL, NULL, NULL, count(DISTINCT (user_id, ts)) FROM sent_marked WHERE NOT late"""))
def str_late_rows(spark, sf_dir):
    """The rows behind the job's watermark, and what came in and was kept."""
    path = hours_kept(spark, sf_dir)
    late = spark.read.parquet(f"{path}/late").select(F.lit("late").alias("kind"), "deviceId", "timestamp", "watermark", F.lit(1).cast("long").alias("n"))
    totals = {"all": b.resend(b.table(spark, sf_dir, "events").withColumn("k", F.lit(1))), "kept": spark.read.parquet(f"{path}/rows")}
    nothing = [F.lit(None).cast(late.schema[c].dataType).alias(c) for c in ("deviceId", "timestamp", "watermark")]
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), *nothing, "n") for k, t in totals.items()]
    return reduce(DataFrame.unionByName, counts, late)


@query("str_alarm", sql("""
  SELECT 'vibration-high-high' AS rule, deviceId, eventTimeUtc AS raisedAt, vibration_mm_s AS value, 'critical' AS severity
  FROM routed_msgs WHERE vibration_mm_s > 5.6
  UNION ALL SELECT 'bearing-hot', deviceId, eventTimeUtc, bearing_temp_c, 'high' FROM routed_msgs WHERE bearing_temp_c > 75
  UNION ALL SELECT 'chlorine-low', deviceId, eventTimeUtc, chlorine_mg_l, 'high' FROM routed_msgs WHERE chlorine_mg_l < 0.2"""))
def str_alarm(spark, sf_dir):
    path = shared_dir(spark, "alarms")
    rows = ingest.to_bronze(messages(stream_of(spark, sf_dir, "events")))
    alarms = jobs.raise_alarms(rows, jobs.alarm_rules(spark))
    jobs.start(alarms, jobs.append_rows(f"{path}/table", "ingestDate"), f"{path}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{path}/table").select("rule", "deviceId", "raisedAt", "value", "severity")


@query("str_silent_device", sql("""
  SELECT deviceId, max(eventTimeUtc) AS lastSeen, max(eventTimeUtc) + INTERVAL 60 MINUTE AS silentSince FROM routed_msgs
  WHERE NOT isAhead GROUP BY 1 HAVING max(eventTimeUtc) + INTERVAL 60 MINUTE <
    (SELECT max(enqueuedUtc) - INTERVAL 10 MINUTE FROM routed_msgs)"""))
def str_silent_device(spark, sf_dir):
    path = shared_dir(spark, "silent")
    rows = ingest.drop_unattributed(ingest.lift_envelope(messages(stream_of(spark, sf_dir, "events")))).select(
        "deviceId", F.col("eventTimeUtc").alias("timestamp"), "enqueuedUtc"
    )
    jobs.start(rows, jobs.watch_silence(spark, path, buckets=4), f"{path}/checkpoint", once=True).awaitTermination()
    return jobs.silent_devices(spark, path)


# ---------------------------------------------------------------- tables

@query("src_parquet", sql("SELECT * FROM telemetry"))
def src_parquet(spark, sf_dir):
    found, missing = readers.read_catalog(spark, sf_dir, ["events", "no_such_table"])
    if missing != ["no_such_table"]:
        raise ValueError(f"unexpected report of missing tables: {missing}")
    return b.telemetry(spark, sf_dir) if "events" in found else None


DIRTY = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_nationkey", T.IntegerType()),
    T.StructField("c_acctbal", T.DoubleType()),
])


@query("src_csv", sql("""SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 <> 0 THEN c_nationkey END AS c_nationkey,
    CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal FROM customer"""))
def src_csv(spark, sf_dir):
    """Customers as CSV with empty and unreadable cells."""
    path = shared_dir(spark, "csv")
    key = F.col("c_custkey")
    dirty = b.table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name",
        F.when(key % 10 != 0, F.col("c_nationkey").cast("string")).alias("c_nationkey"),
        F.when(key % 7 != 0, F.col("c_acctbal").cast("string")).otherwise("n/a").alias("c_acctbal"),
    )
    dirty.write.csv(path, header=True)
    return readers.read_csv(spark, path, DIRTY)


@query("src_json_kb", sql("""SELECT id, title, docType, classification, len(assetClasses) AS classes, content FROM knowledge
    WHERE trim(content) <> ''"""))
def src_json_kb(spark, sf_dir):
    """Documents as JSON files of up to a hundred each, as an array or wrapped in an object, one file per row."""
    path = shared_dir(spark, "kb")
    number = F.substring("id", 5, 20).cast("long")
    docs = b.knowledge(spark, sf_dir).withColumn("file", F.floor(number / 100))
    fields = [c for c in docs.columns if c != "file"]
    packed = docs.groupBy("file").agg(F.collect_list(F.struct(*fields)).alias("documents"))
    wrapped = F.to_json(F.struct("documents"))
    text = F.when(F.col("file") % 2 == 0, F.to_json("documents")).otherwise(wrapped)
    packed.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    rows = readers.read_knowledge(spark, path)
    return rows.select(
        "id", "title", "docType", "classification", F.size("assetClasses").cast("long").alias("classes"), "content"
    )


@query("snk_snapshot", sql("SELECT assetId, siteId, assetClass, isoVibrationBand FROM assets"))
def snk_snapshot(spark, sf_dir):
    path = shared_dir(spark, "snapshot")
    rows = gold.gold_asset(b.assets(spark, sf_dir)).select("assetId", "siteId", "assetClass", "isoVibrationBand")
    writers.write_snapshot(rows.withColumn("old", F.lit(1)), path)
    writers.write_snapshot(rows, path)
    return spark.read.parquet(path)


@query("snk_partitioned", sql('SELECT deviceId, "timestamp", power_kw, CAST("timestamp" AS DATE) AS ingestDate FROM telemetry'), dates=("ingestDate",))
def snk_partitioned(spark, sf_dir):
    path = shared_dir(spark, "partitioned")
    rows = b.telemetry(spark, sf_dir).select("deviceId", "timestamp", "power_kw", F.to_date("timestamp").alias("ingestDate"))
    writers.write_partitioned(rows, path)
    return spark.read.parquet(path)


@query("snk_upsert", sql(f"""SELECT "timestamp", deviceId, ingestedUtc, {m.TAGS} FROM bronze
    QUALIFY row_number() OVER (PARTITION BY deviceId, "timestamp" ORDER BY ingestedUtc DESC) = 1"""))
def snk_upsert(spark, sf_dir):
    """First arrivals, then the corrected copies, then the first arrivals again: corrections must survive."""
    path = shared_dir(spark, "upsert")
    rows = silver.flatten(b.bronze_telemetry(spark, sf_dir), params.TELEMETRY_TAGS, ["deviceId"])
    rows = rows.drop("isReplay", "schemaVersion").withColumn("ingestDate", F.to_date("timestamp"))
    late = F.col("ingestedUtc") >= F.col("timestamp") + F.expr("interval 1 hour")
    for part in (rows.filter(~late), rows.filter(late), rows.filter(~late)):
        writers.upsert(spark, part, path, ["deviceId", "timestamp"], "ingestDate", order="ingestedUtc")
    return writers.read_table(spark, path).drop("ingestDate")


@query("snk_jsonl", sql("""SELECT workOrderId, assetId, failureMode, costUsd FROM work_orders"""))
def snk_jsonl(spark, sf_dir):
    path = shared_dir(spark, "jsonl")
    rows = b.work_orders(spark, sf_dir).select("workOrderId", "assetId", "failureMode", "costUsd")
    writers.write_json_lines(rows, path)
    return spark.read.json(path, schema=rows.schema)


@query("tbl_passthrough", sql("SELECT workOrderId, assetId, status FROM work_orders"))
def tbl_passthrough(spark, sf_dir):
    path = shared_dir(spark, "passthrough")
    tables = {"ref_workorders": b.work_orders(spark, sf_dir).select("workOrderId", "assetId", "status")}
    targets = {
        "ref_workorders": (f"{path}/gold_work_order", ["workOrderId"]),
        "ref_alarms": (f"{path}/gold_alarm", ["alarmId"]),
    }
    missing = writers.pass_through(spark, tables, targets)
    if missing != ["ref_alarms"] or path_exists(spark, f"{path}/gold_alarm"):
        raise ValueError(f"unexpected report of missing tables: {missing}")
    return spark.read.parquet(f"{path}/gold_work_order")


@query("tbl_expire", sql(f"""SELECT deviceId, "timestamp", power_kw FROM telemetry
    WHERE CAST("timestamp" AS DATE) >= CAST({NOW} AS DATE) - 14"""))
def tbl_expire(spark, sf_dir):
    path = shared_dir(spark, "expire")
    rows = b.telemetry(spark, sf_dir).select("deviceId", "timestamp", "power_kw", F.to_date("timestamp").alias("ingestDate"))
    writers.write_partitioned(rows, path)
    writers.expire(spark, path, "ingestDate", b.AS_OF, 14)
    return spark.read.parquet(path).drop("ingestDate")


@query("flt_unexpired", sql("SELECT conversationId, turn FROM turns WHERE createdAt >= TIMESTAMP '2024-01-03' - to_days(1)"))
def flt_unexpired(spark, sf_dir):
    now = F.lit("2024-01-03").cast("timestamp")
    return writers.unexpired(b.turns(spark, sf_dir), "createdAt", now, 1).select("conversationId", "turn")


def built_lake(spark, sf_dir, hours: int = 72) -> lake.Run:
    """The given tables as a lake, with the first batch job run over it."""
    run = lake.Run(
        shared_dir(spark, "lake"), b.AS_OF, hours=hours, min_samples=b.MIN_SAMPLES, std_limit=b.STD_LIMIT,
        expected_per_hour=b.EXPECTED_PER_HOUR,
    )
    for name, rows in {
        "telemetry": b.bronze_telemetry, "water_quality": b.bronze_quality, "dma_flow": b.bronze_dma,
    }.items():
        dated = rows(spark, sf_dir).withColumn("ingestDate", F.to_date("eventTimeUtc"))
        writers.write_partitioned(dated, run.path(f"bronze_{name}"))
    for name, rows in {
        "sites": b.sites, "assets": b.assets, "devices": b.devices, "workorders": b.work_orders, "alarms": b.alarms,
        "spare_parts": b.spares,
    }.items():
        writers.write_snapshot(rows(spark, sf_dir), run.path(f"ref_{name}"))
    lake.bronze_to_silver(spark, run)
    return run


SINCE = f'"timestamp" >= {NOW} - INTERVAL 72 HOUR'


@query("tbl_gold_summary", sql(f"""
  SELECT 'gold_site' AS tableName, count(*) AS rowCount FROM sites UNION ALL SELECT 'gold_asset', count(*) FROM assets
  UNION ALL SELECT 'gold_edge_device', count(*) FROM devices
  UNION ALL SELECT 'gold_telemetry_hourly', count(*) FROM hourly WHERE {SINCE}
  UNION ALL SELECT 'gold_water_quality', count(*) FROM
    (SELECT DISTINCT deviceId, date_trunc('hour', "timestamp") FROM silver_wq WHERE {SINCE})
  UNION ALL SELECT 'gold_dma_flow', count(*) FROM dma_hour WHERE {SINCE}
  UNION ALL SELECT 'gold_dma_mnf', count(*) FROM
    (SELECT DISTINCT dmaId, CAST("timestamp" AS DATE) FROM dma_hour WHERE isNightWindow AND {SINCE})
  UNION ALL SELECT 'gold_energy', count(*) FROM hourly WHERE power_kw IS NOT NULL AND flow_m3_h > 0 AND {SINCE}
  UNION ALL SELECT 'gold_asset_health', count(DISTINCT deviceId) FROM hourly
    WHERE vibration_mm_s IS NOT NULL AND isTrustworthy AND {SINCE}
  UNION ALL SELECT 'gold_work_order', count(*) FROM work_orders UNION ALL SELECT 'gold_alarm', count(*) FROM alarms
  UNION ALL SELECT 'gold_spare_part', count(*) FROM spares"""))
def tbl_gold_summary(spark, sf_dir):
    return lake.silver_to_gold(spark, built_lake(spark, sf_dir))
