"""Sources, sinks and streams: repeatable, and never losing a row."""

from __future__ import annotations

import datetime as dt
import json
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow import schemas
from weirflow.functions import rules
from weirflow.operators import silver
from weirflow.session import shared_dir
from weirflow.sources import readers, writers
from weirflow.streaming import ingest, jobs

T0 = datetime(2024, 1, 1)
ROW = "deviceId string, timestamp timestamp, ingestedUtc timestamp, value double"


def rows(spark, *data):
    df = spark.createDataFrame([(d, T0 + timedelta(hours=h), T0 + timedelta(hours=a), v) for d, h, a, v in data], ROW)
    return df.withColumn("ingestDate", F.to_date("timestamp"))


@pytest.mark.parametrize("again", [False, True])
def test_folded_rows_are_merged_like_the_rows_they_stand_for(spark, tmp_path, again):
    days = lambda r: r.select("k", F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-03").cast("date"))).alias("ingestDate"), "v")
    cells = lambda r: r.select("k", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n"), "v", "ingestDate")
    path, keys, before = str(tmp_path / "t"), ["k", "n"], spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None)
    folded = lambda *names: spark.createDataFrame([(k, f"{k} now") for k in names], "k string, v string")
    old = spark.createDataFrame([("a", 1, "a old", "2024-01-02"), ("z", 0, "z old", "2024-01-03"), ("z", 0, "z old", "2024-02-01")],
                                "k string, n int, v string, d string").select("k", "n", "v", F.col("d").cast("date").alias("ingestDate"))
    if again:
        writers.upsert(spark, old, path, keys, "ingestDate")
    writers.upsert(spark, folded("a", "b", None), path, keys, "ingestDate", unfold=(days, cells))
    want = [(k, n, f"{k} now" if k else "None now", f"2024-01-0{d}") for k in ("a", "b", None) for n in range(3) for d in (1, 2, 3)]
    want += [("z", 0, "z old", "2024-01-03"), ("z", 0, "z old", "2024-02-01")] if again else []
    got = [(r.k, r.n, r.v, str(r.ingestDate)) for r in spark.read.parquet(path).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None) == before
    with pytest.raises(ValueError, match="not unique"):
        writers.upsert(spark, folded("a", "a"), path if again else f"{path}2", keys, "ingestDate", unfold=(days, cells))


def table(spark, path):
    return sorted((r.deviceId, r.timestamp, r.value) for r in spark.read.parquet(path).collect())


def test_upsert_twice_changes_nothing_and_old_replays_lose(spark, tmp_path):
    path = str(tmp_path / "t")
    first = rows(spark, ("d", 0, 0, 1.0), ("d", 30, 30, 2.0), ("e", 0, 0, 3.0))
    fixed = rows(spark, ("d", 0, 50, 9.0), ("f", 0, 0, 4.0))
    for part in (first, fixed, fixed, first):
        writers.upsert(spark, part, path, ["deviceId", "timestamp"], "ingestDate", order="ingestedUtc")
        if part is fixed:
            after = table(spark, path)
    assert table(spark, path) == after
    assert [(d, v) for d, _, v in after] == [("d", 9.0), ("d", 2.0), ("e", 3.0), ("f", 4.0)]


def test_upsert_leaves_other_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.upsert(spark, rows(spark, ("d", 0, 0, 1.0), ("d", 30, 30, 2.0)), path, ["deviceId", "timestamp"], "ingestDate")
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "ingestDate=2024-01-02").iterdir()}
    writers.upsert(spark, rows(spark, ("d", 0, 0, 5.0)), path, ["deviceId", "timestamp"], "ingestDate")
    assert before == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "ingestDate=2024-01-02").iterdir()}
    assert [v for _, _, v in table(spark, path)] == [5.0, 2.0]


def test_upsert_refuses_ambiguous_rows(spark, tmp_path):
    twice = rows(spark, ("d", 0, 0, 1.0), ("d", 0, 1, 2.0))
    with pytest.raises(ValueError, match="not unique"):
        writers.upsert(spark, twice, str(tmp_path / "t"), ["deviceId", "timestamp"], "ingestDate")


def test_upsert_takes_new_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.upsert(spark, rows(spark, ("d", 0, 0, 1.0)).drop("ingestDate"), path, ["deviceId", "timestamp"])
    newer = rows(spark, ("e", 0, 0, 2.0)).drop("ingestDate").withColumn("unit", F.lit("bar"))
    writers.upsert(spark, newer, path, ["deviceId", "timestamp"])
    assert sorted((r.deviceId, r.unit) for r in spark.read.parquet(path).collect()) == [("d", None), ("e", "bar")]


def test_latest_arrival_with_a_map_column(spark):
    df = spark.createDataFrame([("d", 1, {"x": 1.0}), ("d", 2, {"x": 2.0})], "deviceId string, ingestedUtc int, m map<string,double>")
    assert silver.dedup_latest(df, ["deviceId"]).first().m == {"x": 2.0}


def test_csv_keeps_rows_with_bad_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,n,on,note\n1,2.5,true,\"a, b\"\n2,x,,\n,7e1,false,z\n", encoding="utf-8")
    schema = T.StructType.fromDDL("id int, n double, on boolean, note string")
    got = sorted(map(tuple, readers.read_csv(spark, str(tmp_path / "a.csv"), schema).collect()), key=repr)
    assert got == [(1, 2.5, True, "a, b"), (2, None, None, None), (None, 70.0, False, "z")]


def test_csv_columns_are_bound_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("b,more,a\n1,x,\"two\nlines\"\n", encoding="utf-8")
    (row,) = readers.read_csv(spark, str(tmp_path / "a.csv"), T.StructType.fromDDL("a string, b int"), multi_line=True).collect()
    assert (row.a, row.b) == ("two\nlines", 1)
    with pytest.raises(ValueError, match="'c'"):
        readers.read_csv(spark, str(tmp_path / "a.csv"), T.StructType.fromDDL("a string, c int"))


def test_knowledge_files_come_in_three_shapes(spark, tmp_path):
    doc = {"id": "A", "title": "t", "content": "text", "assetClasses": ["pump"]}
    (tmp_path / "array.json").write_text(json.dumps([doc, {**doc, "id": "B", "content": " "}], indent=1))
    (tmp_path / "single.json").write_text(json.dumps({**doc, "id": "C", "classification": "public"}))
    (tmp_path / "wrapped.json").write_text(json.dumps({"documents": [{**doc, "id": "D"}, {**doc, "id": "E"}]}))
    got = {r.id: (r.classification, r.source) for r in readers.read_knowledge(spark, str(tmp_path)).collect()}
    assert got == {"A": ("internal", "array.json"), "C": ("public", "single.json"),
                   "D": ("internal", "wrapped.json"), "E": ("internal", "wrapped.json")}


def test_missing_tables_are_reported(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "here.parquet"))
    found, missing = readers.read_catalog(spark, str(tmp_path), ["here", "gone"])
    assert list(found) == ["here"] and missing == ["gone"]


def test_json_lines_leave_nulls_out(spark, tmp_path):
    writers.write_json_lines(spark.createDataFrame([("a", None)], "id string, note string").coalesce(1), str(tmp_path / "j"))
    (part,) = (tmp_path / "j").glob("part-*")
    assert json.loads(part.read_text()) == {"id": "a"}


def test_expiry_drops_whole_days(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_partitioned(rows(spark, ("d", 0, 0, 1.0), ("d", 24 * 5, 0, 2.0)), path)
    assert writers.expire(spark, path, "ingestDate", "2024-01-10", 5) == ["2024-01-01"]
    assert [v for _, _, v in table(spark, path)] == [2.0]


def message(device, minute, late, kind="telemetry", **values):
    at = T0 + timedelta(minutes=minute)
    return json.dumps({
        "SystemProperties": {"connectionDeviceId": device, "enqueuedTime": (at + timedelta(seconds=late)).isoformat() + "Z"},
        "body": {"payloadType": kind, "timestamp": at.isoformat() + "Z", "siteId": "S", "measurements": values},
    })


def test_messages_are_routed_and_none_is_lost(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.json").write_text("\n".join([
        message("d", 0, 300, power_kw=1.0), message("d", 1, 301, power_kw=2.0), message(None, 2, 0), message("d", 3, 0, "alarm"),
        message("d", 4, 0, "twin"), message("d", 5, 0, "what"),
    ]))
    stream = readers.stream_files(spark, str(inbox), schemas.ENVELOPE)
    for _ in range(2):  # a restart finds nothing new
        land(stream, tmp_path, "cp")
    got = sorted((t, r.isReplay) for t in jobs.TARGETS for r in jobs.bronze_table(spark, str(tmp_path / "lake"), t).collect())
    assert got == [("bronze_alarm", False), ("bronze_device_event", False), ("bronze_telemetry", False),
                   ("bronze_telemetry", True), ("bronze_unrouted", False)]


def land(stream, folder, checkpoint, targets=None):
    for query in jobs.start_bronze(stream, str(folder / "lake"), str(folder / checkpoint), targets=targets, once=True):
        query.awaitTermination()


def test_bronze_batches_share_a_folder_and_each_counts_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    stream = readers.stream_files(spark, str(inbox), schemas.ENVELOPE)
    for n in range(3):
        (inbox / f"{n}.json").write_text(message("d", n, 0, power_kw=1.0))
        land(stream, tmp_path, "cp", ["bronze_telemetry"])
    table = tmp_path / "lake" / "bronze_telemetry"
    assert [p.name for p in table.iterdir() if "=" in p.name] == ["ingestDate=2024-01-01"] and len(list(table.rglob("*.parquet"))) == 3
    assert spark.read.parquet(str(table)).count() == 3
    # a file that no batch has committed is not part of the table
    shutil.copy(next(table.rglob("*.parquet")), table / "ingestDate=2024-01-01" / "part-9.parquet")
    assert spark.read.parquet(str(table)).count() == 3
    # another checkpoint would count from zero, and its first batches would be taken for repeats
    with pytest.raises(ValueError, match="another checkpoint"):
        land(stream, tmp_path, "other", ["bronze_telemetry"])


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    raw = spark.read.schema(schemas.ENVELOPE).json(spark.sparkContext.parallelize([message("d", 0, 0, power_kw=1.0)]))
    for number in (7, 7, 8):
        jobs.replace_batch(ingest.to_bronze(raw), number, str(tmp_path / "b"), "ingestDate")
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2


def test_the_hot_table_forgets(spark, tmp_path):
    serve = jobs.serve_hot(str(tmp_path / "hot"), keep_days=14)
    for number, day in enumerate((0, 10, 20)):
        text = [message("d", day * 1440, 0, power_kw=1.0), message("d", day * 1440, 0, "alarm")]
        raw = spark.read.schema(schemas.ENVELOPE).json(spark.sparkContext.parallelize(text))
        serve(ingest.to_bronze(raw), number)
    hot = lambda: spark.read.parquet(str(tmp_path / "hot"))
    assert sorted(r.ingestDate.day for r in hot().collect()) == [11, 21]
    assert [r.ingestDate.day for r in jobs.recent(hot(), "2024-01-22", days=5).collect()] == [21]
    # a clock that is years ahead neither empties the hot table nor gets into it
    wrong = [message("e", 4_000_000, -4_000_000 * 60 + 21 * 86400, power_kw=1.0)]
    rows = ingest.to_bronze(spark.read.schema(schemas.ENVELOPE).json(spark.sparkContext.parallelize(wrong)))
    serve(rows, 3)
    assert sorted(r.ingestDate.day for r in hot().collect()) == [11, 21]
    (dead,) = rows.collect()
    assert (dead.target, dead.deviceId, str(dead.ingestDate)) == (ingest.DEAD_LETTERS, "e", "2024-01-22")


HOURS = "deviceId string, timestamp timestamp, ingestedUtc timestamp, isTrustworthy boolean, qualityFlag string, power_kw double"


def test_hours_take_corrections_and_late_rows_are_kept_aside(spark, tmp_path):
    path = str(tmp_path / "h")
    keep = jobs.keep_hours(spark, path, lateness_hours=24, expected_per_hour=2, buckets=4)

    def send(number, *data):
        at = lambda h: None if h is None else T0 + timedelta(hours=h)
        keep(spark.createDataFrame([(d, at(h), at(a), ok, "good" if ok else "suspect_range", v) for d, h, a, ok, v in data], HOURS), number)

    def hours():
        return sorted((r.deviceId, (r.timestamp - T0).total_seconds() / 3600, r.sampleCount, r.power_kw, list(r.qualityFlags), r.completenessPct)
                      for r in writers.read_table(spark, f"{path}/hours").collect())

    first = [("a", 0, 0, True, 1.0), ("a", 0.5, 0.5, True, 3.0), ("b", 40, 40, False, 9.0), ("c", 0, 0, True, 5.0)]
    send(0, *first)
    assert hours() == [("a", 0, 2, 2.0, [], 100.0), ("b", 40, 1, None, ["suspect_range"], 0.0), ("c", 0, 1, 5.0, [], 50.0)]
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "h" / "hours").rglob("*.parquet")}
    second = [("a", 0, 50, True, 7.0), ("b", 20, 50, True, 4.0), ("b", 40, 39, True, 1.0), ("d", None, 50, True, 1.0), ("d", 60, 60, True, 2.0)]
    for _ in range(2):  # the same batch again changes nothing
        send(1, *second)
        # a's correction is a day behind the newest row of the batch before; b's row of hour 20 is not, and its older copy of hour 40 loses
        assert hours() == [("a", 0, 2, 2.0, [], 100.0), ("b", 20, 1, 4.0, [], 50.0), ("b", 40, 1, None, ["suspect_range"], 0.0), ("c", 0, 1, 5.0, [], 50.0), ("d", 60, 1, 2.0, [], 50.0)]
        late = spark.read.parquet(f"{path}/late")
        assert sorted((r.deviceId, r.watermark) for r in late.collect()) == [("a", T0 + timedelta(hours=16)), ("d", T0 + timedelta(hours=16))]
        assert writers.read_table(spark, f"{path}/rows").count() == 6
    for n in range(2, 6):
        send(n, ("d", 61, 61, True, 2.0))
    assert len([p for p in (tmp_path / "h" / "clock").iterdir() if "=" in p.name]) == 2
    assert spark.read.parquet(f"{path}/clock").agg(F.max("newest")).first()[0] == T0 + timedelta(hours=61)
    untouched = [f for f in (tmp_path / "h" / "hours").rglob("*.parquet") if files.get(f) == f.stat().st_mtime_ns]
    assert untouched  # the first day's buckets that no row fell into


def test_streams_of_quality_and_flow_equal_the_batch(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    texts = [message("q", 60 * i, 0, "waterQuality", chlorine_mg_l=0.3 + (i % 3)) for i in range(30)] + [
        message("f", 60 * i, 0, "dmaFlow", flow_m3_h=2.0 + i) for i in range(5)]
    more = [message("q", 60, 9000, "waterQuality", chlorine_mg_l=1.5), message("q", 120, -50, "waterQuality", chlorine_mg_l=3.0), message("f", 120, 7000, "dmaFlow", flow_m3_h=50.0)]
    for n, part in enumerate((texts[:20], texts[20:], more)):
        (inbox / f"{n}.json").write_text("\n".join(part))
        bronze = ingest.to_bronze(readers.stream_files(spark, str(inbox), schemas.ENVELOPE))
        for name, clean, keys in (("quality", jobs.clean_quality, ["deviceId", "timestamp"]), ("flow", jobs.clean_dma, ["dmaId", "timestamp"])):
            own = bronze.filter(F.col("payloadType") == {"quality": "waterQuality", "flow": "dmaFlow"}[name])
            jobs.start(clean(own), jobs.merge_latest(spark, str(tmp_path / name), keys), str(tmp_path / f"cp-{name}"), once=True).awaitTermination()
    jobs.refresh_silver(spark, str(tmp_path / "quality"), str(tmp_path / "judged"), "2024-01-03 00:00:00", hours=48, watched="chlorine_mg_l", flat_name="chlorineSensorFlatline")
    everything = ingest.to_bronze(spark.read.schema(schemas.ENVELOPE).json(str(inbox)))
    for path, batch, cols in (
        ("judged", silver.silver_water_quality(everything.filter("payloadType = 'waterQuality'")), ["deviceId", "timestamp", "chlorine_mg_l", "qualityFlag", "chlorineSensorFlatline"]),
        ("flow", silver.silver_dma_flow(everything.filter("payloadType = 'dmaFlow'")), ["dmaId", "timestamp", "inflow_m3_h", "isNightWindow"]),
    ):
        got = sorted(map(tuple, writers.read_table(spark, str(tmp_path / path)).select(*cols).collect()))
        assert got == sorted(map(tuple, batch.select(*cols).collect())) and len(got) in (5, 30)


def test_stream_equals_batch_when_corrections_come_in_later_batches(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    clean, quiet = str(tmp_path / "clean"), str(tmp_path / "silver")

    def run():
        bronze = ingest.to_bronze(readers.stream_files(spark, str(inbox), schemas.ENVELOPE))
        merge = jobs.merge_latest(spark, clean, ["deviceId", "timestamp"])
        jobs.start(jobs.clean_telemetry(bronze), merge, str(tmp_path / "cp"), once=True).awaitTermination()
        jobs.refresh_silver(spark, clean, quiet, "2024-01-03 00:00:00", hours=48)

    texts = [message("d", 60 * i, 0, vibration_mm_s=2.5 + (i % 2)) for i in range(30)]
    (inbox / "1.json").write_text("\n".join(texts))
    run()
    (inbox / "2.json").write_text("\n".join([message("d", 60, 9000, vibration_mm_s=9.0), message("d", 120, -50, vibration_mm_s=8.0)]))
    run()
    everything = ingest.to_bronze(spark.read.schema(schemas.ENVELOPE).json(str(inbox)))
    batch = silver.silver_telemetry(everything)
    cols = ["deviceId", "timestamp", "vibration_mm_s", "qualityFlag", "isFlatline"]
    got = sorted(map(tuple, spark.read.parquet(quiet).select(*cols).collect()))
    assert got == sorted(map(tuple, batch.select(*cols).collect()))
    values = {r[1]: r[2] for r in got}
    assert values[T0 + timedelta(hours=1)] == 9.0 and values[T0 + timedelta(hours=2)] == 2.5


def test_refresh_does_not_write_the_day_it_only_reads(spark, tmp_path):
    clean, quiet = str(tmp_path / "clean"), str(tmp_path / "silver")
    data = [("d", h, h, 2.5) for h in range(72)]
    df = rows(spark, *data).withColumnRenamed("value", "vibration_mm_s").withColumn("hadOutOfRange", F.lit(False)).withColumn(
        "isReplay", F.lit(False))
    writers.write_partitioned(df, clean)
    jobs.refresh_silver(spark, clean, quiet, "2024-01-03 23:00:00", hours=24)
    got = spark.read.parquet(quiet)
    assert got.agg(F.min("timestamp")).first()[0] == T0 + timedelta(hours=47)
    # Each written row had its full trailing day to be judged by.
    assert got.filter("NOT isFlatline").count() == 0


def test_silent_devices_come_and_go(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    schema = T.StructType.fromDDL("deviceId string, timestamp timestamp, enqueuedUtc timestamp")

    def send(name, *items):
        at = lambda m: (T0 + timedelta(minutes=m)).isoformat() + "Z"
        (inbox / name).write_text("\n".join(
            json.dumps({"deviceId": d, "timestamp": at(m), "enqueuedUtc": at(arrival[0] if arrival else m)}) for d, m, *arrival in items))
        stream = readers.stream_files(spark, str(inbox), schema)
        watch = jobs.watch_silence(spark, str(tmp_path / "out"))
        jobs.start(stream, watch, str(tmp_path / "cp"), once=True).awaitTermination()
        return [(r.deviceId, r.lastSeen) for r in jobs.silent_devices(spark, str(tmp_path / "out")).collect()]

    assert send("1.json", ("a", 0), ("a", 5), ("b", 0)) == []
    assert send("2.json", ("b", 60), ("b", 76), ("b", 75)) == [("a", T0 + timedelta(minutes=5))]
    # An old replay does not wake a device, nor does a clock that is ahead, which makes no other device silent; a new sample does.
    assert send("3.json", ("a", 3, 77), ("a", 4_000_000, 77), ("z", 4_000_000, 77)) == [("a", T0 + timedelta(minutes=5))]
    assert send("4.json", ("a", 70)) == []


def test_shared_folder_is_the_configured_one(spark):
    assert shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


# --- upserts that meet NULLs or die ------------------------------------------------------------------------------------

UPSERT_ROWS = "k string, v int, ingestDate date"


def upserted(spark, path):
    return sorted(((r.k, r.v, str(r.ingestDate)) for r in spark.read.parquet(path).collect()), key=str)


def test_null_partition_and_null_key_survive_upserts(spark, tmp_path):
    path = str(tmp_path / "t")
    for k, v in (("a", 1), ("b", 2), (None, 3), (None, 4), ("a", 5)):
        writers.upsert(spark, spark.createDataFrame([(k, v, None)], UPSERT_ROWS), path, ["k"], "ingestDate")
    assert upserted(spark, path) == sorted([("a", 5, "None"), ("b", 2, "None"), (None, 4, "None")], key=str)


@pytest.mark.parametrize("buckets", [1, 4])
@pytest.mark.parametrize("partition", [None, "ingestDate"])
@pytest.mark.parametrize("step", ["delete", "mark", "write"])
def test_an_upsert_that_dies_loses_nothing(spark, tmp_path, monkeypatch, partition, step, buckets):
    path = str(tmp_path / "t")
    day = dt.date(2024, 1, 1)
    rows = lambda *kv: spark.createDataFrame([(k, v, day) for k, v in kv], UPSERT_ROWS)
    writers.upsert(spark, rows(("a", 1), ("b", 1)), path, ["k"], partition, buckets=buckets)

    def die(*args, **kwargs):
        if step == "delete":  # a replaced folder is gone, and the new one not there yet
            for folder in writers.leaf_folders(spark, f"{args[1]}/merged", args[3]):
                shutil.rmtree(path + folder)
        raise RuntimeError("killed")

    with monkeypatch.context() as patched:
        patched.setattr(writers, "touch" if step == "mark" else "put_in_place", die)
        with pytest.raises(RuntimeError, match="killed"):
            writers.upsert(spark, rows(("a", 2)), path, ["k"], partition, buckets=buckets)
    writers.upsert(spark, rows(("a", 2)), path, ["k"], partition, buckets=buckets)
    assert upserted(spark, path) == [("a", 2, "2024-01-01"), ("b", 1, "2024-01-01")]
    writers.upsert(spark, rows(("c", 3)), path, ["k"], partition, buckets=buckets)
    assert [r[0] for r in upserted(spark, path)] == ["a", "b", "c"] and not any((tmp_path / "t__staging").iterdir())


def test_an_upsert_rewrites_the_buckets_of_its_keys_only(spark, tmp_path):
    path = str(tmp_path / "t")
    day = dt.date(2024, 1, 1)
    many = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id")).alias("k"), F.col("id").cast("int").alias("v"), F.lit(day).alias("ingestDate"))
    writers.upsert(spark, many, path, ["k"], "ingestDate", buckets=32)

    def files():
        return {str(f): f.stat().st_size for f in (tmp_path / "t").rglob("*.parquet")}

    before = files()
    assert len({f.rpartition("/")[0] for f in before}) == 32
    few = spark.createDataFrame([("k7", -1, day), ("new", -2, day), ("k8", -3, dt.date(2024, 1, 2))], UPSERT_ROWS)
    replaced = writers.upsert(spark, few, path, ["k"], "ingestDate", buckets=32)
    after = files()
    written = sum(size for f, size in after.items() if f not in before)
    assert len(replaced) == 3 and written < sum(before.values()) * 3 / 32 * 1.5
    assert sum(f in before for f in after) == 30
    got = {r.k: r.v for r in writers.read_table(spark, path).where("ingestDate = date'2024-01-01'").collect()}
    assert len(got) == 20_001 and (got["k7"], got["new"], got["k9"]) == (-1, -2, 9)
    assert "bucketOf32" not in writers.read_table(spark, path).columns
    assert writers.upsert(spark, few.limit(0), path, ["k"], "ingestDate", buckets=32) == []


def test_windows_end_at_as_of(spark):
    rows = spark.sql("SELECT explode(sequence(timestamp'2024-01-01', timestamp'2024-01-05', interval 1 day)) AS ts")
    now = F.lit("2024-01-03 00:00:00").cast("timestamp")
    assert [str(r.ts)[:10] for r in rows.filter(rules.within("ts", now, 24)).orderBy("ts").collect()] == ["2024-01-02", "2024-01-03"]


def test_folders_are_named_as_the_writer_names_them(spark, tmp_path):
    values = ["plain", "a b", "x/y", "50%", "k=v", "é", "q?\"'[]^{}:*#\\", None]
    spark.createDataFrame([(v, dt.date(2024, 1, 2), 3) for v in values], "p string, d date, n int").write.partitionBy("p", "d").parquet(str(tmp_path / "t"))
    rows = spark.createDataFrame([(v, dt.date(2024, 1, 2)) for v in values], "p string, d date").collect()
    assert all((tmp_path / ("t" + writers.folder_of(r))).is_dir() for r in rows)
