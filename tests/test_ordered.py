"""The ordered helpers against brute force, for ordinary and for hot keys."""

from __future__ import annotations

import math
import random
import statistics
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirflow.functions import ordered

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "k string, at timestamp, v double"


def frame(spark, rows):
    return spark.createDataFrame([(k, START + timedelta(seconds=s), v) for k, s, v in rows], SCHEMA)


def trailing_by_hand(rows, window):
    out = []
    for k, s, v in rows:
        near = [w for q, t, w in rows if q == k and math.floor(s) - window <= math.floor(t) <= math.floor(s) and w is not None]
        out.append((k, s, len(near), statistics.stdev(near) if len(near) > 1 else None))
    return out


@pytest.fixture(params=[1_000_000, 1], ids=["ordinary", "hot"])
def heat(request, monkeypatch):
    monkeypatch.setattr(ordered, "HOT_ROWS", request.param)


EDGES = [
    ("a", 0, 1.0), ("a", 86400, 2.0), ("a", 86401, 4.0), ("a", 86400.5, 3.0), ("a", 90000, None), ("a", 400000, 5.0),
    ("b", 10, 7.0), ("c", 5, 0.52), ("c", 65, 0.52), ("c", 125, 0.52), ("c", 125.25, 0.52), ("d", 1, None), ("d", 2, None),
]


def check_trailing(spark, rows):
    got = ordered.trailing_stats(frame(spark, rows), ["k"], "at", "v").collect()
    found = {(r.k, round((r.at.replace(tzinfo=timezone.utc) - START).total_seconds(), 3)): r for r in got}
    assert len(got) == len(rows)
    for k, s, n, std in trailing_by_hand(rows, 86400):
        row = found[(k, round(s, 3))]
        assert row.trailingCount == n
        assert (row.trailingStd is None) == (std is None)
        assert std is None or abs(row.trailingStd - std) < 1e-6


def test_trailing_edges(spark, heat):
    check_trailing(spark, EDGES)


def test_trailing_random(spark, heat):
    rng = random.Random(7)
    seconds = rng.sample(range(6 * 86400), 120)
    check_trailing(spark, [(rng.choice("xy"), s, rng.choice([None, rng.uniform(0, 60)])) for s in seconds])


def test_frozen_signal_has_no_spread(spark, heat):
    rows = [("a", 60 * i, 0.52) for i in range(3000)]
    worst = ordered.trailing_stats(frame(spark, rows), ["k"], "at", "v").agg(F.max("trailingStd")).first()[0]
    assert worst < 1e-6


@pytest.mark.parametrize("level", [1e6, 1e9])
def test_spread_of_large_values_does_not_cancel(spark, heat, level):
    rows = [("a", 60 * i, level + 0.0005 * (-1) ** i) for i in range(1500)]
    late = ordered.trailing_stats(frame(spark, rows), ["k"], "at", "v").filter("trailingCount > 100").agg(F.min("trailingStd"), F.max("trailingStd")).first()
    assert 0.00049 < late[0] <= late[1] < 0.00051


def test_positions(spark, heat):
    rows = [("a", s, float(s)) for s in (5, 3, 90000, 3600, 7200, 200000)] + [("a", 5, 1.0), ("b", 1, 1.0)]
    got = ordered.with_positions(frame(spark, rows), ["k"], "at", ["v"]).orderBy("k", "position").collect()
    assert [(r.k, r.v, r.position, r.seriesLength) for r in got] == [
        ("a", 3.0, 1, 7), ("a", 1.0, 2, 7), ("a", 5.0, 3, 7), ("a", 3600.0, 4, 7), ("a", 7200.0, 5, 7),
        ("a", 90000.0, 6, 7), ("a", 200000.0, 7, 7), ("b", 1.0, 1, 1),
    ]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.sampled_from([0.0, 1.0, 1.5, 2.0, 7.0, 9.25]), min_size=1, max_size=30))
def test_rank_value(spark, values):
    rank = F.greatest(F.floor(F.col("n") * 0.95), F.lit(1))
    df = frame(spark, [("a", i, v) for i, v in enumerate(values)])
    want = sorted(values)[max(int(len(values) * 0.95), 1) - 1]
    for limit in (1_000_000, 0):
        ordered.HOT_ROWS, before = limit, ordered.HOT_ROWS
        try:
            assert ordered.value_at_rank(df, ["k"], "v", rank, 0.95).first().rankValue == want
        finally:
            ordered.HOT_ROWS = before


def test_rank_value_of_a_large_hot_key(spark, monkeypatch):
    monkeypatch.setattr(ordered, "HOT_ROWS", 1000)
    df = spark.range(50000).select(F.lit("a").alias("k"), ((F.col("id") * 7919) % 50000).cast("double").alias("v"))
    rank = F.greatest(F.floor(F.col("n") * 0.95), F.lit(1))
    assert ordered.value_at_rank(df, ["k"], "v", rank, 0.95).first().rankValue == 47499.0


def test_rank_has_ties_and_nulls(spark):
    df = spark.createDataFrame([("x", 3.0), ("y", 5.0), ("z", 3.0), ("u", None), ("w", 1.0)], "id string, v double")
    got = {r.id: r["rank"] for r in ordered.with_rank(df, [], "v").collect()}
    assert got == {"y": 1, "x": 2, "z": 2, "w": 4, "u": 5}


def test_rank_without_keys_is_cut_into_pieces(spark):
    values = [round((i * 7919 % 5000) ** 2 / 1000, 1) for i in range(5000)]
    got = ordered.with_rank(spark.createDataFrame([(v,) for v in [*values, None, None]], "v double"), [], "v").collect()
    assert all(r["rank"] == (5001 if r.v is None else 1 + sum(x > r.v for x in values)) for r in got[::50] + got[-2:])
    same = ordered.with_rank(spark.createDataFrame([(2.0,), (2.0,)], "v double"), [], "v").collect()
    assert [r["rank"] for r in same] == [1, 1]
    assert ordered.with_rank(spark.createDataFrame([], "v double"), [], "v").count() == 0


def test_latest_row_is_the_same_on_every_run(spark):
    rows = [("a", 1, float(i)) for i in range(50)]
    df = frame(spark, rows)
    picks = {
        ordered.latest_by(df.repartition(n), ["k"], [F.col("at"), ordered.tie_hash(df, ["k"])]).first().v for n in (1, 3, 7)
    }
    assert len(picks) == 1


def test_ranks_without_keys_are_cut_evenly_whatever_the_values(spark):
    rng = random.Random(2)
    values = [rng.random() for _ in range(20_000)] + [1e300, -1e300, float("nan"), float("inf"), -float("inf"), None, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    sizes = [r["count"] for r in ordered.with_piece(df, "v").groupBy("_piece").count().collect()]
    assert len(sizes) > ordered.RANK_PIECES * 0.9 and max(sizes) < 20_000 / ordered.RANK_PIECES * 5
    got = [(r.v, r["rank"]) for r in ordered.with_rank(df, [], "v").collect()]
    key = lambda v: (2,) if v is None else (0,) if v != v else (1, -v)
    place = {}
    for i, v in enumerate(sorted(values, key=key), 1):
        place.setdefault(key(v), i)
    assert len(got) == len(values) and all(place[key(v)] == r for v, r in got)


def test_a_hot_null_key_is_cut_like_any_other(spark):
    rows = spark.createDataFrame([(None if i % 3 else "a", i) for i in range(30)], "k string, v int")
    mine = ordered.split_hot(rows, ["k"], lambda df: df.withColumn("way", F.lit("cold")), lambda df: df.withColumn("way", F.lit("hot")))
    assert {r.way for r in mine.collect()} == {"cold"}
    before, ordered.HOT_ROWS = ordered.HOT_ROWS, 15
    try:
        mine = ordered.split_hot(rows, ["k"], lambda df: df.withColumn("way", F.lit("cold")), lambda df: df.withColumn("way", F.lit("hot")))
        assert {(r.k, r.way) for r in mine.collect()} == {("a", "cold"), (None, "hot")} and mine.count() == 30
    finally:
        ordered.HOT_ROWS = before
