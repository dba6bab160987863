"""Every query with an oracle, compared with it value by value on the smallest tables."""

from __future__ import annotations

import pytest

from tests.oracle import compare, connect
from weirflow.functions import ordered
from weirflow.plans.catalog import QUERIES

SMALL = "/root/testdata/sf0.001"
CHECKED = sorted(n for n, q in QUERIES.items() if q.oracle is not None)
# Queries that tell hot keys apart; run once more with every key treated as hot.
HOT = [
    "agg_statistics", "agg_pressure_drop", "agg_telemetry_hourly", "cnv_trace_report", "prj_quality_flag",
    "silver_water_quality", "top_hot_path_bound", "win_downsample", "win_flatline_24h", "win_sensor_validity",
]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", CHECKED)
def test_oracle(spark, con, name):
    rows, difference = compare(spark, SMALL, QUERIES[name], con)
    assert difference == ""


@pytest.mark.parametrize("name", HOT)
def test_oracle_with_hot_keys(spark, con, name, monkeypatch):
    monkeypatch.setattr(ordered, "HOT_ROWS", 2)
    rows, difference = compare(spark, SMALL, QUERIES[name], con)
    assert difference == "" and rows > 0


def test_all_queries_have_an_oracle():
    assert sorted(set(QUERIES) - set(CHECKED)) == []
