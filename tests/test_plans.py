"""What the physical plans must and must not hold."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from weirflow.operators import silver
from weirflow.plans import bindings, medallion, tools
from weirflow.plans.catalog import QUERIES
from weirflow.sources.writers import write_partitioned

SMALL = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairwise_joins_and_no_python(spark, name):
    plan = plan_of(QUERIES[name].plan(spark, SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups", plan)


def test_time_filter_and_columns_reach_the_scan(spark):
    rows = silver.lookback(bindings.telemetry(spark, SMALL), "timestamp", 72, bindings.AS_OF).select("deviceId", "flow_m3_h")
    plan = plan_of(rows)
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema: struct<(.*?)>", plan)
    assert "GreaterThanOrEqual(ts," in pushed.group(1)
    assert "value" not in pushed.group(2)


def test_lookback_prunes_partitions(spark, tmp_path):
    rows = bindings.telemetry(spark, SMALL).withColumn("ingestDate", F.to_date("timestamp"))
    write_partitioned(rows, str(tmp_path / "t"))
    plan = plan_of(silver.lookback(spark.read.parquet(str(tmp_path / "t")), "timestamp", 72, bindings.AS_OF))
    assert "ingestDate" in re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan).group(1)


def test_clearance_is_filtered_before_scoring(spark):
    plan = plan_of(QUERIES["txt_retrieve_keyword"].plan(spark, SMALL))
    at = plan.index("IN (public,internal)")
    # Read from the top: the text is taken apart above the filter, and nothing is shuffled between it and the scan.
    assert plan.rindex("Generate", 0, at) > plan.rindex("Exchange", 0, at)
    assert "Exchange" not in plan[at : plan.index("FileScan", at)]


def test_parameter_tables_are_broadcast_by_size(spark):
    plan = plan_of(tools.jn_limits(spark, SMALL))
    assert "BroadcastHashJoin" in plan and "LocalTableScan" in plan


def test_hot_key_list_is_bounded(spark):
    plan = plan_of(medallion.silver_telemetry(spark, SMALL))
    assert "TakeOrderedAndProject(limit=10000" in plan


def test_top_n_is_limited_before_the_shuffle(spark):
    plan = plan_of(QUERIES["cnv_history"].plan(spark, SMALL))
    assert plan.index("WindowGroupLimit") < plan.rindex("Exchange") < plan.rindex("WindowGroupLimit")
