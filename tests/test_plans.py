"""Plan shape: the scale decisions stated in the README hold in the physical plans."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def plan(spark, name):
    df = queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_nested_loop_or_cartesian_joins(spark):
    for name in ["event_route", "asset_enrich", "member_resolve", "entity_fan_out", "grant_fan_out",
                 "grant_state", "grant_effective", "hierarchy_closure", "notification_rows"]:
        p = plan(spark, name)
        assert "NestedLoopJoin" not in p and "CartesianProduct" not in p, name


def test_rules_and_dimensions_are_broadcast(spark):
    assert "BroadcastHashJoin" in plan(spark, "event_route")
    p = plan(spark, "asset_enrich")
    assert p.count("BroadcastHashJoin") >= 4 and "SortMergeJoin" not in p


def test_grant_fan_out_has_no_join(spark):
    assert "Join" not in plan(spark, "grant_fan_out")


def test_aggregations_combine_before_the_shuffle(spark):
    assert "partial_count" in plan(spark, "date_parts")
    assert "partial_max_by" in plan(spark, "grant_state")


def test_scans_read_only_needed_columns(spark):
    p = plan(spark, "date_parts")
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz>" in p
    p = plan(spark, "object_path")
    assert "ReadSchema: struct<page_id:bigint,url:string>" in p  # html is never read
