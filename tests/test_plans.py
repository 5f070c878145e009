"""Physical plans: one scan per analysis, no all-pairs joins, no Python workers."""

from __future__ import annotations

import re

import pytest

import __spark_entry__
from flowsieve.operators import labels, networks, rulesets, traffic
from workload import views

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def flows(spark):
    return views.wide_flows(spark, SF)


def test_folding_reads_the_log_once(spark, flows):
    df = networks.ip_networks(networks.both_sides(flows), "side")
    df.collect()
    final = _plan(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1
    assert "ReusedExchange" in final
    # no address is parsed before the distinct
    below_distinct = final[re.search(r"Exchange hashpartitioning\(side#\d+, ip#", final).start():final.index("FileScan")]
    assert "RLIKE" not in below_distinct


def test_scans_read_only_the_columns_they_need(flows):
    assert "ReadSchema: struct<user_id:bigint>" not in _plan(traffic.top_destination_ports(flows))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", _plan(traffic.top_destination_ports(flows))).group(1)
    assert schema == "event_id:bigint"


def test_label_lookup_is_an_equi_join(spark, flows, monkeypatch):
    monkeypatch.setattr(rulesets, "is_small", lambda table: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [_plan(rulesets.label_flows(flows)), _plan(labels.ip_to_cidr(networks.both_sides(flows), "side"))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for plan in plans:
        assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    # the lookup by block stands above distinct addresses, never above log rows
    assert "filter(networks" not in plans[0]


@pytest.mark.parametrize("name", ["single_rule", "log_based_rules", "optimized_rules", "rule_patterns"])
def test_the_log_is_read_by_one_job(spark, name):
    plan = _plan(__spark_entry__.queries()[name](spark, SF)).split("== Initial Plan ==")[0]
    # what is left to do starts from the written summary
    assert "ReadSchema: struct<event_id" not in plan and "user_id" not in plan


def test_top_lists_never_sort_the_whole_result(flows):
    assert "TakeOrderedAndProject" in _plan(traffic.top_pairs(flows))


@pytest.mark.parametrize("name", ["lean_rules", "optimized_rules", "report_json", "report_rows", "single_rule", "graph_nodes"])
def test_no_python_and_no_all_pairs_joins(spark, name):
    plan = _plan(__spark_entry__.queries()[name](spark, SF))
    for word in ("Python", "Cartesian", "NestedLoop"):
        assert word not in plan
