"""Distinct counts from bitmaps and sketches."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from flowsieve.operators import distinct, networks, sketches, traffic, usage
from flowsieve.sources import swap
from workload import views

SF = "/root/testdata/sf0.001"
ROWS = [
    ("10.0.0.1", "0.0.0.0", 0, "a"), ("10.0.0.1", "255.255.255.255", 65535, "a"), ("10.0.0.2", "0.0.0.0", 32768, "a"), ("10.128.0.0", "0.0.0.1", 32767, "b"),
    ("::1", "host", 1, "b"), ("::1", "host", None, "b"), (None, None, None, "c"), ("01.2.3.4", None, 80, None)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def flows(make_flows):
    return make_flows(ROWS)


def plain(flows):
    return flows.agg(F.count("*"), F.count_distinct("src_ip"), F.count_distinct("dst_ip"), F.count_distinct("dst_port")).first()


def test_bitmaps_count_like_sets(flows):
    assert tuple(traffic.basic_stats(flows).first()) == tuple(plain(flows)) == (8, 5, 4, 6)
    assert tuple(traffic.basic_stats(flows.limit(0)).first()) == (0, 0, 0, 0)
    assert tuple(traffic.basic_stats(traffic.summarise_flows(flows)).first()) == (8, 5, 4, 6)


def test_merged_bitmaps_are_those_of_the_whole(spark):
    whole = views.dirty_flows(spark, SF)
    parts = [distinct.distinct_bitmaps(whole.where(F.col("event_id") % 3 == k), "rule_name") for k in range(3)]
    merged = distinct.merge_bitmaps(parts, "rule_name")
    assert tuple(traffic.stats_of_bitmaps(merged).first()) == tuple(plain(whole))
    by_rule = {r.rule_name: tuple(r)[1:] for r in distinct.count_bitmaps(merged, "rule_name").collect()}
    assert by_rule == {r.rule_name: tuple(r)[1:] for r in whole.groupBy("rule_name").agg(
        F.count("*"), F.count_distinct("src_ip"), F.count_distinct("dst_ip"), F.count_distinct("dst_port")).collect()}
    rules = views.rules(spark, SF)
    assert sorted(usage.patterns_of_bitmaps(merged, rules).collect()) == sorted(usage.rule_patterns(whole, rules).collect())


def test_ports_come_back_from_their_bits(spark):
    ports = [0, 1, 2, 7, 8, 255, 32767, 32768, 32769, 65534, 65535]
    flows = spark.createDataFrame([("x", None, None, p) for p in ports * 2], "rule_name string, src_ip string, dst_ip string, dst_port int")
    assert distinct.port_lists(distinct.distinct_bitmaps(flows, "rule_name"), "rule_name").first().destination_ports == ports


@pytest.mark.parametrize("name", ["basic_stats", "rule_patterns"])
def test_no_row_is_multiplied(spark, name):
    assert "Expand" not in _plan(__spark_entry__.queries()[name](spark, SF))


def test_sketches_bound_the_true_counts(spark):
    flows = views.wide_flows(spark, SF)
    estimates = sketches.estimate_distinct(sketches.flow_sketches(flows), "rule_name").collect()
    exact = {r.rule_name: r for r in flows.groupBy("rule_name").agg(
        F.count("*").alias("rows"), F.count_distinct("src_ip").alias("sources"), F.count_distinct("dst_ip").alias("destinations"),
        F.count_distinct("dst_port").alias("ports")).collect()}
    assert {r.rule_name for r in estimates} == set(exact)
    for r in estimates:
        assert r.rows == exact[r.rule_name].rows
        for name in ("sources", "destinations", "ports"):
            assert r[f"unique_{name}_low"] <= exact[r.rule_name][name] <= r[f"unique_{name}_high"]
            assert r[f"unique_{name}_low"] <= r[f"unique_{name}"] <= r[f"unique_{name}_high"]


def test_later_logs_are_merged_into_stored_sketches(spark, tmp_path):
    flows, path = views.flows(spark, SF), str(tmp_path / "sketches")
    halves = [flows.where(F.col("event_id") % 2 == k) for k in range(2)]
    for half in (*halves, halves[0].limit(0)):
        stored = sketches.update_sketches(spark, path, half)
    whole = sketches.flow_sketches(flows)
    assert stored.count() == whole.count()
    for keys in ([], ["rule_name"], ["hour_start"]):
        assert sorted(sketches.estimate_distinct(stored, keys).collect()) == sorted(sketches.estimate_distinct(whole, keys).collect())
    again = sketches.update_sketches(spark, path, halves[1])
    before, after = (sketches.estimate_distinct(t).first() for t in (whole, again))
    assert after.unique_sources == before.unique_sources and after.rows > before.rows
    assert os.listdir(tmp_path) == ["sketches"]
    empty = sketches.estimate_distinct(whole.limit(0)).first()
    assert (empty.rows, empty.unique_sources, empty.unique_sources_high) == (0, 0, 0)


def test_rejects_are_counted_by_the_job_that_folds(spark, make_flows):
    from pyspark.sql import Observation

    flows = traffic.summarise_flows(make_flows([*ROWS, *ROWS[4:6]]))
    seen = Observation()
    folded = networks.ip_networks(networks.observe_rejects(networks.both_sides(flows), seen), "side")
    assert folded.collect()
    assert seen.get == {"rows": 20, "missing": 3, "not_ipv4": 9}


class TestSwap:
    @pytest.fixture()
    def path(self, spark, tmp_path):
        swap.replace_table(spark.range(3), str(tmp_path / "t"))
        return str(tmp_path / "t")

    def test_a_table_replaces_itself(self, spark, path):
        swap.replace_table(swap.read_or_none(spark, path).selectExpr("id + 10 AS id"), path)
        assert sorted(r.id for r in spark.read.parquet(path).collect()) == [10, 11, 12]
        assert swap.read_or_none(spark, path + "-none") is None

    def test_a_failing_job_leaves_the_old_table(self, spark, path):
        with pytest.raises(Exception, match="no number"):
            swap.replace_table(spark.read.parquet(path).selectExpr("CASE WHEN id = 2 THEN raise_error('no number') ELSE id END AS id"), path)
        assert os.listdir(os.path.dirname(path)) == ["t"] and spark.read.parquet(path).count() == 3

    def test_a_death_between_the_renames_is_mended(self, spark, path, monkeypatch):
        def dies(session, files, new, target):
            assert files.rename(target, swap._beside(session, target, swap._OLD))
            raise KeyboardInterrupt

        monkeypatch.setattr(swap, "_swap", dies)
        with pytest.raises(KeyboardInterrupt):
            swap.replace_table(spark.range(9), path)
        assert not os.path.exists(path)
        monkeypatch.undo()
        assert swap.read_or_none(spark, path).count() == 3
        swap.replace_table(spark.range(9), path)
        assert spark.read.parquet(path).count() == 9 and os.listdir(os.path.dirname(path)) == ["t"]
