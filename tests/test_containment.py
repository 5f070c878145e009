"""Networks of the caller's own against a check of every address with every network."""

from __future__ import annotations

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from flowsieve.operators import containment, networks, rulesets


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute(addresses, cidrs, order="network"):
    """Label of each address; `cidrs` are (text, ordinal)."""
    nets = []
    for text, ordinal in cidrs:
        net = ipaddress.ip_network("0.0.0.0/0" if text == "any" else text, strict=False)
        first = {"network": (int(net.network_address), net.prefixlen, 0), "longest": (-net.prefixlen, 0, 0)}.get(
            order, (ordinal, net.prefixlen, int(net.network_address)))
        nets.append((first, text, net))
    nets.sort(key=lambda n: n[:2])
    out = {}
    for address in addresses:
        found = [text for _, text, net in nets if ipaddress.ip_address(address) in net]
        out[address] = found[0] if found else f"{address}/32"
    return out


@pytest.fixture(scope="module")
def drawn():
    draw = random.Random(11)
    addresses = {str(ipaddress.ip_address(draw.choice([0x0A000000, 0xC0A80000, 0]) + draw.randrange(1 << draw.choice([8, 17, 26])))) for _ in range(600)}
    cidrs = [(f"{draw.choice(sorted(addresses))}/{draw.choice([0, 3, 7, 8, 9, 15, 16, 17, 22, 24, 28, 31, 32])}", i) for i in range(90)]
    return sorted(addresses), list(dict(cidrs).items())


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("order", ["network", "longest", "ordinal"])
def test_nested_and_wide_networks(spark, monkeypatch, drawn, small, order):
    monkeypatch.setattr(containment, "is_small", lambda table: small)
    addresses, cidrs = drawn
    ips = spark.createDataFrame([(a,) for a in addresses * 2] + [(None,)], "ip string")
    nets = spark.createDataFrame(cidrs, "cidr string, ordinal int")
    found = containment.ip_to_given_networks(ips, nets, order=order)
    want = brute(addresses, cidrs, order)
    rows = found.collect()
    assert {r.ip: r.cidr for r in rows} == want and len(rows) == len(addresses)
    assert all(r.given or r.cidr == f"{r.ip}/32" for r in rows)
    plan = _plan(found)
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_a_small_table_costs_no_shuffle_beyond_the_distinct(spark):
    ips = spark.range(1000).selectExpr("concat('10.0.', id % 256, '.', id % 7) AS ip")
    nets = spark.createDataFrame([("10.0.0.0/8",), ("10.0.7.0/24",)], "cidr string")
    found = containment.ip_to_given_networks(ips, nets)
    found.collect()
    final = _plan(found).split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in final


def test_odd_texts_and_keys(spark):
    ips = spark.createDataFrame(
        [("a", "10.0.0.1"), ("b", "10.0.0.1"), ("a", "::1"), ("a", "01.2.3.4"), (None, "10.0.0.1"), ("c", "192.0.2.9")], "k string, ip string")
    nets = spark.createDataFrame(
        [("a", "10.0.0.77/24"), ("b", "any"), ("a", "10.0.0.0/33"), ("a", "host"), ("a", None), ("c", " 192.0.2.9 ")], "k string, cidr string")
    keyed = containment.ip_to_given_networks(ips, nets, "k", network_keys="k")
    assert {(r.k, r.ip): (r.cidr, r.given) for r in keyed.collect()} == {
        ("a", "10.0.0.1"): ("10.0.0.77/24", True), ("b", "10.0.0.1"): ("any", True), ("a", "::1"): ("::1/32", False),
        ("a", "01.2.3.4"): ("01.2.3.4/32", False), ("c", "192.0.2.9"): (" 192.0.2.9 ", True)}
    assert {r.cidr: r.rows for r in containment.unreadable_networks(nets).collect()} == {"10.0.0.0/33": 1, "host": 1, None: 1}
    for nothing in (nets.limit(0), nets.where("cidr = 'host'")):
        labels = containment.ip_to_given_networks(ips, nothing, "k").collect()
        assert len(labels) == 5 and not any(r.given for r in labels)
    assert containment.ip_to_given_networks(ips.limit(0), nets, "k").collect() == []


def test_pair_rules_on_given_networks(make_flows, spark):
    flows = make_flows([("10.0.0.1", "10.9.0.1", 443), ("10.0.3.4", "10.9.0.1", 80), ("192.0.2.1", "10.9.0.2", 80), (None, "10.9.0.1", 1)])
    nets = spark.createDataFrame([("source", "10.0.0.0/8"), ("destination", "10.9.0.0/16")], "side string, cidr string")
    rows = rulesets.generate_cidr_pair_rules(flows, nets).collect()
    assert [(r.source_address, r.destination_address, r.service, r.log_count) for r in sorted(rows, key=lambda r: r.rule_idx)] == [
        ("10.0.0.0/8", "10.9.0.0/16", "http, https", 2), ("192.0.2.1/32", "10.9.0.0/16", "http", 1)]
    assert rulesets.generate_lean_rule_set(flows, nets).count() == 2


def test_rule_lists_as_networks(spark, make_flows):
    rules = spark.createDataFrame([("web", "any", "10.0.0.0/8, 192.0.2.1"), ("none", None, "")], "rule_name string, source_address string, destination_address string")
    listed = containment.rule_networks(rules)
    assert [tuple(r) for r in listed.orderBy("side", "pos").collect()] == [
        ("web", "destination", 0, "10.0.0.0/8"), ("web", "destination", 1, "192.0.2.1"), ("web", "source", 0, "any")]
    sides = networks.both_sides(make_flows([("1.2.3.4", "192.0.2.1", 1, "web"), ("1.2.3.4", "192.0.2.2", 1, "web")]), "rule_name")
    found = containment.ip_to_given_networks(sides, listed, ["rule_name", "side"], network_keys=["rule_name", "side"])
    assert {(r.side, r.ip): r.given for r in found.collect()} == {
        ("source", "1.2.3.4"): True, ("destination", "192.0.2.1"): True, ("destination", "192.0.2.2"): False}


@pytest.mark.parametrize("small", [True, False])
def test_labels_by_broadcast_blocks_and_by_address_agree(spark, monkeypatch, make_flows, small):
    monkeypatch.setattr(rulesets, "is_small", lambda table: small)
    rows = [("10.0.255.250", "10.1.0.3", 1), ("10.0.255.251", "host", 2), ("::1", "10.1.0.9", 2), ("10.1.0.3", "10.1.0.3", 3), (None, "10.1.0.3", 4)]
    found = {(r.src_cidr, r.dst_cidr, r.log_count, tuple(r.ports)) for r in rulesets.label_flows(make_flows(rows)).collect()}
    assert found == {
        ("10.0.255.250/32", "10.1.0.0/28", 1, (1,)), ("10.0.255.251/32", "host/32", 1, (2,)), ("::1/32", "10.1.0.0/28", 1, (2,)),
        ("10.1.0.3/32", "10.1.0.0/28", 1, (3,))}


def test_literal_catch_all(spark):
    rules = spark.createDataFrame(
        [(i, f"r{i}", f"10.0.{i % 9}.0/24", "10.9.0.0/24, 10.9.1.1/32" if i == 8 else "10.9.0.0/24", "http", 100 - i) for i in range(10)],
        "rule_idx bigint, rule_name string, source_address string, destination_address string, service string, log_count bigint")
    last = rulesets.cap_rules_to_seven(rules, compat=True).where("rule_name = 'catch_all_tail'").first()
    assert last.source_address == "10.0.6.0/24/32, 10.0.7.0/24/32, 10.0.8.0/24/32, 10.0.0.0/24/32"
    assert last.destination_address == "10.9.0.0/24/32, 10.9.0.0/24/32, 10.9.0.0/24/32, 10.9.1.1/32/32, 10.9.0.0/24/32"
    assert last.log_count == 94 + 93 + 92 + 91
    few = rulesets.cap_rules_to_seven(rules.where("rule_idx < 7"), compat=True)
    assert few.count() == 7 and few.where(F.col("rule_name") == "catch_all_tail").count() == 0
