from __future__ import annotations

import pytest

from flowsieve.operators import usage
from flowsieve.sources.tables import check_rule_names

RULES = [
    ("open", 1, "any", "any", "any", "risky"),
    ("half", 2, "10.0.0.0/8", "any", "http", "permissive"),
    ("risky", 3, "10.0.0.0/8", "10.0.0.0/8", "http", "risky"),
    ("fine", 4, "10.0.0.0/8", "10.0.0.0/8", "http", "normal"),
    ("idle", 5, "any", "any", "any", "permissive"),
    ("blank", 6, "any", "any", "any", "normal"),
]
FLOWS = [
    ("10.0.0.1", "10.9.0.1", 443, "open"), ("10.0.0.2", "10.9.0.1", 80, "open"), ("10.0.0.2", "10.9.0.1", 9, "open"),
    ("10.0.0.1", "10.9.0.9", 80, "half"), ("10.0.0.1", "10.9.0.1", 80, "risky"), ("10.0.0.1", "10.9.0.1", 80, "fine"),
    (None, None, None, "blank"), ("10.0.0.1", "10.9.0.1", 80, "not in the table"), ("10.0.0.1", "10.9.0.1", 80, None),
]


@pytest.fixture(scope="module")
def flows(make_flows):
    return make_flows(FLOWS)


@pytest.fixture(scope="module")
def rules(spark):
    rows = [(name, 0, prio, f"about {name}", src, dst, svc, risk) for name, prio, src, dst, svc, risk in RULES]
    return spark.createDataFrame(
        rows, "rule_name string, hits bigint, priority int, description string, source_address string, "
        "destination_address string, service string, risky_permissive string")


def test_usage_and_hits(flows, rules):
    counts = {r.rule_name: r.log_count for r in usage.rule_usage(flows, rules).collect()}
    assert counts == {"open": 3, "half": 1, "risky": 1, "fine": 1, "idle": 0, "blank": 1}
    assert {r.rule_name: r.hits for r in usage.rule_hits(flows, rules).collect()} == counts
    assert usage.rule_hits(flows, rules).columns == rules.columns


def test_unused_and_permissive(flows, rules):
    assert [tuple(r) for r in usage.unused_rules(flows, rules).collect()] == [("idle", "about idle", 5)]
    assert [tuple(r) for r in usage.permissive_rules(flows, rules).collect()] == [
        ("half", "about half", "10.0.0.0/8", "any", "http", 1)]


def test_patterns_and_their_values(flows, rules):
    patterns = {r.rule_name: tuple(r)[1:] for r in usage.rule_patterns(flows, rules).collect()}
    assert patterns["open"] == (2, 1, 3, [9, 80, 443])
    assert patterns["blank"] == (0, 0, 0, [])
    assert set(patterns) == {"open", "half", "risky", "fine", "blank"}
    values = {tuple(r) for r in usage.rule_pattern_values(flows, rules).collect()}
    assert {v for v in values if v[0] == "open"} == {
        ("open", "source_ips", "10.0.0.1"), ("open", "source_ips", "10.0.0.2"),
        ("open", "destination_ips", "10.9.0.1"), ("open", "destination_ports", "9"),
        ("open", "destination_ports", "80"), ("open", "destination_ports", "443")}
    assert {v[0] for v in values} == {"open", "half", "risky", "fine"}


EXPECTED = {
    "open": (
        "Restrict source address to 10.0.0.0/30; Restrict destination address to 10.9.0.1/32; "
        "Restrict service to http, https, custom-ports-9; This rule is marked as risky and should be reviewed",
        ("10.0.0.0/30", "10.9.0.1/32", "http, https, custom-ports-9")),
    "half": ("Restrict destination address to 10.9.0.9/32", ("10.0.0.0/8", "10.9.0.9/32", "http")),
    "risky": ("This rule is marked as risky and should be reviewed", ("10.0.0.0/8", "10.0.0.0/8", "http")),
    "fine": ("No optimization needed", None),
    "idle": ("Consider removing this unused rule", None),
    "blank": ("No optimization needed", None),
}


@pytest.mark.parametrize("small", [True, False])
def test_recommendations(flows, rules, monkeypatch, small):
    monkeypatch.setattr(usage, "is_small", lambda table: small)
    found = {}
    for r in usage.generate_optimized_rules(flows, rules).collect():
        new = r.optimized_rule
        assert r.original_rule.rule_name == r.rule_name
        found[r.rule_name] = (
            r.recommendation, new and (new.source_address, new.destination_address, new.service))
    assert found == EXPECTED
    values = usage.rule_pattern_values(flows, rules)
    assert values.count() == 15


def test_callables_replace_folding_and_services(flows, rules):
    from pyspark.sql import functions as F

    def hosts(ips, keys):
        return ips.where("ip IS NOT NULL").distinct().select(
            *keys, F.concat("ip", F.lit("/32")).alias("cidr"), F.lit(None).cast("bigint").alias("first_addr"))

    advised = usage.generate_optimized_rules(flows, rules, hosts, lambda ports: F.concat(F.size(ports), F.lit(" ports")))
    rule = {r.rule_name: r.optimized_rule for r in advised.collect()}["open"]
    assert (rule.source_address, rule.service) == ("10.0.0.1/32, 10.0.0.2/32", "3 ports")


def test_rules_from_the_log_alone(flows):
    found = {r.rule_name: r for r in usage.generate_optimized_rules(flows, None).collect()}
    assert set(found) == {"open", "half", "risky", "fine", "blank", "not in the table"}
    assert (found["blank"].source_address, found["blank"].service, found["blank"].log_count) == ("any", "any", 1)
    assert found["half"].recommendation == (
        "Optimize source address to 10.0.0.1/32; Optimize destination address to 10.9.0.9/32; Optimize service to http")


def test_networks_and_services_by_rule(flows):
    networks = {tuple(r)[:3] for r in usage.networks_by_rule(flows).select("rule_name", "side", "cidr").collect()}
    assert ("open", "source", "10.0.0.0/30") in networks and ("half", "destination", "10.9.0.9/32") in networks
    services = {r.rule_name: r.service for r in usage.port_services(flows).collect()}
    assert services["open"] == "http, https, custom-ports-9" and "blank" not in services


def test_repeated_rule_names_are_rejected(rules):
    with pytest.raises(ValueError, match="open"):
        check_rule_names(rules.unionByName(rules.where("rule_name = 'open'")))
