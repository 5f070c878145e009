from __future__ import annotations

import random
from collections import Counter

import pytest

from flowsieve.operators import addresses, joins, rulesets
from flowsieve.operators.addresses import outermost_networks
from flowsieve.operators.traffic import summarise_flows
from tests import brute


def _rules(spark, counts, **fields):
    rows = [
        (i, f"cidr_pair_rule_{i}", fields.get("src", "10.0.{}.0/24").format(i), "10.9.0.0/24",
         ["http, custom-ports-23-8080", "https, custom-ports-9", "any"][i % 3], n)
        for i, n in enumerate(counts)]
    return spark.createDataFrame(
        rows, "rule_idx bigint, rule_name string, source_address string, destination_address string, "
        "service string, log_count bigint")


def _placed(rules):
    return [r for r in rulesets.cap_rules_to_seven(rules).orderBy("place").collect()]


def test_seven_rules_stay_as_they_are(spark):
    rows = _placed(_rules(spark, [1, 2, 3, 4, 5, 6, 7]))
    assert [r.rule_name for r in rows] == [f"cidr_pair_rule_{i}" for i in range(7)]
    assert [r.log_count for r in rows] == [1, 2, 3, 4, 5, 6, 7]
    assert rows[0].source_address == "10.0.0.0/24"


def test_eight_rules_become_six_and_a_catch_all(spark):
    rows = _placed(_rules(spark, [1, 2, 3, 4, 5, 6, 7, 8]))
    assert [r.rule_name for r in rows] == [*[f"cidr_pair_rule_{i}" for i in (7, 6, 5, 4, 3, 2)], "catch_all_tail"]
    last = rows[-1]
    assert (last.source_address, last.destination_address) == ("10.0.0.0/24, 10.0.1.0/24", "10.9.0.0/24")
    assert (last.service, last.log_count) == ("custom-ports-9-23-8080, http, https", 3)


def test_equal_counts_keep_the_rule_order(spark):
    rows = _placed(_rules(spark, [5] * 9))
    assert [r.rule_name for r in rows] == [*[f"cidr_pair_rule_{i}" for i in range(6)], "catch_all_tail"]
    assert rows[-1].log_count == 15
    assert rows[-1].service == "any, custom-ports-9-23-8080, http, https"


def test_few_and_no_rules(spark):
    assert [r.rule_name for r in _placed(_rules(spark, [3, 9]))] == ["cidr_pair_rule_0", "cidr_pair_rule_1"]
    assert _placed(_rules(spark, [3]).limit(0)) == []


def test_catch_all_labels_keep_order_and_repeats(spark):
    rows = rulesets.catch_all_labels(_rules(spark, [9, 9, 9, 9, 9, 9, 1, 4, 4])).collect()
    by_side = {s: [r.address for r in sorted(rows, key=lambda r: r.pos) if r.side == s] for s in ("source", "destination")}
    assert by_side == {
        "source": ["10.0.7.0/24/32", "10.0.8.0/24/32", "10.0.6.0/24/32"], "destination": ["10.9.0.0/24/32"] * 3}


def test_outermost_networks_of_any_width(spark):
    cidrs = ["10.0.0.0/8", "10.3.0.0/16", "10.3.4.0/24", "11.0.0.0/24", "11.0.0.0/25", "11.0.0.128/25", "12.0.0.1/32",
             "12.0.0.1/32", "::1/32", "11.0.1.0/24"]
    kept = outermost_networks(spark.createDataFrame([(c,) for c in cidrs], "cidr string"))
    assert sorted(r.cidr for r in kept.collect()) == ["10.0.0.0/8", "11.0.0.0/24", "11.0.1.0/24", "12.0.0.1/32", "::1/32"]


NAMES = {80: "http", 443: "https", 22: "ssh", 53: "dns"}


def _services(ports):
    known = [NAMES[p] for p in sorted(ports) if p in NAMES]
    other = [str(p) for p in sorted(ports) if p not in NAMES]
    return ", ".join(known + ([f"custom-ports-{'-'.join(other)}"] if other else []))


def _model(rows):
    src, dst = brute.label([r[0] for r in rows]), brute.label([r[1] for r in rows])
    counts = Counter((src[s], dst[d]) for s, d, _ in rows)
    ports = {}
    for s, d, p in rows:
        ports.setdefault((src[s], dst[d]), set()).add(p)
    return [(f"cidr_pair_rule_{i}", *pair, _services(ports[pair]), counts[pair]) for i, pair in enumerate(sorted(counts))]


@pytest.fixture(scope="module")
def skewed(make_flows):
    """Two of three rows share one source; the others spread over /16 borders."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        src = "10.0.255.250" if i % 3 else f"10.{rng.randrange(0, 3)}.{rng.choice([0, 1, 254, 255])}.{rng.randrange(256)}"
        dst = f"172.{rng.choice([16, 17, 40])}.{rng.choice([0, 255])}.{rng.randrange(0, 256, 40)}"
        rows.append((src, dst, rng.choice([80, 443, 22, 53, 8080, 23])))
    return rows, make_flows(rows)


def _found(flows):
    rules = rulesets.generate_cidr_pair_rules(flows).orderBy("rule_idx").collect()
    return [tuple(r[f] for f in rulesets.RULE_FIELDS) for r in rules]


def test_pair_rules_match_the_model(skewed):
    rows, flows = skewed
    assert _found(flows) == _model(rows)


def test_large_lookup_gives_the_same_rules(skewed, monkeypatch):
    rows, flows = skewed
    monkeypatch.setattr(rulesets, "is_small", lambda table: False)
    assert _found(flows) == _model(rows)


def test_summary_gives_the_same_rules(skewed):
    rows, flows = skewed
    assert _found(summarise_flows(flows)) == _model(rows)


def test_lean_rules_cover_all_rows(skewed):
    rows, flows = skewed
    lean = rulesets.generate_lean_rule_set(flows).collect()
    assert len(lean) == 7
    assert sum(r.log_count for r in lean) == len(rows)


def test_null_and_invalid_values(make_flows):
    flows = make_flows([
        ("10.0.0.1", "10.9.0.1", 80), ("10.0.0.1", "10.9.0.1", None), (None, "10.9.0.1", 80), ("10.0.0.1", None, 80),
        ("::1", "10.9.0.1", None), ("bad", "10.9.0.1", 23)])
    assert _found(flows) == [
        ("cidr_pair_rule_0", "10.0.0.1/32", "10.9.0.1/32", "http", 2),
        ("cidr_pair_rule_1", "::1/32", "10.9.0.1/32", "any", 1),
        ("cidr_pair_rule_2", "bad/32", "10.9.0.1/32", "custom-ports-23", 1)]
    single = rulesets.aggregate_single_rule(flows).first()
    assert tuple(single) == ("10.0.0.1/32", "10.9.0.1/32", "http, custom-ports-23", 6)


def test_empty_log(make_flows):
    flows = make_flows([("a", "b", 1)]).limit(0)
    assert tuple(rulesets.aggregate_single_rule(flows).first()) == ("any", "any", "any", 0)
    assert _found(flows) == []
    assert rulesets.generate_lean_rule_set(flows).collect() == []


def test_single_rule_without_ipv4_lists_the_texts(make_flows):
    single = rulesets.aggregate_single_rule(make_flows([("::2", "x", 53), ("::1", "x", 53)])).first()
    assert tuple(single) == ("::1/32, ::2/32", "x/32", "dns", 2)


def test_positions_are_a_total_order(spark):
    rows = spark.range(10_000).selectExpr("id", "CAST(id * 7919 % 10007 AS STRING) AS k")
    placed = joins.with_position(rows, ["k"], "pos", "positions").orderBy("pos").collect()
    assert [r.pos for r in placed] == list(range(10_000))
    assert [r.k for r in placed] == sorted(r.k for r in placed)


def test_nothing_is_merged_at_seven(spark, make_flows):
    for pairs, tail in ((7, 0), (8, 2)):
        flows = make_flows([("10.0.0.1", f"172.{16 + i}.0.1", 80) for i in range(pairs) for _ in range(i + 1)])
        rules = rulesets.generate_cidr_pair_rules(flows)
        assert rulesets.rule_tail(rules).count() == tail
        assert (rulesets.catch_all_labels(rules).count() > 0) == (tail > 0)
        assert (rulesets.catch_all_networks(rules).count() > 0) == (tail > 0)
        got = {tuple(r) for r in rulesets.generate_lean_rule_set(flows).collect()}
        assert got == {tuple(r) for r in rulesets.cap_rules_to_seven(rules).collect()} and len(got) == 7


def test_long_lists_are_joined_in_chunks(spark):
    labels = spark.range(200_000).selectExpr("'a' AS k", "CAST(NULL AS BIGINT) AS first_addr", "'2001:db8:85a3:8d3::' || lpad(id, 6, '0') AS cidr")
    text = addresses.address_text(labels, "k").first().addresses
    assert text == ", ".join(f"2001:db8:85a3:8d3::{i:06d}" for i in range(200_000))
    rows = addresses.address_rows(labels.limit(5000), "k")
    assert [r.pos for r in rows.orderBy("cidr").collect()] == list(range(5000))
