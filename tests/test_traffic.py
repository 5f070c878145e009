from __future__ import annotations

import random
from collections import Counter

from flowsieve.operators import graph, traffic
from flowsieve.operators.networks import invalid_ips


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_stats_ignore_nulls(make_flows):
    flows = make_flows([("a", "x", 1), ("a", None, 1), (None, "x", None), ("b", "y", 2)])
    assert _rows(traffic.basic_stats(flows)) == [(4, 2, 2, 2)]
    assert _rows(traffic.basic_stats(flows.limit(0))) == [(0, 0, 0, 0)]


def test_ties_at_rank_ten_follow_the_key(make_flows):
    rows = [(f"s{i:02d}", "d", 80) for i in range(12) for _ in range(3 if i == 11 else 1)]
    random.Random(2).shuffle(rows)
    assert [r[0] for r in _rows(traffic.top_source_ips(make_flows(rows)))] == ["s11", *[f"s{i:02d}" for i in range(9)]]


def test_top_pairs_drop_half_known_pairs(make_flows):
    flows = make_flows([("a", "b", 1), ("a", None, 1), (None, "b", 1), ("a", "b", 2)])
    assert _rows(traffic.top_pairs(flows)) == [("a -> b", 2)]


def test_unusual_ports_skip_named_and_missing(make_flows):
    flows = make_flows([("a", "b", p) for p in (80, 443, 23, 23, 8080, None)])
    assert _rows(traffic.unusual_ports(flows)) == [(23, 2), (8080, 1)]


def test_rare_pairs_are_below_five_in_text_order(make_flows):
    flows = make_flows([("b", "x", 1)] * 4 + [("a", "y", 1)] * 5 + [("a", "z", 1)])
    assert _rows(traffic.low_occurrence_pairs(flows)) == [("a", "z", 1), ("b", "x", 4)]


def test_results_are_the_same_on_a_summary(make_flows):
    rng = random.Random(5)
    rows = [(f"s{rng.randrange(30)}", f"d{rng.randrange(9)}", rng.choice([80, 23, 8080, None]), "r") for _ in range(2000)]
    flows = make_flows(rows)
    summary = traffic.summarise_flows(flows)
    assert sum(r.flow_count for r in summary.collect()) == 2000
    for operator in (traffic.basic_stats, traffic.top_source_ips, traffic.top_destination_ports, traffic.top_pairs,
                     traffic.unusual_ports, traffic.low_occurrence_pairs, graph.graph_edges):
        assert _rows(operator(flows)) == _rows(operator(summary))
    counted = Counter(r[0] for r in rows)
    assert _rows(traffic.top_source_ips(flows)) == sorted(counted.items(), key=lambda kv: (-kv[1], kv[0]))[:10]


def test_invalid_addresses_with_side_and_reason(make_flows):
    flows = make_flows([("10.0.0.1", "::1", 1), (None, "::1", 1), ("01.2.3.4", "10.0.0.1", 1)])
    assert set(_rows(invalid_ips(flows))) == {
        ("destination", "::1", "not_ipv4", 2), ("source", "01.2.3.4", "not_ipv4", 1), ("source", None, "missing", 1)}


def test_node_on_both_sides_has_its_last_type(make_flows):
    flows = make_flows([("a", "b", 1)] * 3 + [("b", "c", 1)] * 2 + [("c", "a", 1)])
    assert _rows(graph.graph_edges(flows)) == [("a", "b", 3, 0.3), ("b", "c", 2, 0.2), ("c", "a", 1, 0.1)]
    assert sorted(_rows(graph.graph_nodes(flows))) == [
        ("a", "destination", "lightgreen"), ("b", "source", "skyblue"), ("c", "source", "skyblue")]


def test_hours_zones_and_after_hours(spark):
    flows = spark.sql("""SELECT CAST(t AS TIMESTAMP_NTZ) AS ts, 'in' AS ingress_zone, z AS egress_zone
        FROM VALUES ('2024-01-05 07:59:59', 'a'), ('2024-01-05 08:00:00', 'a'), ('2024-01-05 18:00:00', 'b'),
                    ('2024-01-06 12:00:00', NULL) AS v(t, z)""")
    assert sorted(_rows(traffic.traffic_by_hour(flows))) == [(7, 6, 1), (8, 6, 1), (12, 7, 1), (18, 6, 1)]
    assert set(_rows(traffic.traffic_by_zone(flows))) == {("in", "a", 2), ("in", "b", 1), ("in", None, 1)}
    assert [str(r.ts) for r in traffic.after_hours(flows).orderBy("ts").collect()] == [
        "2024-01-05 07:59:59", "2024-01-05 18:00:00", "2024-01-06 12:00:00"]
