from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from flowsieve.functions import ip as ipf
from flowsieve.operators.labels import ip_to_cidr
from flowsieve.operators.networks import ip_blocks, ip_networks
from tests import brute

GOLDEN = {
    "same subnet": (
        ["192.168.1.1", "192.168.1.2", "192.168.1.10", "192.168.1.20", "192.168.1.30"], ["192.168.1.0/27"]),
    "different subnets": (
        ["192.168.1.1", "192.168.2.1", "10.0.0.1", "172.16.0.1"], ["10.0.0.1/32", "172.16.0.1/32", "192.168.0.0/22"]),
    "spread": (["192.168.1.1", "192.168.1.100", "192.168.2.1", "192.168.2.100", "192.168.3.1"], ["192.168.0.0/22"]),
    "step of 254": (["10.0.0.1", "10.0.0.2", "10.0.0.3", "10.0.1.1", "10.0.1.2", "10.0.1.3"], ["10.0.0.0/23"]),
    "single": (["192.168.1.1"], ["192.168.1.1/32"]),
    "step of 256 joins": (["10.5.0.0", "10.5.1.0"], ["10.5.0.0/23"]),
    "step of 257 splits": (["10.5.0.0", "10.5.1.1"], ["10.5.0.0/32", "10.5.1.1/32"]),
    "border, 2": (["10.0.255.250", "10.1.0.3"], ["10.0.255.250/32", "10.1.0.3/32"]),
    "border, 3": (
        ["10.0.255.250", "10.0.255.251", "10.1.0.3"], ["10.0.255.250/32", "10.0.255.251/32", "10.1.0.3/32"]),
    "border, 4": (["10.0.255.248", "10.0.255.249", "10.1.0.2", "10.1.0.3"], ["10.0.255.248/31", "10.1.0.2/31"]),
    "overlap": (
        ["10.0.1.5", "10.0.3.255", "10.0.4.0", "10.0.6.1"], ["10.0.1.5/32", "10.0.0.0/21", "10.0.6.1/32"]),
    "repeats": (["10.0.0.1", "10.0.0.1"], ["10.0.0.1/32"]),
    "invalid among valid": (["10.0.0.1", "01.2.3.4", "300.1.1.1", "::1", " 10.0.0.2", "10.0.0.3\n"], ["10.0.0.1/32"]),
    "no address": (["::1", "nowhere"], ["::1/32", "nowhere/32"]),
    "ends of the address space": (["0.0.0.0", "255.255.255.255"], ["0.0.0.0/32", "255.255.255.255/32"]),
}


def _keyed(spark, cases):
    rows = [(name, ip) for name, ips in cases.items() for ip in ips]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "k string, ip string")


def _by_key(df, value="cidr"):
    out = {}
    for row in df.orderBy("k", "first_addr", "cidr").collect():
        out.setdefault(row.k, []).append(row[value])
    return out


def test_golden_vectors(spark):
    folded = _by_key(ip_networks(_keyed(spark, {n: ips for n, (ips, _) in GOLDEN.items()}), "k"))
    assert folded == {name: expected for name, (_, expected) in GOLDEN.items()}


def test_no_keys_and_empty_input(spark):
    ips = spark.createDataFrame([(i,) for i in GOLDEN["overlap"][0]] + [(None,)], "ip string")
    assert [r.cidr for r in ip_networks(ips).orderBy("first_addr").collect()] == GOLDEN["overlap"][1]
    assert ip_networks(ips.limit(0)).collect() == []


def test_all_host_labels_every_text_of_a_key_with_a_broken_one(spark):
    cases = {"broken": ["10.0.0.1", "10.0.0.2", "x"], "ipv6 only": ["10.0.0.1", "10.0.0.2", "2001:db8::1"]}
    folded = ip_networks(_keyed(spark, cases), "k", on_invalid="all_host")
    assert _by_key(folded) == {"broken": ["10.0.0.1/32", "10.0.0.2/32", "x/32"], "ipv6 only": ["10.0.0.0/30"]}
    with pytest.raises(ValueError):
        ip_networks(_keyed(spark, cases), "k", on_invalid="drop")


def _random_sets():
    """Dense and sparse runs around /16 borders, and whole runs over several /16 blocks."""
    rng = random.Random(7)
    sets = {}
    for i in range(60):
        base = rng.choice([0, 65536, 167772160, 3232235520, 4294967296 - 200000]) + rng.randrange(0, 65536)
        step = rng.choice([1, 3, 40, 200, 300])
        n, numbers, at = rng.choice([1, 2, 3, 5, 17, 200, 1500]), set(), base
        while len(numbers) < n and at < 2**32:
            numbers.add(at)
            at += rng.randrange(1, 2 * step)
        sets[f"set{i}"] = [brute.ipaddress.IPv4Address(x).compressed for x in numbers]
    return sets


@pytest.fixture(scope="module")
def random_sets(spark):
    sets = _random_sets()
    return sets, _keyed(spark, sets).cache()


def test_random_sets_fold_like_the_model(random_sets):
    sets, ips = random_sets
    folded = _by_key(ip_networks(ips, "k"))
    for name, texts in sets.items():
        assert folded[name] == brute.fold(texts), name


def test_random_sets_get_the_models_labels(random_sets):
    sets, ips = random_sets
    found = {(r.k, r.ip): r.cidr for r in ip_to_cidr(ips, "k").collect()}
    expected = {(name, ip): cidr for name, texts in sets.items() for ip, cidr in brute.label(texts).items()}
    assert found == expected


def test_networks_of_random_sets_are_sound(random_sets):
    _, ips = random_sets
    networks = ip_networks(ips, "k")
    assert networks.where("plen < 16 OR plen > 32 OR lo > first_addr OR hi < first_addr").count() == 0
    per_block = networks.groupBy("k", F.shiftright("lo", 16)).count().agg(F.max("count")).first()[0]
    assert per_block < 400


def test_run_numbers(spark):
    ips = spark.createDataFrame(
        [("10.0.255.255",), ("10.1.0.0",), ("10.1.2.0",), ("10.3.0.0",), ("10.3.0.9",), ("x",)], "ip string")
    numbers = {r.ip: r.run_no for r in ip_blocks(ips).collect()}
    assert numbers == {"10.0.255.255": 0, "10.1.0.0": 0, "10.1.2.0": 1, "10.3.0.0": 2, "10.3.0.9": 2}


def test_overlap_labels_take_the_first_network(spark):
    ips = spark.createDataFrame([(i,) for i in [*GOLDEN["overlap"][0], "::1", "no"]], "ip string")
    labels = {r.ip: r.cidr for r in ip_to_cidr(ips).collect()}
    assert labels == {
        "10.0.1.5": "10.0.1.5/32", "10.0.3.255": "10.0.0.0/21", "10.0.4.0": "10.0.0.0/21", "10.0.6.1": "10.0.0.0/21",
        "::1": "::1/32", "no": "no/32"}


@pytest.mark.parametrize("text, is_v6", [
    ("::", True), ("::1", True), ("1::", True), ("2001:db8::1", True), ("1:2:3:4:5:6:7:8", True),
    ("1:2:3:4:5:6:7::", True), ("::2:3:4:5:6:7:8", True), ("::ffff:10.0.0.1", True), ("fe80::1%eth0", True),
    ("1:2:3:4:5:6:7", False), ("1:2:3:4:5:6:7:8:9", False), ("1::2::3", False), (":::", False), ("12345::", False),
    ("1:2:3:4:5:6:7::8", False), ("::ffff:10.0.0.01", False), ("10.0.0.1", False), ("", False), ("g::1", False),
])
def test_ipv6_texts(spark, text, is_v6):
    row = spark.createDataFrame([(text,)], "t string").selectExpr(f"{ipf.is_ipv6('t')} AS v6").first()
    assert row.v6 is is_v6
    try:
        brute.ipaddress.IPv6Address(text)
        assert is_v6
    except ValueError:
        assert not is_v6


def test_cidr_bounds(spark):
    rows = [("10.1.2.3/24",), ("0.0.0.0/0",), ("1.2.3.4/32",), ("1.2.3.4/33",), ("1.2.3.4",), ("::1/32",), ("x/32",),
            ("99999999999.1.1.1/8",)]
    df = spark.createDataFrame(rows, "c string").selectExpr("c", f"{ipf.cidr_low('c')} lo", f"{ipf.cidr_high('c')} hi")
    found = {r.c: (r.lo, r.hi) for r in df.collect()}
    assert found["10.1.2.3/24"] == (167838208, 167838463)
    assert found["0.0.0.0/0"] == (0, 2**32 - 1)
    assert found["1.2.3.4/32"] == (16909060, 16909060)
    assert all(found[t] == (None, None) for t in ("1.2.3.4/33", "1.2.3.4", "::1/32", "x/32", "99999999999.1.1.1/8"))
