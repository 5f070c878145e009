"""Nearest codes against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from flowsieve.llm import hamming


def brute(rows, queries, k):
    out = set()
    for q, code in queries:
        near = sorted((((code ^ c) & ((1 << 64) - 1)).bit_count(), v) for v, c in set(rows) if v != q)[:k]
        out |= {(q, rank, v, d) for rank, (d, v) in enumerate(near, 1)}
    return out


@pytest.mark.parametrize("k", [1, 5])
def test_clusters_hot_codes_and_far_queries(spark, k):
    rng = random.Random(k)

    def code():
        return rng.getrandbits(64) - (1 << 63)

    centres = [code() for _ in range(6)]
    rows = [(i, centres[0]) for i in range(900)]  # one code has a third of all rows
    for i in range(900, 2400):
        c = rng.choice(centres)
        for _ in range(rng.randrange(0, 6)):
            c ^= 1 << rng.randrange(63)
        rows.append((i, c))
    rows += [(2400, code()), (2400, code()), (7, centres[0])]
    queries = [rows[i] for i in (0, 7, 1000, 1500, 2000)] + [(9999, code())]
    df = spark.createDataFrame(rows, "vec_id long, code long")
    got = hamming.nearest(df, spark.createDataFrame(queries, "query_id long, query_code long"), k)
    assert {tuple(r) for r in got.collect()} == brute(rows, queries, k)


def test_buckets_of_several_blocks_and_repeated_query_ids(spark, monkeypatch):
    monkeypatch.setattr(hamming, "BUCKET", 16)
    rng = random.Random(3)
    # all codes share one segment; an id has three codes near each other
    rows = [(i, (rng.getrandbits(47) << 16) | 5) for i in range(1500)] + [(40, 5), (40, (1 << 20) | 5), (40, (1 << 30) | 5)]
    queries = [(40, 5), (40, (1 << 30) | 5), rows[100], rows[200]]
    got = hamming.nearest(spark.createDataFrame(rows, "vec_id long, code long"), spark.createDataFrame(queries, "query_id long, query_code long"), 4)
    assert {tuple(r) for r in got.collect()} == brute(rows, queries, 4)
    assert got.count() == 16


def test_few_rows_and_odd_vectors(spark):
    vectors = [(1, [1.0, -1.0]), (2, [0.5, None]), (3, [float("nan"), 2.0]), (None, [1.0]), (4, None), (5, [])]
    coded = hamming.codes(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))
    assert {tuple(r) for r in coded.collect()} == {(1, 1), (2, 1), (3, 2), (5, 0)}
    rows = [tuple(r) for r in coded.collect()]
    wanted = spark.createDataFrame([(1, 1)], "query_id long, query_code long")
    assert {tuple(r) for r in hamming.nearest(coded, wanted).collect()} == brute(rows, [(1, 1)], 10)
    assert hamming.nearest(coded.limit(0), wanted).count() == 0
    assert hamming.nearest(coded, wanted.limit(0)).count() == 0


def test_every_query_ends_by_proof_and_few_codes_are_compared():
    draw = np.random.default_rng(1)
    centres = draw.integers(0, 1 << 63, 500, dtype=np.uint64)
    codes = np.unique(centres[draw.integers(0, 500, 20_000)] ^ (np.uint64(1) << draw.integers(0, 64, 20_000).astype(np.uint64))
                      ^ (np.uint64(1) << draw.integers(0, 64, 20_000).astype(np.uint64)))
    index = hamming.Index(codes)
    compared = []
    look_up = index.look_up
    index.look_up = lambda *a: compared.append(len(found := look_up(*a))) or found
    for code in [*codes[::900], *draw.integers(0, 1 << 63, 3, dtype=np.uint64)]:
        for far in (hamming.BITS, 9, 0):
            compared.clear()
            at, d = index.nearest(code, 5, far)
            true = np.bitwise_count(codes ^ code).astype(int)
            border = min(far, np.partition(true, 4)[4])
            assert sorted(at.tolist()) == np.flatnonzero(true <= border).tolist() and (true[at] == d).all()
            if border <= 4:
                assert sum(compared) < len(codes) // 20


def test_queries_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(hamming, "QUERIES_PER_PASS", 3)
    monkeypatch.setattr(hamming, "BUCKET", 40)
    rng = random.Random(9)
    rows = [(i, rng.getrandbits(20)) for i in range(300)] + [(i, 77) for i in range(300, 340)] + [(5, 1), (5, 2), (5, 4)]
    queries = [rows[i] for i in (0, 5, 17, 100, 301, 339, 340, 341, 342)]
    got = hamming.nearest(spark.createDataFrame(rows, "vec_id long, code long"), spark.createDataFrame(queries, "query_id long, query_code long"), 6)
    assert {tuple(r) for r in got.collect()} == brute(rows, queries, 6) and got.count() == 6 * len(queries)
