"""Near-duplicate groups against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from flowsieve.llm import minhash, queries
from flowsieve.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def brute(rows, words, percent=80):
    """{id: (n_shingles, component)} by comparing all pairs."""
    sets = {}
    for key, text in rows:
        w = (text or "").encode().lower().split()
        runs = [tuple(w[i : i + words]) for i in range(len(w) - words + 1)] or ([tuple(w)] if w else [])
        sets[key] = set(runs)
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def edited(words, n, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95)] + [(200 - i, 200) for i in range(1, 9)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 90 for i in (90, 95, 100)}, **{i: 192 for i in range(192, 201)}}


def test_query_matches_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    result = queries.op1_minhash_near_dedup(spark, SF)
    assert found(result) == brute(rows, 2)
    assert result.where("kept <> (doc_id = component_id)").count() == 0


def test_edited_copies_and_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "BLOCK_DOCUMENTS", 5)
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    other = [f"v{rng.randrange(400)}" for _ in range(60)]
    texts = [edited(base, rng.randrange(0, 14), rng) for _ in range(50)]
    texts += [edited(other, rng.randrange(0, 9), rng) for _ in range(30)]
    texts += [None, "", "  \t\n", "one", "ONE ", "one two", "One\x0btwo", "one", "Ä b", "ä b", "a " * 4000, "a a a", "y" * 3_000_000]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"component": F.lit("x"), "key": F.lit(1), "n_shingles": F.lit(2)})
    assert found(minhash.near_duplicates(df, words=2)) == brute(rows, 2)
    want = brute(rows, 5)
    assert found(minhash.near_duplicates(df)) == want


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "a b c"), (None, None), (4, "a b c"), (4, "a b c"), (7, "a b c"), (7, "q r s"), (9, "q r s")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id is not None} == {4}
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("size", [1, 2, 5])
def test_segments_cut_between_words(size):
    import numpy as np
    import pyarrow as pa

    from flowsieve.llm import text

    rng = random.Random(size)
    texts = [" ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 60))) for _ in range(40)] + [None, "z" * 500, " q"]
    hasher = text.WordHasher()
    whole = hasher.words(pa.array(texts))
    before, text.SEGMENT = text.SEGMENT, 50
    try:
        parts = text.WordHasher().words(pa.array(texts))
    finally:
        text.SEGMENT = before
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
    assert whole[1].tolist() == [len((t or "").split()) for t in texts]
    runs, each = text.windows(*whole, size)
    assert each.tolist() == [max(0, n - size + 1) for n in whole[1].tolist()] and len(runs) == each.sum()
