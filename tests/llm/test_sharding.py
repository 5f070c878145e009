"""Shards by their law, on the tables and on awkward ones."""

from __future__ import annotations

import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from flowsieve.llm import queries, sharding


def check(rows, docs, shards, slack):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows if r.doc_id is not None) == sorted(
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs if d is not None)
    assert len(rows) == len(docs) and all(r.law == "bytes" and r.grown_shard is None for r in rows)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))
    mean = sum(sizes.values()) / shards
    assert all(abs(sizes[s] - mean) <= slack + 0.03 * mean for s in range(shards))


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op4_sampled_splitter_sharding(spark, sf).collect()
    check(rows, docs, 24, max(len(t.encode()) for _, t in docs))


def test_hot_text_is_subdivided_and_small_groups_stay_together(spark):
    docs = [(i, "the same text") for i in range(3000)] + [(3000 + i, f"text {i % 2000}") for i in range(6000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"size": F.lit(0), "shard": F.lit("x"), "hash": F.lit(1)})
    rows = sharding.assign_shards(df, 8).collect()
    check(rows, docs, 8, 200)
    homes = defaultdict(set)
    text = dict(docs)
    for r in rows:
        homes[text[r.doc_id]].add(r.shard)
    assert len(homes.pop("the same text")) > 1
    assert all(len(s) == 1 for s in homes.values())


def test_odd_rows(spark, tmp_path):
    docs = [(None, None), (None, "x"), (1, None), (1, None), (2, ""), (3, "é" * 9), (-(1 << 63), "é" * 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = sharding.assign_shards(df, 3).collect()
    check(rows, docs, 3, 30)
    assert sharding.assign_shards(df.limit(0)).count() == 0
    unique = df.where("doc_id > 1")
    sharding.write_shards(unique, str(tmp_path / "out"), 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.text for r in back.collect()) == sorted(r.text for r in unique.collect())
