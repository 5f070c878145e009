"""Removal of repeated passages against a plain dictionary of windows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from flowsieve.llm import queries, substring

SF = "/root/testdata/sf0.01"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(docs, window=substring.WINDOW):
    """(n_words, removed mask, kept) of (id, text) in order; ids are distinct."""
    seen, out = set(), []
    for _, text in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        words = WORD.findall((text or "").encode())
        removed = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                removed[i : i + window] = [True] * window
            seen.add(key)
        out.append((len(words), removed, b" ".join(w for w, r in zip(words, removed, strict=True) if not r)))
    return out


def compare(rows, docs, window=substring.WINDOW):
    want = dict(zip(sorted((d[0] for d in docs), key=lambda i: (i is None, i)), brute(docs, window), strict=True))
    assert len(rows) == len(docs)
    for row in rows:
        n, removed, kept = want[row.doc_id]
        mask = [False] * n
        for a, b in ((s.start, s.end) for s in row.removed):
            assert a == 0 or not mask[a - 1]
            mask[a:b] = [True] * (b - a)
        assert (row.n_words, row.n_removed, row.kept.encode()) == (n, sum(removed), kept) and mask == removed


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    ids = sorted(d[0] for d in docs)
    want = {i: (n, sum(gone), hashlib.sha256(kept).hexdigest()) for i, (n, gone, kept) in zip(ids, brute(docs), strict=True)}
    rows = queries.op11_substring_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == want and len(rows) == len(want)
    assert any(r.n_removed for r in rows)


@pytest.mark.parametrize("slice_bytes", [1, 400, None])
def test_random_texts_over_slices(spark, slice_bytes):
    draw = random.Random(7)
    phrase = " ".join(draw.choice("abcdefgh") * 3 for _ in range(30))
    docs = []
    for i in range(120):
        text = "".join(draw.choice(["a", "b", "A"]) + draw.choice([" ", "\n", "\t  ", "\x0b"]) for _ in range(draw.randrange(60)))
        docs.append((draw.randrange(10**6) * 200 + i, text + (phrase if i % 3 == 0 else "")))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    compare(substring.remove_repeats(df, 6, slice_bytes=slice_bytes).collect(), docs, 6)


def test_a_window_that_overlaps_its_own_earlier_start(spark):
    docs = [(3, "x " * 25), (1, "y " * 20), (2, "y " * 21)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in substring.remove_repeats(df).collect()}
    assert [(s.start, s.end) for s in rows[3].removed] == [(1, 25)]
    assert (rows[1].n_removed, rows[2].n_removed) == (0, 21)
    compare(rows.values(), docs)


def test_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(5, passage), (5, passage), (None, passage), (None, passage), (7, None), (8, ""), (9, " \t\r"), (4, "Ä" + passage), (6, passage.upper())]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, slice int, tie string, kept string")
    found = substring.remove_repeats(df).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept) for r in found) == sorted([
        (4, 30, 0, "Ä" + passage), (5, 30, 29, "w0"), (5, 30, 29, "w0"), (-1, 30, 30, ""), (-1, 30, 30, ""), (7, 0, 0, ""), (8, 0, 0, ""), (9, 0, 0, ""),
        (6, 30, 0, passage.upper())])
    assert substring.remove_repeats(df.limit(0)).collect() == []
    different = spark.createDataFrame([(1, passage), (1, passage + " z")], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring.remove_repeats(different).collect()) in ([0, 30], [0, 31])


def test_long_text(spark, monkeypatch):
    monkeypatch.setattr(substring, "ROUND", 1000)
    monkeypatch.setattr(substring, "PIECE", 1000)
    draw = random.Random(3)
    words = [str(draw.randrange(10**6)) for _ in range(20000)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[500:8000], *map(str, range(700)), *words[:300]])), (3, "z" * 50000)]
    compare(substring.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


def test_windows_that_share_64_bits_are_told_apart():
    high = np.array([5, 5, 5, 1, 5], dtype=np.uint64)
    low = np.array([2, 1, 2, 0, 1], dtype=np.uint32)
    order, same = substring._in_order(high, low)
    assert order.tolist() == [3, 1, 4, 0, 2] and same.tolist() == [False, False, True, False, True]


def test_planes_round_trip():
    numbers = np.array([0, 1, 1 << 63, 12345678901234567890], dtype=np.uint64)
    assert (substring._numbers(np.frombuffer(substring._planes(numbers), np.uint8), np.uint64) == numbers).all()
