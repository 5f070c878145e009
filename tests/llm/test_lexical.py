"""Ranked search against scoring every document, and what it may pass over."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowsieve.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    counted = [(i, Counter(split(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_all, occurrences = len(counted), sum(sum(c.values()) for _, c in counted)
    held = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * n_all) // occurrences
            score = sum(
                math.floor(1000 * math.log((2 * n_all + 2) / (2 * held[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
                for t in split(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    a = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(3)
    b = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int")
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in lexical.rank_documents(a, b, **options).collect()), key=str)


def corpus(seed, n):
    draw = random.Random(seed)
    vocabulary = [f"w{int(draw.paretovariate(0.7))}" for _ in range(400)]
    return [(i, draw.choice([" ", ", ", "\n-"]).join(draw.choices(vocabulary, k=draw.randrange(1, 60)))) for i in range(n)]


@pytest.mark.parametrize("cells", [lexical.CELLS, 2000])
def test_random_documents(spark, monkeypatch, cells):
    monkeypatch.setattr(lexical, "CELLS", cells)
    docs, items = corpus(1, 700), corpus(2, 25)
    assert found(spark, docs, items) == brute(docs, items)


def test_several_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical, "MAX_TERMS", 40)
    docs, items = corpus(3, 200), corpus(4, 9)
    assert found(spark, docs, items, k=5) == brute(docs, items, 5)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "!?"), (4, "Straße ÄB ab"), (4, "Straße ÄB ab"), (None, "ab ab"), (5, "AB"), (7, "zz"), (8, "zz yy"), (9, "xx")]
    docs += [(20 + i, "tie word") for i in range(30)] + [(100, "ab " * 5000 + "q" * 100_000)]
    items = [(1, "straße äb"), (1, "STRASSE ÄB"), (None, "ab AB"), (3, None), (4, "- "), (5, "word tie word"), (6, "absent"), (7, "zz")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def test_pieces_of_a_long_text(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 7)
    text = "One two-three four;fiveé, Sixsixsixsixsix " * 3
    assert [t.decode() for part in lexical.terms(text) for t in part] == split(text)


def test_blocks_are_passed_over_only_below_the_least_score():
    """Few documents are compared, and none is missed."""
    draw = np.random.default_rng(5)
    block = lexical.QueryBlock()
    for q in range(10):
        block.add(q, " ".join(f"t{t}" for t in draw.integers(0, 300, 12)))
    size = len(block.vocabulary)
    weights = draw.integers(1, 9000, size)
    ranking = lexical.Ranking(block, weights, 5)
    want = defaultdict(list)
    for shard in range(6):
        cells = np.where(draw.random((500, size)) < 0.05, draw.integers(1, 900_000, (500, size)), 0)
        rows, listed = np.nonzero(cells)
        ids = np.stack([np.zeros(500, dtype=np.int64), np.arange(500) + 500 * shard], axis=1)
        ranking.add(ids, rows, listed, cells[rows, listed])
        for q, counts in enumerate(block.counts):
            scores = sum(cells[:, t] * int(weights[t]) * c for t, c in counts.items())
            want[q] += [(-int(s), int(i)) for s, i in zip(scores, ids[:, 1], strict=True) if s > 0]
    for q in range(10):
        assert [(-s, i) for s, (_, i) in zip(ranking.scores[q].tolist(), ranking.documents[q].tolist(), strict=True)] == sorted(want[q])[:5]
    assert ranking.passed_over > ranking.compared > 0


def test_queries_beyond_the_exact_doubles():
    block = lexical.QueryBlock()
    block.add(1, "a " * 1_000_000)
    ranking = lexical.Ranking(block, np.array([20_000]), 3)
    assert ranking.kind is np.int64
    ranking.add(np.array([[0, 7]]), np.array([0]), np.array([0]), np.array([999_999]))
    assert ranking.scores[0].tolist() == [20_000 * 1_000_000 * 999_999]
