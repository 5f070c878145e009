"""Collocations against counting every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowsieve.llm import phrases


def brute(docs, least=phrases.LEAST_COUNT, best=phrases.BEST, longest=phrases.LONGEST):
    totals, counts = Counter(), defaultdict(Counter)
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    rows = []
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        covered = {p[i : i + w] for p, a in candidates.items() for w in range(2, len(p)) for i in range(len(p) - w + 1) if found[p[i : i + w]] == a}
        scored = []
        for p, a in candidates.items():
            if p not in covered:
                score, _, l, r = min((1000 * a * totals[lang] // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        rows += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:best])]
    return sorted(rows)


def found(spark, docs, **options):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "lang string, text string, phrase string, n int").repartition(3)
    return sorted(tuple(r) for r in phrases.find_collocations(df, **options).collect())


def corpus(seed, n, langs=("en", "fr", None)):
    draw = random.Random(seed)
    vocabulary = [f"W{int(draw.paretovariate(0.8))}" for _ in range(60)]
    saying = ["to", "be", "Or", "not", "to", "be"]
    docs = []
    for _ in range(n):
        words = draw.choices(vocabulary, k=draw.randrange(40))
        words[len(words) // 2 : len(words) // 2] = saying if draw.random() < 0.3 else []
        docs.append((draw.choice(langs), "".join(w + draw.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for w in words)))
    return docs


@pytest.mark.parametrize("tries", [phrases.TRIE_PHRASES, 7])
def test_random_texts(spark, monkeypatch, tries):
    """Also with tries that hold few phrases each."""
    monkeypatch.setattr(phrases, "TRIE_PHRASES", tries)
    docs = corpus(1, 400)
    want = brute(docs, 8)
    assert len(want) > 100 and found(spark, docs, least=8) == want


def test_without_the_sieve_and_with_a_limit(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SIEVE_WORDS", 0)
    monkeypatch.setattr(phrases, "ROW_WORDS", 50)
    docs = corpus(2, 200)
    assert found(spark, docs, least=5, best=9) == brute(docs, 5, 9)


def test_odd_rows(spark):
    docs = [(None, None), ("en", ""), ("en", " \t"), ("en", ".,;"), ("", "a b"), ("", "a b"), ("und", "x y z"), (None, "x y z"), ("fr", "É É É É"), ("fr", "é É")]
    docs += [("de", "p q " * 500 + "w" * 200_000), ("xx", "a"), ("xx", "a b")]
    assert found(spark, docs, least=2) == brute(docs, 2)
    assert found(spark, [("en", "a b"), ("fr", "a b")], least=2) == [] == found(spark, [], least=2)


def test_words_of_neighbouring_texts_do_not_meet(spark):
    docs = [("en", "a"), ("en", "b")] * 5 + [("en", "c d")] * 3
    assert [r[2] for r in found(spark, docs, least=3)] == ["c d"]


def test_trie_walks_like_a_dictionary():
    draw = np.random.default_rng(4)
    known = {tuple(draw.integers(1, 40, draw.integers(2, 5)).tolist()) for _ in range(300)}
    known |= {p[:k] for p in known for k in range(1, len(p))}
    listed = sorted(known)
    rows = np.zeros((len(listed), 4), dtype=np.uint64)
    for i, p in enumerate(listed):
        rows[i, : len(p)] = p
    trie = phrases.DoubleArrayTrie(rows)
    assert len(set(trie.accepting.tolist())) == len(listed)
    name = dict(zip(trie.accepting.tolist(), listed, strict=True))
    text = draw.integers(0, 45, 5000).astype(np.uint64)
    for length, state in enumerate(trie.walk(text), 1):
        for i, s in enumerate(state.tolist()):
            phrase = tuple(text[i : i + length].tolist())
            assert name.get(s) == (phrase if len(phrase) == length and phrase in known else None)


def test_sequences_are_small_rows(spark):
    """Thousands of rows are read at a time, so a row may not have more than some words beyond a long piece."""
    docs = [("en", "a b c d. " * 20_000), ("en", "e " * 3000)]
    rows = [r.words for r in phrases._sequences(spark.createDataFrame(docs, "lang string, text string").coalesce(1), None).collect()]
    sizes = sorted(len(r) // 8 for r in rows)
    assert sizes[-1] > 3000 and sizes[-2] < 2 * phrases.ROW_WORDS and sum(sizes) == 100_000 + 3001
    assert all(r[:8] == bytes(8) for r in rows)


def test_steps_join_whole_rows():
    import pyarrow as pa

    draw = np.random.default_rng(7)
    rows = [np.append(0, draw.integers(1, 99, n)).astype(np.uint32) for n in (5, 300_000, 1, *[200] * 2000)]
    batch = pa.RecordBatch.from_arrays([pa.array([b"skip", *(r.tobytes() for r in rows)], pa.binary())], names=["words"]).slice(1)
    steps = list(phrases._steps([batch.slice(0, 0), batch], np.uint32))
    assert np.array_equal(np.concatenate(steps), np.concatenate(rows)) and all(s[0] == 0 for s in steps)
    assert sorted(map(len, steps))[-2] <= phrases.STEP_WORDS < 4 * sorted(map(len, steps))[-2]


@pytest.mark.parametrize("kind", [np.uint32, np.uint64])
def test_pairs_leave_in_small_batches(monkeypatch, kind):
    monkeypatch.setattr(phrases, "PAIRS_SENT", 1000)
    draw = np.random.default_rng(8)
    waiting = [(draw.integers(1, 200, 4000).astype(kind), draw.integers(1, 200, 4000).astype(kind)) for _ in range(5)]
    want = Counter(p for w in waiting for p in zip(*(x.tolist() for x in w), strict=True))
    got, buckets = Counter(), []
    for batch in phrases._dealt(waiting, 64):
        assert sum(len(n.as_py()) // 4 for n in batch["n"]) <= 1000
        for row in batch.to_pylist():
            buckets.append(row["bucket"])
            got.update(dict(zip(zip(np.frombuffer(row["first"], kind).tolist(), np.frombuffer(row["last"], kind).tolist(), strict=True), np.frombuffer(row["n"], np.uint32).tolist(), strict=True)))
    assert got == want and sorted(set(buckets)) == sorted(buckets) and not waiting


def test_a_deep_trie_stays_small():
    draw = np.random.default_rng(5)
    rows = np.unique(draw.integers(1, 200, (500, 20)), axis=0).astype(np.uint64)
    trie = phrases.DoubleArrayTrie(rows)
    assert len(trie.check) < 3 * rows.size
