"""The lattice model against all segmentations, and scores against a direct computation."""

from __future__ import annotations

import zlib
from collections import Counter
from math import exp, isclose, log, log10

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from flowsieve.llm import lattice_lm, queries

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def all_ways(word, chance):
    """Sum over all segmentations, by recursion."""
    if not word:
        return 1.0
    return sum(chance[word[:n]] * all_ways(word[n:], chance) for n in range(1, len(word) + 1) if word[:n] in chance)


def test_forward_sums_all_segmentations_and_posteriors_add_up():
    chance = {b" a": 0.3, b" ab": 0.2, b" ": 0.5, b"a": 0.1, b"b": 0.2, b"ab": 0.3, b"ba": 0.25, b"aba": 0.15}
    pieces = sorted(chance)
    lattice = lattice_lm.Lattice(pieces, np.log([chance[p] for p in pieces]))
    for word in (b"a", b"b", b"abab", b"bbabaab", b"ab" * 9):
        assert isclose(exp(lattice.log_probability(word)), all_ways(b" " + word, chance), rel_tol=1e-9)
        counts = [0.0] * len(pieces)
        lattice.count(word, counts)
        assert isclose(sum(c * len(p) for c, p in zip(counts, pieces, strict=True)), len(word) + 1, rel_tol=1e-9)


def test_weights_are_distributions():
    pieces, weights = lattice_lm.vocabulary(VOCABULARY)
    assert len(set(pieces)) == len(pieces) and all(bytes([b]) in set(pieces) for b in range(256) if b != 32)
    logs, stop = lattice_lm._normalised(pieces, weights, 3.0)
    first = np.array([p.startswith(b" ") for p in pieces])
    assert isclose(np.exp(logs[first]).sum(), 1) and isclose(np.exp(logs[~first]).sum() + exp(stop), 1)


def test_long_words_in_little_memory():
    import tracemalloc

    pieces, weights = lattice_lm.vocabulary(VOCABULARY)
    logs, _ = lattice_lm._normalised(pieces, weights, 1.0)
    lattice = lattice_lm.Lattice(pieces, logs)
    word = b"abrakadabra" * 10_000
    tracemalloc.start()
    long = lattice.log_probability(word)
    assert tracemalloc.get_traced_memory()[1] < 1 << 20
    counts = [0.0] * len(pieces)
    tracemalloc.reset_peak()
    lattice.count(word, counts, 2.0)
    assert tracemalloc.get_traced_memory()[1] < 20 * len(word)
    tracemalloc.stop()
    assert isclose(sum(c * len(p) for c, p in zip(counts, pieces, strict=True)), 2 * (len(word) + 1), rel_tol=1e-6)
    # far from the ends every repeat adds the same
    assert isclose(long - lattice.log_probability(word[11:]), lattice.log_probability(word[: 11 * 60]) - lattice.log_probability(word[: 11 * 59]), rel_tol=1e-6)


def test_the_files_weights_stay_as_a_prior():
    pieces, weights = lattice_lm.vocabulary(VOCABULARY)
    expected = np.zeros(len(pieces))
    expected[pieces.index(b" the")] = 900
    expected[pieces.index(b"e")] = 50
    logs, stop = lattice_lm._with_prior(pieces, expected, weights, 900)
    first = np.array([p.startswith(b" ") for p in pieces])
    assert isclose(np.exp(logs[first]).sum(), 1) and isclose(np.exp(logs[~first]).sum() + exp(stop), 1)
    other = first & (expected == 0)
    assert isclose(np.exp(logs[other]).sum() / (weights[other].sum() / weights[first].sum()), lattice_lm.PRIOR_SHARE, rel_tol=1e-9)


def direct(docs, passes):
    """{position: (n_tokens, n_known, N, base, score)} in plain Python."""
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs]
    words = [(t or "").encode().lower().split() for _, t in docs]
    counts = Counter(w for h, ws in zip(held, words, strict=True) if not h for w in ws)
    ends = held.count(False)
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    pieces, weights = lattice_lm.vocabulary(VOCABULARY)
    logs, stop = lattice_lm._normalised(pieces, weights, weights.sum() / 4)
    for _ in range(passes if counts else 0):
        expected = [0.0] * len(pieces)
        lattice = lattice_lm.Lattice(pieces, logs)
        for w, c in counts.items():
            lattice.count(w, expected, c)
        logs, stop = lattice_lm._with_prior(pieces, np.array(expected), weights, sum(counts.values()))
    lattice = lattice_lm.Lattice(pieces, logs)
    end = (ends + 1) / (n + 2)

    out = []
    for ws in words:
        score = base = 0.0
        for w in ws:
            score += (log(1 - end) + lattice.log_probability(w) + stop) / log(10)
            base += log10((counts[w] + 1) / (n + v + 1))
        score += log10(end)
        base += log10((ends + 1) / (n + v + 1))
        out.append((len(ws) + 1, sum(counts[w] > 0 for w in ws) + (ends > 0), n, base, score))
    return out


def test_whole_texts_against_all_segmentations(spark):
    """A text's score is the sum over every way to cut all of its words, by plain recursion."""
    docs = [(d, t) for d, t in enumerate(["ab ba abab", "b", "", "aab abba a"])]
    rows = {r.doc_id: r.score for r in lattice_lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), VOCABULARY, passes=0).collect()}
    pieces, weights = lattice_lm.vocabulary(VOCABULARY)
    logs, stop = lattice_lm._normalised(pieces, weights, weights.sum() / 4)
    chance = dict(zip(pieces, np.exp(logs).tolist(), strict=True))
    ends = sum(zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in docs)
    n = ends + sum(len(t.split()) for d, t in docs if zlib.crc32(str(d).encode()) % 7 != 2)
    for d, text in docs:
        whole = (ends + 1) / (n + 2)
        for word in text.encode().split():
            whole *= (1 - (ends + 1) / (n + 2)) * exp(stop) * all_ways(b" " + word, chance)
        assert isclose(rows[d], log10(whole), rel_tol=1e-9)


def compare(rows, want):
    got = sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:3] == b[:3] and isclose(a[3], b[3], rel_tol=1e-6) and isclose(a[4], b[4], rel_tol=1e-6)


@pytest.mark.parametrize("at_hand", [0, 3, 200_000])
def test_scores_of_odd_texts(spark, monkeypatch, at_hand):
    monkeypatch.setattr(lattice_lm, "WORDS_AT_HAND", at_hand)
    texts = [None, "", "The the THE cat", "the cat sat on the mat the end", "É é 日本 \x0b cat", "q" * 3000 + " cat cat", "unseen words here", "cat " * 400]
    docs = list(enumerate(texts)) + [(None, "the cat"), (3, "the cat sat")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"c": F.lit(1), "word": F.lit("x"), "log": F.lit(0)})
    compare(lattice_lm.score_documents(df, VOCABULARY).collect(), direct(docs, lattice_lm.PASSES))


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op2_lattice_likelihood(spark, SF).collect()
    compare(rows, direct(docs, lattice_lm.PASSES))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)


def test_empty_and_untrained(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lattice_lm.score_documents(empty, VOCABULARY).count() == 0
    only_held = [(d, "a b") for d in range(60) if zlib.crc32(str(d).encode()) % 7 == 2]
    rows = lattice_lm.score_documents(spark.createDataFrame(only_held, "doc_id long, text string"), VOCABULARY).collect()
    compare(rows, direct(only_held, 0))


def some_words(seed, n):
    draw = np.random.default_rng(seed)
    syllables = ["th", "er", "ing", "tion", "an", "q", "é", "日", "7", "0x", "-", "the", "\x00"]
    return list({"".join(draw.choice(syllables, draw.integers(1, 8))).encode() for _ in range(n)})


@pytest.mark.parametrize("together", [7, 2048])
def test_words_together_as_one_by_one(monkeypatch, together):
    """Also words around the length from which they go one by one, and a slice of a column."""
    import pyarrow as pa

    monkeypatch.setattr(lattice_lm, "WORDS_TOGETHER", together)
    pieces, weights = lattice_lm.vocabulary(VOCABULARY)
    trie = lattice_lm.piece_trie(pieces)
    logs, _ = lattice_lm._normalised(pieces, weights, 2.0)
    many, one = lattice_lm.Lattices(pieces, logs, *trie), lattice_lm.Lattice(pieces, logs)
    words = [*some_words(3, 300), b"", bytes([255, 0, 128]), *(b"\xff" * n for n in range(many.most - 3, many.most + 3)), b"the" * 500]
    times = np.arange(1, len(words) + 1)
    column = pa.array([b"skipped", *words], pa.binary()).slice(1)
    want = [one.log_probability(w) for w in words]
    assert np.allclose(many.log_probabilities(column), want, rtol=1e-10, atol=0)
    counts = [0.0] * len(pieces)
    for word, n in zip(words, times.tolist(), strict=True):
        one.count(word, counts, n)
    assert np.allclose(many.count(column, times), counts, rtol=1e-9, atol=1e-12)
    assert len(many.log_probabilities(column[:0])) == 0 == many.count(column[:0], times[:0]).sum()


def test_words_together_take_less_time():
    import time

    import pyarrow as pa

    pieces, weights = lattice_lm.vocabulary(VOCABULARY)
    trie = lattice_lm.piece_trie(pieces)
    logs, _ = lattice_lm._normalised(pieces, weights, 2.0)
    many, one = lattice_lm.Lattices(pieces, logs, *trie), lattice_lm.Lattice(pieces, logs)
    words = some_words(4, 20_000)[:10_000]
    column, times, counts = pa.array(words, pa.binary()), np.ones(len(words)), [0.0] * len(pieces)
    start = time.process_time()
    many.count(column, times)
    between = time.process_time()
    for word in words:
        one.count(word, counts)
    assert 2 * (between - start) < time.process_time() - between
