"""Log probability of texts under a lattice of subword pieces, summed over all segmentations.

The pieces are those of a public vocabulary file, with weights from its scores. Training documents
re-weight the pieces by expectation maximisation: the lattice of every distinct training word
counts each piece by its posterior, times the word's occurrences. The file's weights stay in every
round as a prior of PRIOR_SHARE of all counts. A word is a blank and its bytes: one piece with the
blank, then pieces without until it stops. All single bytes are pieces, so every word has a
probability, and no path passes the vocabulary by. A text is its words and an end, so the
probabilities of all texts sum to one, and the score of a text is the sum over all segmentations
of all of it.

Words are counted over all documents first. A word's lattice is worked out once per distinct word
and round. Words of a batch advance together, by length: a double-array trie finds the pieces at
all places, and sums over segmentations are array operations, in plain doubles that are scaled by
a constant a byte. Words too long for these have their sums in log space, one by one; the score of
such a word only needs the sums of as many places back as the longest piece is long. The most frequent words go to all tasks, WORDS_AT_HAND of
WORD_BYTES bytes at most; the others are joined to their documents by word.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from math import exp, inf, log, log1p

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.phrases import DoubleArrayTrie
from flowsieve.sources.scratch import materialise

PASSES = 2
# The file's weights, as a share of the counts that a round works with.
PRIOR_SHARE = 0.02
# Frequent words, of at most WORD_BYTES bytes, that are sent to every task: some 10 MB.
WORDS_AT_HAND, WORD_BYTES = 200_000, 64
# Distinct words that a task holds before it hands counts on.
HELD_WORDS = 200_000
# Words whose lattices are worked out together and their bytes at most, and how far from 1 their scaled sums may be, as a logarithm.
WORDS_TOGETHER, TOGETHER_BYTES, SCALED_LOG = 2048, 64, 500.0
_LOG10 = log(10)


def _normalised(pieces: list[bytes], weights: np.ndarray, stops: float) -> tuple[np.ndarray, float]:
    """Log probabilities of first pieces among themselves and of the others with the stop."""
    first = np.array([p.startswith(b" ") for p in pieces])
    rest = weights[~first].sum() + stops
    return np.log(np.where(first, weights / weights[first].sum(), weights / rest)), log(stops / rest)


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a sentencepiece file as bytes, a blank for its word mark, and their first weights.

    Pieces that no lower-cased word can hold are left out; all 256 bytes are in, as the last ranks.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranks: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if not any(65 <= b <= 90 for b in piece) and b" " not in piece[1:]:
            ranks.setdefault(piece, -model.get_score(i))
    last = max(ranks.values(), default=0.0) + 1
    for piece in [b" ", *(bytes([b]) for b in range(256) if b != 32)]:
        ranks.setdefault(piece, last)
    pieces = sorted(ranks)
    return pieces, np.array([1.0 / (2.0 + ranks[p]) for p in pieces])


class Lattice:
    """Forward sums over the segmentations of a word. Made once per task."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray) -> None:
        self._logs = logs.tolist()
        self._longest = max(map(len, pieces), default=1)
        self._root: dict = {}
        for number, piece in enumerate(pieces):
            node = self._root
            for byte in piece:
                node = node.setdefault(byte, {})
            node[-1] = number

    def _edges(self, word: bytes, i: int) -> list[tuple[int, int]]:
        """(length, piece) of the pieces that start at place i."""
        node, here, length = self._root, [], 0
        for byte in word[i : i + self._longest]:
            node = node.get(byte)
            if node is None:
                break
            length += 1
            if -1 in node:
                here.append((length, node[-1]))
        return here

    def log_probability(self, word: bytes) -> float:
        """Of a word without its stop. Holds the sums of the places that a piece can still reach."""
        word, logs = b" " + word, self._logs
        ahead = [0.0] + [-inf] * self._longest
        for i in range(len(word)):
            base = ahead.pop(0)
            ahead.append(-inf)
            for length, number in self._edges(word, i):
                new, old = base + logs[number], ahead[length - 1]
                if old == -inf:
                    ahead[length - 1] = new
                elif new > old:
                    ahead[length - 1] = new + log1p(exp(old - new))
                else:
                    ahead[length - 1] = old + log1p(exp(new - old))
        return ahead[0]

    def count(self, word: bytes, counts: list[float], times: float = 1.0) -> None:
        """Add the posterior of every piece in the word to `counts`, `times` over. Holds 8 bytes a place."""
        word, logs = b" " + word, self._logs
        n = len(word)
        # the edges of an ordinary word are kept, those of a very long one found twice
        kept = [self._edges(word, i) for i in range(n)] if n <= 256 else None
        sums = array("d", [-inf]) * (n + 1)
        sums[0] = 0.0
        for i in range(n):
            base = sums[i]
            for length, number in kept[i] if kept else self._edges(word, i):
                new, old = base + logs[number], sums[i + length]
                if old == -inf:
                    sums[i + length] = new
                elif new > old:
                    sums[i + length] = new + log1p(exp(old - new))
                else:
                    sums[i + length] = old + log1p(exp(new - old))
        total = sums[n]
        behind = [0.0]
        for i in range(n - 1, -1, -1):
            value = -inf
            for length, number in kept[i] if kept else self._edges(word, i):
                after = behind[-length] + logs[number]
                counts[number] += times * exp(sums[i] + after - total)
                if value == -inf:
                    value = after
                elif after > value:
                    value = after + log1p(exp(value - after))
                else:
                    value = value + log1p(exp(after - value))
            behind.append(value)
            if len(behind) > 2 * self._longest:
                del behind[: -self._longest]


def piece_trie(pieces: list[bytes]) -> tuple[DoubleArrayTrie, np.ndarray]:
    """Trie of the pieces, bytes from 1, and the number of the piece that ends in each state, or the number of pieces."""
    listed = np.zeros((len(pieces), max(map(len, pieces))), dtype=np.uint16)
    for row, piece in zip(listed, pieces, strict=True):
        row[: len(piece)] = np.frombuffer(piece, dtype=np.uint8)
        row[: len(piece)] += 1
    trie = DoubleArrayTrie(listed)
    ends = np.full(len(trie.check), len(pieces), dtype=np.int32)
    ends[trie.accepting] = np.arange(len(pieces))
    return trie, ends


class Lattices:
    """The lattices of many words at once. Made once per task; every byte has to be a piece.

    The sum up to a place is multiplied by exp(shift) a byte, with the shift half of what a byte can
    cost, so that words of up to `most` bytes, their blank included, stay within doubles. Others go through a `Lattice`.
    """

    def __init__(self, pieces: list[bytes], logs: np.ndarray, trie: DoubleArrayTrie, ends: np.ndarray) -> None:
        self._pieces, self._logs, self._trie, self._ends = pieces, logs, trie, ends
        lengths = np.array([len(p) for p in pieces])
        self._shift = -float((logs / lengths).min()) / 2
        self._chances = np.append(np.exp(logs + self._shift * lengths), 0.0)
        self.most = min(TOGETHER_BYTES, int(SCALED_LOG / max(self._shift, 1.0)))
        self._single: Lattice | None = None

    def _one(self) -> Lattice:
        self._single = self._single or Lattice(self._pieces, self._logs)
        return self._single

    def _together(self, words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]]:
        """Groups of words: their places, lengths, pieces and chances by length of piece, and sums up to every place."""
        if not len(words):
            return
        words = words.cast(pa.large_binary())
        _, offsets, data = words.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
        sizes = np.diff(bounds) + 1
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] <= self.most]
        for at in range(0, len(order), WORDS_TOGETHER):
            group = order[at : at + WORDS_TOGETHER]
            n = sizes[group]
            width = int(n[-1])
            # a blank, the word's bytes and a break; 0 is no byte
            codes = np.zeros((len(group), width + 1), dtype=np.uint16)
            codes[:, 0] = 33
            inside = np.arange(1, width + 1) < n[:, None]
            row, place = np.nonzero(inside)
            codes[row, place + 1] = data[bounds[group][row] + place]
            codes[row, place + 1] += 1
            pieces, chances = [], []
            for _, state in zip(range(width), self._trie.walk(codes.reshape(-1)), strict=False):
                if not state.any():
                    break
                pieces.append(self._ends[state].reshape(codes.shape)[:, :width].T.copy())
                chances.append(self._chances[pieces[-1]])
            sums = np.zeros((width + 1, len(group)))
            sums[0] = 1.0
            for i in range(width):
                for length, chance in enumerate(chances[: width - i], 1):
                    sums[i + length] += sums[i] * chance[i]
            yield group, n, pieces, chances, sums

    def _others(self, words: pa.Array) -> list[int]:
        return np.flatnonzero(pc.binary_length(words).to_numpy() >= self.most).tolist()

    def log_probabilities(self, words: pa.Array) -> np.ndarray:
        """Of words without their stops."""
        out = np.zeros(len(words))
        for group, n, _, _, sums in self._together(words):
            out[group] = np.log(sums[n, np.arange(len(group))]) - self._shift * n
        for i in self._others(words):
            out[i] = self._one().log_probability(words[i].as_py())
        return out

    def count(self, words: pa.Array, times: np.ndarray) -> np.ndarray:
        """Sum over all words of the posterior of every piece, `times` over."""
        out = np.zeros(len(self._pieces) + 1)
        for group, n, pieces, chances, sums in self._together(words):
            each = np.arange(len(group))
            behind = np.zeros_like(sums)
            behind[n, each] = 1.0
            for i in range(len(sums) - 2, -1, -1):
                for length, chance in enumerate(chances[: len(sums) - 1 - i], 1):
                    behind[i] += chance[i] * behind[i + length]
            scale = times[group] / sums[n, each]
            for length, (piece, chance) in enumerate(zip(pieces, chances, strict=True), 1):
                here = np.nonzero(chance[: len(sums) - length])
                posterior = (sums[here] * chance[here]) * behind[here[0] + length, here[1]] * scale[here[1]]
                out += np.bincount(piece[here], posterior, minlength=len(out))
        others = self._others(words)
        if others:
            counts = [0.0] * len(self._pieces)
            for i in others:
                self._one().count(words[i].as_py(), counts, float(times[i]))
            out[:-1] += counts
        return out[:-1]


def _words(text: bytes | None) -> list[bytes]:
    # bytes split at 0x20 and 0x09-0x0D, and lower() changes A-Z alone
    return (text or b"").lower().split()


def _count_words(docs: DataFrame) -> DataFrame:
    """(word, c): every word of `docs` (held_out, text) and how often training documents have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for held, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = _words(text.as_py())
                if held:
                    for word in found:
                        counts.setdefault(word, 0)
                else:
                    counts.update(found)
                if len(counts) > HELD_WORDS:
                    yield rows()
                    counts.clear()
        yield rows()

    return docs.select("held_out", "text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _expected(words: DataFrame, pieces: list[bytes], logs: np.ndarray, trie: tuple[DoubleArrayTrie, np.ndarray]) -> np.ndarray:
    """Expected number of every piece in all training words; the driver gets a row per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices, counts = Lattices(pieces, logs, *trie), np.zeros(len(pieces))
        for batch in batches:
            counts += lattices.count(batch.column(0), batch.column(1).to_numpy())
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["piece", "n"])

    sums = words.where("c > 0").select("word", "c").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(pieces))
    out[sums["piece"].to_numpy()] = sums["n"].to_numpy()
    return out


def _with_prior(pieces: list[bytes], expected: np.ndarray, weights: np.ndarray, stops: float) -> tuple[np.ndarray, float]:
    """Log probabilities after a round: of first pieces, and of the others with the stop, the file's own weights are PRIOR_SHARE."""
    first = np.array([p.startswith(b" ") for p in pieces])
    mixed = np.zeros(len(pieces))
    for group, counted, own in ((first, expected[first].sum(), weights[first].sum()), (~first, expected[~first].sum() + stops, weights[~first].sum())):
        share = PRIOR_SHARE / (1 - PRIOR_SHARE) * max(counted, 1.0)
        mixed[group] = expected[group] + share * weights[group] / own
    return _normalised(pieces, mixed, stops)


def _with_logs(words: DataFrame, pieces: list[bytes], logs: np.ndarray, stop: float, trie: tuple[DoubleArrayTrie, np.ndarray]) -> DataFrame:
    """Add the log10 probability of every word, its stop included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(pieces, logs, *trie)
        for batch in batches:
            values = (lattices.log_probabilities(batch.column(0)) + stop) / _LOG10
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())], names=["word", "c", "log"])

    return words.mapInArrow(run, "word binary, c long, log double")


def _at_hand(scored: DataFrame) -> pa.Table:
    """(word, c, log) of the most frequent words, WORDS_AT_HAND at most: all from some count on."""
    short = scored.where(F.octet_length("word") <= WORD_BYTES)
    # counts in steps of a tenth, a few hundred of them
    step = F.floor(10 * F.log2(F.col("c") + 1))
    steps = short.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    least, held = inf, 0
    for row in steps:
        held += row.n
        if held > WORDS_AT_HAND:
            break
        least = row.step
    return short.where(step >= F.lit(float(least))).toArrow()


def _read_documents(docs: DataFrame, at_hand: pa.Table) -> DataFrame:
    """A row per document with sums over the words at hand (word is null), and one per other distinct word in it."""
    schema = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, log double, word binary, times long"
    words = at_hand["word"].to_pylist()
    counts, logs = at_hand["c"].to_numpy(), at_hand["log"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        place = {w: i for i, w in enumerate(words)}
        known, base, n = counts > 0, np.log10(counts + 1.0), len(words)
        rows: list[tuple] = []
        for batch in batches:
            for doc, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = _words(text.as_py())
                codes = np.fromiter(map(place.get, found, repeat(n)), dtype=np.int64, count=len(found))
                own = codes[codes < n]
                if len(own) < len(found):
                    others = Counter(found[i] for i in np.flatnonzero(codes == n))
                    rows += [(uid, None, None, None, None, None, None, word, times) for word, times in others.items()]
                rows.append((uid, doc, held, len(found) + 1, int(known[own].sum()), float(base[own].sum()), float(logs[own].sum()), None, None))
                uid += 1
                if len(rows) > 50_000:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64())
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[part.split()[0] for part in schema.split(", ")])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def score_documents(docs: DataFrame, vocabulary_file: str, id: str = "doc_id", text: str = "text", passes: int = PASSES) -> DataFrame:
    """Score every document by a model that the documents with crc32(id as text) mod 7 other than 2 train.

    Returns (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score). Tokens are the
    words and one end; base_score is that of a word model with one added to every count, score the
    log10 probability of the words and the end, summed over all segmentations of the words into
    pieces. Null and empty texts are an end alone. A null id is not held out; repeated rows count
    and are scored each; other columns play no part. Without training documents every count is 0
    and the pieces keep the file's weights; an empty table gives an empty result. A word of any
    length is scored in the memory of its text; one in a training document takes 8 bytes a byte.

    Runs its jobs when called.
    """
    held = F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).cast("string").cast("binary").alias("text"))
    words = materialise(_count_words(docs), "words")
    n_words, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    ends = docs.where("NOT held_out").count()
    n, v = n_words + ends, distinct + (ends > 0)

    pieces, weights = vocabulary(vocabulary_file)
    trie = piece_trie(pieces)
    logs, stop = _normalised(pieces, weights, weights.sum() / 4)
    for _ in range(passes if n_words else 0):
        logs, stop = _with_prior(pieces, _expected(words, pieces, logs, trie), weights, n_words)
    # a token is an end or a word; one kind has been seen of neither before training, and both can follow
    end = (ends + 1) / (n + 2)
    word_log, end_log = log(1 - end) / _LOG10, log(end) / _LOG10

    scored = materialise(_with_logs(words, pieces, logs, stop, trie), "word_scores")
    read = materialise(_read_documents(docs, _at_hand(scored)), "read_documents")
    rest = read.where("word IS NOT NULL").select("uid", "word", "times").join(scored, "word")
    sums = rest.groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_base"),
        F.sum(F.col("times") * F.col("log")).alias("more_log"))
    whole = read.where("word IS NULL").drop("word", "times").join(sums, "uid", "left")
    ends_known = F.lit(int(ends > 0))
    base_end, each = log(ends + 1) / _LOG10, log(n + v + 1) / _LOG10
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0)) + ends_known).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) + F.lit(base_end) - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        (F.col("log") + F.coalesce("more_log", F.lit(0.0)) + F.lit(end_log) + (F.col("n_tokens") - 1) * F.lit(word_log)).alias("score"))
