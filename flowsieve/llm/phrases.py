"""Collocations: frequent phrases of 2 to 5 words, scored by their weakest cut.

A phrase can only be frequent if the phrase without its last word and the one without its first word
are (Apriori). So phrases are found level by level:

1. All words are counted per language. Texts are then written once as sequences of the numbers of
   frequent words, in which every other word is a break, like the end of a piece.
2. A level's frequent phrases form a double-array trie, which is broadcast. In every task numpy
   advances the states of all positions of a sequence at once, one array operation per word. Where
   the states at a position and at the next one both accept, a phrase that is longer by one word
   is proposed; proposals are counted in the task and summed by Spark.
3. The trie of all phrases found advances once more over everything: accepting states are counted by
   bincount, and the counts of all tasks are summed. These are the counts that the scores use.

A trie holds at most TRIE_PHRASES phrases. If a level has more, they are divided by their first word and
each part passes over the sequences by itself. Frequent words are numbered and broadcast as 8 bytes each,
up to SIEVE_WORDS of them; beyond that sequences have all words as 64-bit keys, and the tries do the rest.
Scores, cuts and the choice of the best are joins and integer arithmetic in Spark.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.text import WordHasher, mix, slices, text_bytes
from flowsieve.operators.joins import with_position
from flowsieve.sources.scratch import materialise, new_scratch_path

LONGEST = 5
LEAST_COUNT = 100
BEST = 2000
TRIE_PHRASES = 1 << 20
SIEVE_WORDS = 1 << 23
# Words of one sequence row, few enough that thousands of rows in a reader's or an Arrow batch are some
# MB; rows that leave a task as one batch; and words of as many rows as advance together.
ROW_WORDS, SENT_ROWS, STEP_WORDS = 1 << 8, 1 << 12, 1 << 17

# Pairs that a task holds before it hands their counts on, those that leave as one Arrow batch, and
# occurrences of the pairs of one bucket.
PAIRS_HELD, PAIRS_SENT, PAIRS_SUMMED = 1 << 20, 1 << 17, 1 << 19
# States whose counts are summed as one vector, first over the tasks of each of SUMMED_FIRST parts.
STATES, SUMMED_FIRST = 2048, 64

_CUTS = b".,;:!?\n\v\f\r"
_WORD = re.compile(rb"[^ \t.,;:!?\n\v\f\r]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
NO_LANGUAGE = "und"
RESULT = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


class PieceHasher(WordHasher):
    """Words of texts that are split into pieces, with the piece of each."""

    def __init__(self) -> None:
        super().__init__()
        self._space[:] = False
        self._space[list(b" \t" + _CUTS)] = True
        self._ends = np.zeros(256, dtype=bool)
        self._ends[list(_CUTS)] = True

    def placed(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, hash, row and piece of every word; a piece has one number and no other row has it."""
        data, bounds = text_bytes(column)
        starts, hashes, pieces = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        lo = before = 0
        with np.errstate(over="ignore"):
            while lo < len(data):
                hi = self._cut(data, bounds, lo)
                inside = bounds[np.searchsorted(bounds, lo, side="right") : np.searchsorted(bounds, hi, side="left")]
                s, h = self._segment(data[lo:hi], inside - lo)
                passed = np.cumsum(self._ends[data[lo:hi]], dtype=np.int64) + before
                starts.append(s + lo)
                hashes.append(h)
                pieces.append(passed[s])
                before, lo = int(passed[-1]), hi
        starts = np.concatenate(starts)
        rows = np.searchsorted(bounds, starts, side="right") - 1
        return starts, np.concatenate(hashes), rows, np.concatenate(pieces) + rows


def _keys(batch: pa.RecordBatch, hasher: PieceHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, key, row and piece of every word of (lang, text). A key stands for a language and a word; none is 0."""
    starts, hashes, rows, pieces = hasher.placed(batch.column(1))
    coded = batch.column(0).dictionary_encode()
    salts = [int.from_bytes(name.as_py().encode(), "little") * 0x9E3779B97F4A7C15 % (1 << 64) for name in coded.dictionary]
    salt = mix(np.array(salts, dtype=np.uint64))[coded.indices.to_numpy()] if salts else np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        keys = mix(hashes ^ salt[rows])
    return starts, np.where(keys == 0, np.uint64(1), keys), rows, pieces


def _word_counts(texts: DataFrame) -> DataFrame:
    """(key, lang, word, n) of (lang, text)."""

    def run(batches):
        hasher = PieceHasher()
        for whole in batches:
            for batch in slices(whole, 1):
                starts, keys, rows, _ = _keys(batch, hasher)
                found, at, counts = np.unique(keys, return_index=True, return_counts=True)
                data, bounds = text_bytes(batch.column(1))
                data, rows = data.tobytes(), rows[at]
                words = [_WORD.match(data, s, e).group().translate(_LOWER).decode() for s, e in zip(starts[at].tolist(), bounds[rows + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), batch.column(0).take(pa.array(rows)), pa.array(words, pa.string()), pa.array(counts)],
                    names=["key", "lang", "word", "n"])

    found = texts.mapInArrow(run, "key long, lang string, word string, n long")
    return found.groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))


def _sequences(texts: DataFrame, frequent: np.ndarray | None) -> DataFrame:
    """Rows of about ROW_WORDS words as binary; 0 is a break, and every row starts with one.

    `frequent` has the sorted keys of the words that stay, which are numbered from 1 by 32 bits; without
    it a word stands as its key.
    """
    kind = np.uint64 if frequent is None else np.uint32

    def run(batches):
        hasher = PieceHasher()
        for whole in batches:
            for batch in slices(whole, 1):
                _, words, _, pieces = _keys(batch, hasher)
                if frequent is not None:
                    words = _at(frequent, words.view(np.int64))
                stays = words > 0
                # a word that opens a piece, or follows one that was left out, has a break before it
                opens = np.ones(len(words), dtype=bool)
                opens[1:] = (pieces[1:] != pieces[:-1]) | ~stays[:-1]
                words, opens = words[stays], opens[stays]
                out = np.zeros(len(words) + int(opens.sum()), dtype=kind)
                out[np.arange(len(words)) + np.cumsum(opens)] = words
                # rows end at breaks, so no phrase is divided
                breaks = np.append(np.flatnonzero(out == 0), len(out))
                bounds = np.unique(breaks[np.searchsorted(breaks, np.arange(0, len(out) + ROW_WORDS, ROW_WORDS).clip(max=len(out)))])
                for at in range(0, len(bounds) - 1, SENT_ROWS):
                    part = bounds[at : at + SENT_ROWS + 1]
                    offsets = pa.array((part - part[0]) * out.itemsize, pa.int32())
                    rows = pa.Array.from_buffers(pa.binary(), len(part) - 1, [None, offsets.buffers()[1], pa.py_buffer(out[part[0] : part[-1]])])
                    yield pa.RecordBatch.from_arrays([rows], names=["words"])

    return texts.mapInArrow(run, "words binary")


def _steps(batches, kind: type):
    """The words of rows of sequences, as many rows at once as have about STEP_WORDS words."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.column(0).cast(pa.large_binary())
        _, offsets, data = rows.buffers()
        words = np.frombuffer(data, dtype=kind, count=data.size // np.dtype(kind).itemsize)
        bounds = np.frombuffer(offsets, dtype=np.int64)[rows.offset : rows.offset + len(rows) + 1] // words.itemsize
        at = 0
        while at < len(rows):
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + STEP_WORDS, side="right")) - 1)
            yield words[bounds[at] : bounds[end]]
            at = end


def _at(vocabulary: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted vocabulary from 1, or 0."""
    if not len(vocabulary):
        return np.zeros(len(keys), dtype=np.int64)
    place = np.minimum(np.searchsorted(vocabulary, keys), len(vocabulary) - 1)
    return np.where(vocabulary[place] == keys, place + 1, 0)


class DoubleArrayTrie:
    """Phrases as sequences of word codes. State s goes to t = base[s] + code if check[t] is s.

    A trie numbers its own words from 1; the root's children are these numbers. Nodes with several children look for the first base
    at which all of them are free; nodes with one child then share out the places that are left.
    """

    ROOT = -1

    def __init__(self, phrases: np.ndarray):
        """`phrases` has a row of words per phrase, shorter ones padded with 0 at the end."""
        self.vocabulary = np.unique(phrases[phrases > 0])
        codes = _at(self.vocabulary, phrases.reshape(-1)).reshape(phrases.shape)
        size = len(self.vocabulary)
        self.base = np.zeros(size + 1, dtype=np.int64)
        self.check = np.zeros(size + 1, dtype=np.int64)
        # where the search for several free places goes on; single ones fill what it leaves
        self._next = size + 1
        firsts = np.unique(codes[:, 0])
        self.check[firsts] = self.ROOT
        state = codes[:, 0].copy()
        self.depth = phrases.shape[1]
        for level in range(1, self.depth):
            longer = np.flatnonzero(codes[:, level] > 0)
            edges, own = np.unique(state[longer] * (size + 1) + codes[longer, level], return_inverse=True)
            state[longer] = self._place(edges // (size + 1), edges % (size + 1), size)[own]
        self.accepting = state

    def _place(self, parents: np.ndarray, codes: np.ndarray, size: int) -> np.ndarray:
        """States of a level's edges, which are sorted by parent."""
        starts = np.flatnonzero(np.diff(parents, prepend=-1))
        counts = np.diff(np.append(starts, len(parents)))
        states = np.zeros(len(parents), dtype=np.int64)
        for i in np.flatnonzero(counts > 1)[np.argsort(-counts[counts > 1], kind="stable")]:
            span = slice(starts[i], starts[i] + counts[i])
            states[span] = self._fit(codes[span]) + codes[span]
            self._own(parents[span], codes[span], states[span])
        single = starts[counts == 1]
        # places beyond the codes, so that no base is negative
        free = np.flatnonzero(self.check[size + 1 :] == 0)[: len(single)] + size + 1
        if len(free) < len(single):
            end, lack = len(self.check), len(single) - len(free)
            self._grow(end + lack)
            free = np.append(free, np.arange(end, end + lack))
        states[single] = free
        self._own(parents[single], codes[single], free)
        return states

    def _own(self, parents: np.ndarray, codes: np.ndarray, states: np.ndarray) -> None:
        self.base[parents] = states - codes
        self.check[states] = parents

    def _grow(self, length: int) -> None:
        if length > len(self.check):
            more = max(length, len(self.check) * 3 // 2) - len(self.check)
            self.base, self.check = (np.append(x, np.zeros(more, dtype=np.int64)) for x in (self.base, self.check))

    def _fit(self, codes: np.ndarray) -> int:
        at, step = self._next, 64
        while True:
            self._grow(at + step + int(codes[-1] - codes[0]) + 1)
            firsts = np.arange(at, at + step)
            fits = (self.check[firsts[:, None] + (codes - codes[0])] == 0).all(axis=1)
            if fits.any():
                self._next = int(firsts[np.argmax(fits)])
                return self._next - int(codes[0])
            at, step = at + step, min(step * 2, 4096)

    def walk(self, words: np.ndarray):
        """For every length from 1, the states of the phrases that start at each position, 0 where there is none."""
        codes = _at(self.vocabulary, words)
        state = np.where(self.check[codes] == self.ROOT, codes, 0)
        yield state
        for level in range(1, self.depth):
            following = np.zeros(len(words), dtype=np.int64)
            alive = np.flatnonzero(state[: len(words) - level])
            code = codes[alive + level]
            target = self.base[state[alive]] + code
            good = (code > 0) & (target < len(self.check))
            good[good] = self.check[target[good]] == state[alive[good]]
            following[alive[good]] = target[good]
            state = following
            yield state


def _summed_pairs(first: np.ndarray, last: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order with the sum of their counts, which are 1 by default."""
    if first.dtype.itemsize == 4:
        pairs = first.astype(np.uint64) << np.uint64(32) | last
        order = np.argsort(pairs, kind="stable") if n is not None else None
        pairs = np.sort(pairs) if order is None else pairs[order]
        starts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, dtype=np.int64)
        first, last = (pairs[starts] >> np.uint64(32)).astype(np.uint32), pairs[starts].astype(np.uint32)
    else:
        order = np.lexsort((last, first))
        first, last = first[order], last[order]
        starts = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (last[1:] != last[:-1]))) if len(first) else np.zeros(0, dtype=np.int64)
        first, last = first[starts], last[starts]
    if n is None:
        return first, last, np.diff(np.append(starts, len(order) if order is not None else len(pairs)))
    return first, last, np.add.reduceat(n[order], starts) if len(starts) else n[:0]


def _dealt(waiting: list[tuple[np.ndarray, np.ndarray]], buckets: int):
    """Shards (bucket, first, last, n) of the pairs in `waiting`, in batches of about PAIRS_SENT pairs; `waiting` is emptied."""
    first, last = (np.concatenate(c) for c in zip(*waiting, strict=True))
    waiting.clear()
    first, last, n = _summed_pairs(first, last)
    with np.errstate(over="ignore"):
        bucket = mix(first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ last) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    bounds = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    columns, names = (first, last, n.astype(np.uint32)), ["bucket", "first", "last", "n"]
    at = 0
    while at < len(bounds) - 1:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PAIRS_SENT, side="right")) - 1)
        spans = [order[a:b] for a, b in zip(bounds[at:end], bounds[at + 1 : end + 1], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[bounds[at:end]].astype(np.int64)), *(pa.array([c[span].tobytes() for span in spans], pa.binary()) for c in columns)], names=names)
        at = end


def _proposed(sequences: DataFrame, trie: DoubleArrayTrie | None, both: bool, least: int, kind: type, buckets: int) -> DataFrame:
    """(first, last) of the phrases that are frequent: an accepting state of the trie, or a word, and the next word.

    Counts leave a task as arrays, one per bucket of pairs, and are summed bucket by bucket.
    """
    length = trie.depth if trie else 1

    def run(batches):
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for words in _steps(batches, kind):
            if trie:
                for state in trie.walk(words):
                    pass
                good = state[:-length] > 0
                good &= (state[1 : len(words) - length + 1] > 0) if both else (words[length:] > 0)
                # states are below 2 ** 32: a trie has few phrases
                state = state.astype(kind)
            else:
                state, good = words, (words[:-1] > 0) & (words[1:] > 0)
            at = np.flatnonzero(good)
            waiting.append((state[at], words[at + length]))
            held += len(at)
            if held >= PAIRS_HELD:
                yield from _dealt(waiting, buckets)
                held = 0
        if held:
            yield from _dealt(waiting, buckets)

    def total(shards: pa.Table) -> pa.Table:
        columns = [np.concatenate([np.frombuffer(x.as_buffer(), dtype=t) for x in shards.column(c)]) for c, t in (("first", kind), ("last", kind), ("n", np.uint32))]
        first, last, n = _summed_pairs(*columns[:2], columns[2].astype(np.int64))
        often = n >= least
        return pa.table({"first": pa.array(first[often].astype(np.uint64).view(np.int64)), "last": pa.array(last[often].astype(np.uint64).view(np.int64))})

    shards = sequences.mapInArrow(run, "bucket long, first binary, last binary, n binary")
    return shards.groupBy("bucket").applyInArrow(total, "first long, last long")


def _tries(phrases: DataFrame, length: int, kind: type):
    """Tries of at most TRIE_PHRASES phrases or so, by first word; each with its phrases in order, and how many there are."""
    parts = max(1, -(-phrases.count() // TRIE_PHRASES))
    for part in range(parts):
        # one part of bounded size at a time
        rows = phrases.where(F.pmod(F.xxhash64(F.col("keys")[0]), F.lit(parts)) == part).toArrow()
        keys = np.zeros((rows.num_rows, length), dtype=np.int64)
        listed = rows.column("keys").combine_chunks() if rows.num_rows else None
        if listed is not None:
            listed = listed.chunk(0) if isinstance(listed, pa.ChunkedArray) else listed
            sizes = np.diff(listed.offsets.to_numpy())
            keys[np.arange(length) < sizes[:, None]] = listed.flatten().to_numpy()
            yield DoubleArrayTrie(keys.view(np.uint64).astype(kind)), keys, parts


def _next_level(sequences: DataFrame, shorter: DataFrame | None, length: int, least: int, kind: type, buckets: int) -> DataFrame:
    """(keys) of the frequent phrases of `length` words, from those with one word less."""
    spark = sequences.sparkSession
    if shorter is None:
        return materialise(_proposed(sequences, None, True, least, kind, buckets).select(F.array("first", "last").alias("keys")), f"phrases_{length}")
    path, written = new_scratch_path(spark, f"phrases_{length}"), []
    for trie, keys, parts in _tries(shorter, length - 1, kind):
        names = spark.createDataFrame(pa.table({"first": trie.accepting, "keys": pa.array(list(keys), pa.list_(pa.int64()))}))
        found = _proposed(sequences, trie, parts == 1, least, kind, buckets).join(names, "first")
        written.append(f"{path}/{len(written)}")
        found.select(F.concat("keys", F.array("last")).alias("keys")).write.parquet(written[-1])
    columns = "keys array<bigint>"
    return spark.read.schema(columns).parquet(*written) if written else spark.createDataFrame([], columns)


def _sum(shards: pa.Table) -> np.ndarray:
    return sum(np.frombuffer(cell.as_buffer(), dtype=np.int64) for cell in shards.column("counts"))


def _summed(shards: pa.Table) -> pa.Table:
    return pa.table({"chunk": shards.column("chunk")[:1], "part": shards.column("part")[:1], "counts": pa.array([_sum(shards).tobytes()], pa.binary())})


def _states(shards: pa.Table) -> pa.Table:
    return pa.table({"state": pa.array(shards.column("chunk")[0].as_py() * STATES + np.arange(STATES)), "a": pa.array(_sum(shards))})


def _counted(sequences: DataFrame, phrases: DataFrame, longest: int, kind: type) -> DataFrame:
    """(keys, a): the phrases with the number of their occurrences, by bincount of accepting states."""
    spark = sequences.sparkSession
    path, written = new_scratch_path(spark, "phrase_counts"), []
    for trie, keys, _ in _tries(phrases, longest, kind):

        def run(batches, trie=trie):
            totals = np.zeros(-(-len(trie.check) // STATES) * STATES, dtype=np.int64)
            for words in _steps(batches, kind):
                for state in trie.walk(words):
                    totals += np.bincount(state, minlength=len(totals))
            totals[0] = 0
            chunks = totals.reshape(-1, STATES)
            part = TaskContext.get().partitionId() % SUMMED_FIRST
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(chunks))), pa.array(np.full(len(chunks), part, dtype=np.int64)), pa.array([c.tobytes() for c in chunks], pa.binary())],
                names=["chunk", "part", "counts"])

        names = spark.createDataFrame(pa.table({"state": trie.accepting, "keys": pa.array([k[k != 0] for k in keys], pa.list_(pa.int64()))}))
        shards = sequences.mapInArrow(run, "chunk long, part long, counts binary")
        some = shards.groupBy("chunk", "part").applyInArrow(_summed, "chunk long, part long, counts binary")
        sums = some.groupBy("chunk").applyInArrow(_states, "state long, a long").where("a > 0")
        written.append(f"{path}/{len(written)}")
        sums.join(names, "state").select("keys", "a").write.parquet(written[-1])
    columns = "keys array<bigint>, a bigint"
    return spark.read.schema(columns).parquet(*written) if written else spark.createDataFrame([], columns)


def _parts(places: Column, width: Column) -> Column:
    return F.transform(places, lambda at: F.slice("keys", at, width))


def _without_covered(counted: DataFrame) -> DataFrame:
    """Phrases without those that lie inside a longer one that occurs as often."""
    widths = F.sequence(F.lit(2), F.size("keys") - 1)
    inner = F.flatten(F.transform(widths, lambda w: _parts(F.sequence(F.lit(1), F.size("keys") - w + 1), w)))
    covered = counted.where(F.size("keys") > 2).select(F.explode(inner).alias("keys"), "a").distinct()
    return counted.join(covered, ["keys", "a"], "left_anti")


def find_collocations(
    docs: DataFrame, least: int = LEAST_COUNT, best: int = BEST, longest: int = LONGEST, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """The `best` phrases of every language: (lang, rank, phrase, a, l, r, n, score).

    A-Z are lower-cased, texts are split at . , ; : ! ? and line ends into pieces and those at spaces
    and tabs into words. n counts a language's words, a the occurrences of the phrase within
    pieces (`least` or more, overlaps included), l and r those of its two parts at the cut with the
    lowest score, which is floor(1000 * a * n / (l * r)); the first of equal cuts counts. A phrase
    inside a longer frequent one that occurs as often is left out. Equal scores go by a descending,
    then by phrase.

    A null language is 'und', a null text empty; repeated rows count each; other columns are not
    read; an empty table, or one without frequent phrases, gives an empty result. Two words of one
    language with equal 64-bit hashes would count as one. Runs jobs when called.
    """
    texts = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text).alias("text"))
    words = materialise(_word_counts(texts), "word_counts")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    # numbered from 1 in the order of their keys
    frequent = with_position(words.where(F.col("n") >= least), ["key"], "at", "frequent_words").withColumn("at", F.col("at") + 1)
    sieve, kind = None, np.uint64
    if frequent.count() <= SIEVE_WORDS:
        sieve, kind = np.sort(frequent.select("key").toPandas()["key"].to_numpy(np.int64)), np.uint32
    sequences = materialise(_sequences(texts, sieve), "sequences")
    frequent = frequent.withColumn("key", F.col("key" if sieve is None else "at")).drop("at")
    # no level has more pairs than there are words
    buckets = 1 + (totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // PAIRS_SUMMED)
    levels: list[DataFrame] = []
    for length in range(2, longest + 1):
        levels.append(_next_level(sequences, levels[-1] if levels else None, length, least, kind, buckets))
    phrases = levels[0]
    for level in levels[1:]:
        phrases = phrases.unionByName(level)
    counted = materialise(_counted(sequences, phrases, longest, kind), "phrases")

    size = F.size("keys")
    cuts = F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(
        k.alias("k"), F.slice("keys", 1, k).alias("left"), F.slice("keys", k + 1, size - k).alias("right")))
    kept = _without_covered(counted).select("keys", "a", F.explode(cuts).alias("cut")).select("keys", "a", "cut.*")
    singles = frequent.select(F.array("key").alias("keys"), F.col("n").alias("count"))
    counts = singles.unionByName(counted.select("keys", F.col("a").alias("count")))
    first = frequent.select(F.col("key").alias("first"), "lang").join(F.broadcast(totals), "lang")
    cut = (
        kept.join(counts.select(F.col("keys").alias("left"), F.col("count").alias("l")), "left")
        .join(counts.select(F.col("keys").alias("right"), F.col("count").alias("r")), "right")
        .withColumn("first", F.col("keys")[0]).join(first, "first")
    )
    # products have up to 38 digits
    score = F.expr("(CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    weakest = cut.withColumn("score", score).groupBy("keys", "lang", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("weakest"))
    spelled = (
        weakest.select("keys", F.posexplode("keys").alias("at", "key"))
        .join(frequent.select("key", "word"), "key")
        .groupBy("keys").agg(F.array_join(F.sort_array(F.collect_list(F.struct("at", "word"))).getField("word"), " ").alias("phrase"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = weakest.join(spelled, "keys").select("lang", "phrase", "a", "weakest.l", "weakest.r", "n", "weakest.score")
    return ranked.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= best).select(*RESULT)
