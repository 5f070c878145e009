"""Exact removal of repeated passages: every window of `window` words is hashed and counted.

The first occurrence of a window, in the order of (doc_id, place in the text), stays; the words of
all later ones go. Windows are judged on the input, so what goes is the union of the repeated
windows, as maximal intervals of words.

1. Documents are ordered by (doc_id, hash of the text) and cut into slices of nearly equal bytes, so
   the order of slices is the order of documents. Texts are shuffled once, by slice.
2. Each slice rolls a Rabin-Karp hash of 96 bits over its words, sorts the hashes and drops those that
   it holds twice: a passage that fills a third of all rows is one entry a slice from there on. The
   sorted hashes are dealt by their leading bits, as byte planes: of sorted numbers the leading
   planes are runs, which the shuffle's compression removes.
3. A bucket of hashes counts the occurrences of each one over all slices. Its answer to a slice is one
   bit per hash, whether an earlier slice holds it. No positions travel in either direction.
4. A slice meets its bits, hashes its words again, and merges repeated windows into intervals.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.text import WordHasher, mix
from flowsieve.sources.scratch import materialise

WINDOW = 20
# A slice has a 512th of the text, within these bytes, unless there would be more than MAX_SLICES.
LEAST_SLICE, MOST_SLICE, MAX_SLICES = 2 << 20, 16 << 20, 1_000_000
# A bucket has a 512th of all windows, within these numbers.
LEAST_BUCKET, MOST_BUCKET = 1 << 18, 1 << 22
PARTS = 512
# Words of one round of rolling, and bytes of one round of splitting a text.
ROUND, PIECE = 1 << 20, 1 << 20
# two odd bases; any will do
_BASES = (0x9E3779B97F4A7C55, 0xC2B2AE3D27D4EB4F)

RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string"


class CasedWordHasher(WordHasher):
    """Words as they are written."""

    def __init__(self) -> None:
        super().__init__()
        self._lower = np.arange(256, dtype=np.uint8)


class Roller:
    """Rabin-Karp hashes of all windows of a sequence of word hashes."""

    def __init__(self, window: int):
        self.window = window
        n = ROUND + window
        with np.errstate(over="ignore"):
            self._powers = [self._table(base, n) for base in _BASES]
            self._inverses = [self._table(pow(base, -1, 1 << 64), n) for base in _BASES]

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        table = np.full(n, base, dtype=np.uint64)
        table[0] = 1
        return np.cumprod(table, dtype=np.uint64)

    def _roll(self, words: np.ndarray, which: int) -> np.ndarray:
        """The sum of word * base ** place over a window, divided by base ** start."""
        n = len(words) - self.window + 1
        sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * self._powers[which][: len(words)], out=sums[1:])
        return mix((sums[self.window :] - sums[:n]) * self._inverses[which][:n])

    def windows(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first words, 64 bits, 32 more bits) of all windows that lie inside one text."""
        ends = np.repeat(np.cumsum(counts), counts)
        starts = np.flatnonzero(np.arange(len(words)) + self.window <= ends)
        high, low = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint32)]
        with np.errstate(over="ignore"):
            for at in range(0, len(words) - self.window + 1, ROUND):
                part = words[at : at + ROUND + self.window - 1]
                high.append(self._roll(part, 0))
                low.append((self._roll(part, 1) >> np.uint64(32)).astype(np.uint32))
        return starts, np.concatenate(high)[starts], np.concatenate(low)[starts]


def _in_order(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by (high, low), and which of the ordered entries equals the one before it."""
    order = np.argsort(high, kind="stable")
    h, w = high[order], low[order]
    same = np.zeros(len(h), dtype=bool)
    same[1:] = h[1:] == h[:-1]
    if (same[1:] & (w[1:] != w[:-1])).any():
        # different windows that share 64 bits
        order = np.lexsort((low, high))
        h, w = high[order], low[order]
        same[1:] = h[1:] == h[:-1]
    same[1:] &= w[1:] == w[:-1]
    return order, same


def _planes(numbers: np.ndarray) -> bytes:
    width = numbers.dtype.itemsize
    return numbers.byteswap().view(np.uint8).reshape(-1, width).T.tobytes()


def _numbers(planes: np.ndarray, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(kind).byteswap()


def _keys(ids: pa.Array, ties: pa.Array) -> list[tuple[bool, int, int]]:
    """The order of documents; those without an id come last."""
    return [(i is None, i or 0, t) for i, t in zip(ids.to_pylist(), ties.to_pylist(), strict=True)]


def _sliced(docs: DataFrame, slice_bytes: int | None) -> tuple[DataFrame, int]:
    """(slice, doc_id, tie, text, copies), and the bytes of all texts."""
    # one row per document, however often it is repeated
    sizes = materialise(
        docs.select("doc_id", "tie", F.octet_length("text").alias("size")).groupBy("doc_id", "tie").agg(F.max("size").alias("size")),
        "document_sizes")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    most = slice_bytes or max(min(max(total // PARTS, LEAST_SLICE), MOST_SLICE), total // MAX_SLICES)

    def cut(batches):
        filled = most
        for batch in batches:
            starts = []
            for row, size in enumerate(batch.column(2).to_pylist()):
                if filled >= most:
                    starts.append(row)
                    filled = 0
                filled += size
            yield batch.select(["doc_id", "tie"]).take(pa.array(starts, pa.int64()))

    by = [F.col("doc_id").asc_nulls_last(), "tie"]
    # two numbers a slice: MAX_SLICES and one a partition at most
    firsts = sizes.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(cut, "doc_id long, tie long").toArrow()
    borders = sorted(_keys(firsts.column(0), firsts.column(1)))

    def deal(batches):
        for batch in batches:
            first, copies = {}, []
            for row, key in enumerate(_keys(batch.column(0), batch.column(1))):
                at = first.setdefault(key, (len(copies), row))[0]
                if at == len(copies):
                    copies.append(0)
                copies[at] += 1
            kept = batch.take(pa.array([row for _, row in first.values()], pa.int64()))
            slices = [bisect_right(borders, key) for key in first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(slices, pa.int32()), *kept.columns, pa.array(copies, pa.int64())], names=["slice", "doc_id", "tie", "text", "copies"])

    return docs.mapInArrow(deal, "slice int, doc_id long, tie long, text string, copies long"), total


def _documents(table: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """Row of each distinct document for every row, and the distinct documents in order."""
    keys = _keys(table.column("doc_id"), table.column("tie"))
    order = sorted(range(len(keys)), key=keys.__getitem__)
    own, kept = np.zeros(len(keys), dtype=np.int64), []
    for row in order:
        if not kept or keys[kept[-1]] != keys[row]:
            kept.append(row)
        own[row] = len(kept) - 1
    return own, table.take(pa.array(kept, pa.int64()))


def _hashed(docs: pa.Table, roller: Roller) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word counts of the documents, and of all windows their first words and two hashes."""
    text = docs.column("text").combine_chunks()
    text = text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks)
    words, counts = CasedWordHasher().words(text)
    return counts, *roller.windows(words, counts)


def kept_text(text: str, removed: np.ndarray | None) -> str:
    """The words that are not removed, joined by one space; worked through in pieces of PIECE bytes."""
    data, parts, at, word = text.encode(), [], 0, 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        words = data[at:end].split()
        kept = words if removed is None else compress(words, ~removed[word : word + len(words)])
        if part := b" ".join(kept):
            parts.append(part)
        word += len(words)
        at = end
    return b" ".join(parts).decode()


def _intervals(removed: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of removed words inside one document: starts, ends, and the number in each document."""
    edge = np.zeros(len(removed) + 1, dtype=bool)
    edge[bounds] = True
    opens = removed.copy()
    opens[1:] &= ~removed[:-1] | edge[1:-1]
    closes = removed.copy()
    closes[:-1] &= ~removed[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    home = np.searchsorted(bounds, starts, side="right") - 1
    return starts - bounds[home], ends - bounds[home], np.bincount(home, minlength=len(bounds) - 1)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id: str = "doc_id", text: str = "text", slice_bytes: int | None = None) -> DataFrame:
    """Every document without the words of passages that occur earlier in the corpus.

    Returns a row per input row: (doc_id, n_words, n_removed, removed, kept). `removed` has the maximal
    intervals of removed words, from `start` up to but without `end`; `kept` is the remaining words
    joined by one space. A null text has no words, and a text with fewer than `window` words keeps
    all. Documents without an id come after all others. Rows with equal id and text are one
    document and get the same result; rows of one id with different texts are ordered by a hash of
    the text. Other columns are not read. An empty table gives an empty result.

    Two windows count as equal when 96 bits of their hashes agree; of 10^13 windows that errs with a
    probability of 0.001. The driver holds the first key of every slice, at most a million.
    Runs jobs when called.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(body).alias("tie"), body.alias("text"))
    sliced, total = _sliced(named, slice_bytes)
    words = total // 6
    bits = max(0, int(words // min(max(words // PARTS, LEAST_BUCKET), MOST_BUCKET)).bit_length())

    def hashes(table: pa.Table) -> pa.Table:
        _, _, high, low = _hashed(_documents(table)[1], Roller(window))
        order, same = _in_order(high, low)
        first = order[~same]
        high, low = high[first], low[first]
        bucket = high >> np.uint64(64 - bits) if bits else np.zeros(len(high), dtype=np.uint64)
        starts = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1)))
        ends = np.append(starts, len(bucket))[1:]
        return pa.table({
            "bucket": pa.array(bucket[starts].astype(np.int64)),
            "slice": pa.array(np.full(len(starts), table.column("slice")[0].as_py(), dtype=np.int32)),
            "high": pa.array([_planes(high[a:b]) for a, b in zip(starts, ends, strict=True)], pa.binary()),
            "low": pa.array([_planes(low[a:b]) for a, b in zip(starts, ends, strict=True)], pa.binary()),
        })

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("slice")
        high = [_numbers(np.frombuffer(x.as_buffer(), np.uint8), np.uint64) for x in table.column("high")]
        low = [_numbers(np.frombuffer(x.as_buffer(), np.uint8), np.uint32) for x in table.column("low")]
        ends = np.cumsum([len(h) for h in high])
        order, same = _in_order(np.concatenate(high), np.concatenate(low))
        earlier = np.zeros(len(order), dtype=bool)
        earlier[order[same]] = True
        bits_of = [np.packbits(part).tobytes() for part in np.split(earlier, ends[:-1])]
        return pa.table({"slice": table.column("slice"), "bucket": table.column("bucket"), "n": pa.array([len(h) for h in high], pa.int64()),
                         "earlier": pa.array(bits_of, pa.binary())})

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        own, docs = _documents(table)
        counts, starts, high, low = _hashed(docs, Roller(window))
        order, same = _in_order(high, low)
        answers = answers.sort_by("bucket")
        found = [np.unpackbits(np.frombuffer(b.as_buffer(), np.uint8), count=n.as_py()).astype(bool)
                 for b, n in zip(answers.column("earlier"), answers.column("n"), strict=True)]
        # an entry that repeats the one before it is repeated anyway
        repeated = same.copy()
        repeated[~same] = np.concatenate([np.zeros(0, dtype=bool), *found])
        first_words = starts[order[repeated]]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        cover = np.zeros(bounds[-1] + 1, dtype=np.int64)
        np.add.at(cover, first_words, 1)
        np.add.at(cover, first_words + window, -1)
        removed = np.cumsum(cover)[:-1] > 0
        gone = np.diff(np.concatenate([[0], np.cumsum(removed)])[bounds])
        begins, ends, each = _intervals(removed, bounds)
        offsets = np.zeros(len(each) + 1, dtype=np.int32)
        np.cumsum(each, out=offsets[1:])
        kept = [kept_text(t.as_py(), removed[bounds[i] : bounds[i + 1]] if gone[i] else None) for i, t in enumerate(docs.column("text"))]
        spans = pa.StructArray.from_arrays([pa.array(begins.astype(np.int64)), pa.array(ends.astype(np.int64))], names=["start", "end"])
        result = pa.table({
            "doc_id": docs.column("doc_id"), "n_words": pa.array(counts.astype(np.int64)), "n_removed": pa.array(gone.astype(np.int64)),
            "removed": pa.ListArray.from_arrays(pa.array(offsets), spans), "kept": pa.array(kept, pa.string())})
        return result.take(pa.array(np.repeat(own, table.column("copies").to_numpy())))

    answers = (
        sliced.groupBy("slice").applyInArrow(hashes, "bucket long, slice int, high binary, low binary")
        .groupBy("bucket").applyInArrow(count, "slice int, bucket long, n long, earlier binary")
    )
    return sliced.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(finish, RESULT)
