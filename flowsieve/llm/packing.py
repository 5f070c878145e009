"""Packing documents into sequences of a fixed length: bounded-space online best fit.

Each task places its pieces as they come. A fixed number of bins is open; a bitset has a bit for
every amount of free space that some open bin has, so the best fit is the lowest bit from the
piece's length on. When a new bin would exceed the number of open bins, the fullest closes.

The bins that are still open when tasks end are pieces of a second packing of the same kind,
largest first, which joins the rests of different tasks.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.text import slices
from flowsieve.llm.tokens import WordTokenizer
from flowsieve.sources.scratch import materialise

OPEN_BINS = 1024
# Rests that one task of the second packing joins.
RESTS = 100_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, ids binary"


class OpenBins:
    """Open bins by free space."""

    def __init__(self, capacity: int, limit: int, first: int) -> None:
        self._capacity, self._limit, self._next = capacity, limit, first
        self._bits, self._open = 0, 0
        self._by_space: dict[int, list[int]] = defaultdict(list)

    def _take(self, space: int) -> int:
        bins = self._by_space[space]
        taken = bins.pop()
        if not bins:
            self._bits ^= 1 << space
        self._open -= 1
        return taken

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of at most the capacity."""
        fits = self._bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            chosen = self._take(space)
        else:
            space, chosen = self._capacity, self._next
            self._next += 1
            if length < space and self._open == self._limit:
                self._take((self._bits & -self._bits).bit_length() - 1)
        rest = space - length
        if rest:
            self._by_space[rest].append(chosen)
            self._bits |= 1 << rest
            self._open += 1
        return chosen, self._capacity - space

    def rests(self) -> list[tuple[int, int]]:
        """(bin, used) of all open bins."""
        return [(b, self._capacity - space) for space, bins in self._by_space.items() for b in bins]


def _first_bin() -> int:
    return TaskContext.get().partitionId() << 40


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, open_bins: int = OPEN_BINS,
    with_ids: bool = False, id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Where every piece of every document goes.

    A document is its token ids from the file `tokenizer`, then `end_id`; a null text is empty and
    still has its end. A document longer than `capacity` is cut into pieces of `capacity` ids, the
    last of which may be shorter; no id is lost. Returns (doc_id, piece, start, length, ids_crc32,
    sequence_id, offset), and the ids as little-endian unsigned 32-bit binary with `with_ids`.
    Offsets of a sequence are gapless from 0. Repeated rows are packed each; null ids stay null;
    other columns of `docs` play no part; an empty table gives an empty result.

    Runs a job that writes the pieces to the shared scratch folder: what a task placed is final
    once it is written, whatever executors are lost later.
    """

    def run(batches):
        words, bins = WordTokenizer(tokenizer), OpenBins(capacity, open_bins, _first_bin())
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for part in slices(batch, 1):
                rows: list[tuple] = []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), words.encode(texts), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[start : start + 4 * capacity]
                        rows.append((doc, piece, start // 4, len(cut) // 4, zlib.crc32(cut), *bins.place(len(cut) // 4), cut if with_ids else None))
                yield _rows(rows)
        # a negative piece marks a bin that is still open: its length is what is used
        yield _rows([(None, -1, None, used, None, b, None, None) for b, used in bins.rests()])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "ids"])

    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    placed = materialise(source.mapInArrow(run, _PIECES), "pieces")
    rests = placed.where("piece < 0").select("bin", F.col("length").alias("used"))
    joined = materialise(_join_rests(rests, capacity, open_bins), "rests")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32",
               F.coalesce("sequence_id", "bin").alias("sequence_id"),
               (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")]
    return placed.where("piece >= 0").join(joined, "bin", "left").select(*columns, *["ids"] * with_ids)


def _join_rests(rests: DataFrame, capacity: int, open_bins: int) -> DataFrame:
    """Pack the rests of all tasks, fullest first: (bin, sequence_id, base)."""

    def run(batches):
        # ids below zero are those of the second packing
        bins, first = OpenBins(capacity, open_bins, _first_bin()), -1
        for batch in batches:
            found = [bins.place(used) for used in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([first - b for b, _ in found], pa.int64()),
                 pa.array([offset for _, offset in found], pa.int64())], names=["bin", "sequence_id", "base"])

    tasks = max(1, -(-rests.count() // RESTS))
    ordered = rests.repartition(tasks, "bin").sortWithinPartitions(F.desc("used"), "bin")
    return ordered.mapInArrow(run, "bin long, sequence_id long, base long")
