"""Packed token-id matrices: best-fit-decreasing packing with a segment tree over free space.

A task collects the ids of its documents up to CHUNK ids, sorts the pieces by length and places
each, longest first, in the bin with the least free space that holds it. The segment tree has a
leaf for every amount of free space and in every node whether a bin lies below, so the search is
one walk down the tree. Rows that are not nearly full go back and are packed with the next chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm.text import slices
from flowsieve.llm.tokens import ByteTokenizer

# Ids that a task holds before it packs them.
CHUNK = 8 << 20
# A row with at most this share of free space is not opened again by the next chunk.
FULL = 0.02
PAD = 0
_ROWS = (
    "row_id long, ids binary, n_ids int, doc_ids array<long>, pieces array<int>, starts array<long>,"
    " cu_seqlens array<int>, position_resets array<int>"
)


class SpaceTree:
    """Bins by free space; finds the least space that is large enough."""

    def __init__(self, capacity: int) -> None:
        self._leaves = 1 << (capacity + 1).bit_length()
        self._count = [0] * (2 * self._leaves)
        self._bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, space: int, change: int) -> None:
        node = self._leaves + space
        while node:
            self._count[node] += change
            node >>= 1

    def put(self, space: int, chosen: int) -> None:
        self._bins[space].append(chosen)
        self._add(space, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (space, bin) of the best fit."""
        node = self._leaves + length
        count = self._count
        while not count[node]:
            # the next subtree to the right
            while node & 1:
                node >>= 1
                if not node:
                    return None
            node += 1
            if node & (node - 1) == 0:  # past the last leaf of this level
                return None
        while node < self._leaves:
            node = 2 * node if count[2 * node] else 2 * node + 1
        space = node - self._leaves
        self._add(space, -1)
        return space, self._bins[space].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of positions in `lengths`."""
    tree, bins = SpaceTree(capacity), []
    for at in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[at])
        space, chosen = found or (capacity, len(bins))
        if found is None:
            bins.append([])
        bins[chosen].append(at)
        if space > lengths[at]:
            tree.put(space - lengths[at], chosen)
    return bins


def packed_rows(
    docs: DataFrame, ranks: str, pattern: str, row_ids: int = 2048, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row of a token matrix per result row.

    ids: `row_ids` little-endian ids, 16-bit if the vocabulary allows it and 32-bit otherwise,
    filled up with PAD; n_ids of them are real. The row's segments are pieces of documents:
    doc_ids, pieces (number of the piece in its document), starts (ids of the document before it),
    cu_seqlens (0, then the end of every segment) and position_resets (where positions start at 0
    again). Documents longer than a row are cut; no id is lost. Null and empty texts have no ids
    and no segment. Null ids stay null, repeated rows are packed each, other columns play no part,
    and an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteTokenizer(ranks, pattern)
        kind = np.dtype("<u2" if encoder.size <= 1 << 16 else "<u4")
        row = TaskContext.get().partitionId() << 40
        pool: list[tuple] = []
        held = 0

        def pack(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal pool, held, row
            out, back = [], []
            for members in best_fit_decreasing([len(p[3]) for p in pool], row_ids):
                used = sum(len(pool[i][3]) for i in members)
                if not last and used < (1 - FULL) * row_ids:
                    back += [pool[i] for i in members]
                    continue
                line = np.full(row_ids, PAD, dtype=kind)
                ends = np.cumsum([len(pool[i][3]) for i in members]).tolist()
                line[:used] = np.concatenate([pool[i][3] for i in members])
                out.append((row, line.tobytes(), used, [pool[i][0] for i in members], [pool[i][1] for i in members],
                            [pool[i][2] for i in members], [0, *ends], [0, *ends[:-1]]))
                row += 1
                if len(out) == 512:
                    yield _batch(out)
                    out = []
            pool, held = back, sum(len(p[3]) for p in back)
            yield _batch(out)

        for batch in batches:
            for part in slices(batch, 1):
                for doc, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encoder.encode(body or "").astype(kind)
                    pool += [(doc, n, s, ids[s : s + row_ids]) for n, s in enumerate(range(0, len(ids), row_ids))]
                    held += len(ids)
                    if held >= CHUNK:
                        yield from pack(False)
                        # what went back must leave room for new documents
                        if held >= CHUNK // 2:
                            yield from pack(True)
        yield from pack(True)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()),
                 pa.list_(pa.int32()), pa.list_(pa.int32()))
        names = [field.split()[0] for field in _ROWS.split(", ")]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _ROWS)


def write_matrices(docs: DataFrame, path: str, ranks: str, pattern: str, row_ids: int = 2048, **columns: str) -> None:
    """Write the rows as Parquet; a file holds the rows of one task, in order."""
    packed_rows(docs, ranks, pattern, row_ids, **columns).write.parquet(path)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_ROWS).parquet(path)
