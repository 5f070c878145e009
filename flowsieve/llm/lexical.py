"""The highest-scoring documents of every query, exactly, by blocked posting lists.

Documents are indexed in shards of bounded size, each inside one task, so a term that every document
holds is never one long list. Inside a shard the posting list of each term is clustered by the
similarity of its documents: some of them are pivots, the others join the nearest one, and each
cluster is a block. A block stores the coordinatewise maximum of its documents' term impacts.

Terms are worked through from the heaviest to the lightest. The list of a term only has to yield
documents that hold none of the query's heavier terms, as those were in an earlier list; so a query's
bound of a block sums the block's maxima over this term and the lighter ones. A block is passed over
only if that bound is below the query's k-th best score, which goes on from shard to shard. All
numbers are integers below 2 ** 53 or, for queries beyond that, 64-bit integers, so bounds are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.sources.scratch import materialise, new_scratch_path

K = 20
# Query terms of one pass over the documents; one query may have more.
MAX_TERMS = 8192
# A shard has as many documents as fit this number of (document, term) cells.
CELLS, MOST_DOCUMENTS = 1 << 23, 2048
# Documents for which a posting list gets one more pivot.
BLOCK = 32
# Numbers that stand for a document when similarities are compared.
SKETCH = 32
# Bytes of text that are split at once.
PIECE = 1 << 20
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def _term_table() -> bytes:
    table = bytearray(range(256))
    for byte in _SEPARATORS:
        table[byte] = 0x20
    for byte in range(0x41, 0x5B):
        table[byte] = byte + 0x20
    return bytes(table)


TERM_BYTES = _term_table()


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists from pieces of PIECE bytes."""
    data = (text or "").encode().translate(TERM_BYTES)
    at = 0
    while at < len(data):
        end = len(data) if at + PIECE >= len(data) else data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class QueryBlock:
    """Queries that are searched in one pass: their ids, and (term, repeats) of each."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.vocabulary: dict[bytes, int] = {}
        self.counts: list[dict[int, int]] = []

    def add(self, query_id: int | None, text: str | None) -> None:
        counts: dict[int, int] = {}
        for part in terms(text):
            for term in part:
                at = self.vocabulary.setdefault(term, len(self.vocabulary))
                counts[at] = counts.get(at, 0) + 1
        self.ids.append(query_id)
        self.counts.append(counts)


def _blocks(queries: DataFrame) -> Iterator[QueryBlock]:
    block = QueryBlock()
    for query_id, text in queries.toLocalIterator():
        block.add(query_id, text)
        if len(block.vocabulary) >= MAX_TERMS or len(block.ids) >= MAX_TERMS:
            yield block
            block = QueryBlock()
    if block.ids:
        yield block


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of (doc_id, text): all terms counted, those of queries listed."""
    size = len(vocabulary)

    def run(batches):
        for batch in batches:
            counts, keys = [], [np.zeros(0, dtype=np.int64)]
            for row, text in enumerate(batch.column(1)):
                n = 0
                for part in terms(text.as_py()):
                    n += len(part)
                    known = np.array([x for x in map(vocabulary.get, part) if x is not None], dtype=np.int64)
                    keys.append(known + row * size)
                counts.append(n)
            found, tfs = np.unique(np.concatenate(keys), return_counts=True)
            cuts = np.searchsorted(found, np.arange(batch.num_rows + 1) * size)
            listed, tfs = (found % max(size, 1)).astype(np.int32), tfs.astype(np.int32)
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array([listed[a:b].tobytes() for a, b in spans], pa.binary()),
                 pa.array([tfs[a:b].tobytes() for a, b in spans], pa.binary())], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def _joined(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype=np.int32)


def _document_counts(vectors: DataFrame, size: int) -> np.ndarray:
    def run(batches):
        counts = np.zeros(size, dtype=np.int64)
        for batch in batches:
            counts += np.bincount(_joined(batch.column(0)), minlength=size)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["term", "docs"])

    out = np.zeros(size, dtype=np.int64)
    found = vectors.select("terms").mapInArrow(run, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))
    # one row per query term
    for term, docs in found.collect():
        out[term] = docs
    return out


class Ranking:
    """The best documents of every query so far; shards are added one after the other."""

    def __init__(self, block: QueryBlock, weights: np.ndarray, k: int):
        self.k = k
        # terms from the heaviest to the lightest; those that weigh nothing add nothing
        order = sorted((t for t in range(len(weights)) if weights[t] > 0), key=lambda t: (-weights[t], t))
        self.place = np.full(len(weights), -1, dtype=np.int64)
        self.place[order] = np.arange(len(order))
        most = max((sum(int(weights[t]) * c for t, c in counts.items()) for counts in block.counts), default=0) * 1_000_000
        self.kind = np.float64 if most < 1 << 53 else np.int64
        self.columns, self.factors, holders = [], [], [[] for _ in order]
        for q, counts in enumerate(block.counts):
            held = sorted((int(self.place[t]), int(weights[t]) * c) for t, c in counts.items() if self.place[t] >= 0)
            self.columns.append(np.array([p for p, _ in held], dtype=np.int64))
            self.factors.append(np.array([f for _, f in held], dtype=self.kind))
            for p, _ in held:
                holders[p].append(q)
        self.holders = holders
        self.directions = np.random.default_rng(0).standard_normal((len(order), SKETCH), dtype=np.float32)
        self.scores = [np.zeros(0, dtype=np.int64) for _ in block.ids]
        self.documents = [np.zeros((0, 2), dtype=np.int64) for _ in block.ids]
        self.least = np.ones(len(block.ids), dtype=np.int64)
        self.compared = self.passed_over = 0

    def add(self, ids: np.ndarray, rows: np.ndarray, listed: np.ndarray, impacts: np.ndarray) -> None:
        """A shard: ids (missing, id) of its documents, and (row, term, impact) of its postings."""
        place = self.place[listed]
        rows, impacts, place = rows[place >= 0], impacts[place >= 0], place[place >= 0]
        # an impact is below 2 ** 20, so four bytes hold it exactly
        cells = np.zeros((len(ids), len(self.holders)), dtype=np.float32)
        cells[rows, place] = impacts
        sketch = cells @ self.directions
        sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
        seen = np.zeros((len(self.scores), len(ids)), dtype=bool)
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(len(self.holders) + 1))
        for p, queries in enumerate(self.holders):
            postings = rows[order[cuts[p] : cuts[p + 1]]]
            if len(postings):
                self._visit(p, queries, postings, cells, sketch, seen, ids)

    def _visit(self, p: int, queries: list[int], postings: np.ndarray, cells: np.ndarray, sketch: np.ndarray, seen: np.ndarray, ids: np.ndarray) -> None:
        lighter = [self.columns[q][np.searchsorted(self.columns[q], p) :] for q in queries]
        columns = np.unique(np.concatenate(lighter))
        factors = np.zeros((len(columns), len(queries)), dtype=self.kind)
        for i, (q, own) in enumerate(zip(queries, lighter, strict=True)):
            factors[np.searchsorted(columns, own), i] = self.factors[q][-len(own) :]
        held = cells[np.ix_(postings, columns)]
        # the list as one block, then its clusters
        whole = held.max(axis=0).astype(self.kind) @ factors
        if not (whole >= self.least[queries]).any():
            self.passed_over += len(postings) * len(queries)
            return
        pivots = postings[:: BLOCK]
        label = np.argmax(sketch[postings] @ sketch[pivots].T, axis=1)
        by_label = np.argsort(label, kind="stable")
        starts = np.flatnonzero(np.diff(label[by_label], prepend=-1))
        summaries = np.maximum.reduceat(held[by_label], starts, axis=0).astype(self.kind)
        block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(postings))))
        wanted = summaries @ factors >= self.least[queries]
        for i, q in enumerate(queries):
            if wanted[:, i].any():
                reached = postings[by_label[wanted[block, i]]]
                fresh = reached[~seen[q, reached]]
                self.passed_over += len(postings) - len(reached)
                if len(fresh):
                    seen[q, fresh] = True
                    self._offer(q, fresh, cells, ids)
            else:
                self.passed_over += len(postings)

    def _offer(self, q: int, rows: np.ndarray, cells: np.ndarray, ids: np.ndarray) -> None:
        self.compared += len(rows)
        scores = (cells[np.ix_(rows, self.columns[q])].astype(self.kind) @ self.factors[q]).astype(np.int64)
        good = scores >= self.least[q]
        if not good.any():
            return
        scores = np.concatenate([self.scores[q], scores[good]])
        found = np.concatenate([self.documents[q], ids[rows[good]]])
        best = np.lexsort((found[:, 1], found[:, 0], -scores))[: self.k]
        self.scores[q], self.documents[q] = scores[best], found[best]
        if len(best) == self.k:
            self.least[q] = self.scores[q][-1]


def impacts(tfs: np.ndarray, lengths: np.ndarray, documents: int, occurrences: int) -> np.ndarray:
    m = 100 - 25 + (25 * lengths * documents) // occurrences
    return (1_000_000_000 * tfs) // (1000 * tfs + 12 * m)


def _search(vectors: DataFrame, block: QueryBlock, weights: np.ndarray, documents: int, occurrences: int, k: int) -> DataFrame:
    """The k best of every query among the documents of each task: (query, doc_id, score)."""
    most = max(1, min(MOST_DOCUMENTS, CELLS // max(1, len(weights))))

    def run(batches):
        ranking = Ranking(block, weights, k)
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                sizes = np.array([len(x.as_buffer()) // 4 for x in part.column(2)], dtype=np.int64)
                rows = np.repeat(np.arange(part.num_rows), sizes)
                lengths = part.column(1).to_numpy()
                tfs = _joined(part.column(3)).astype(np.int64)
                ids = np.array([(i is None, i or 0) for i in part.column(0).to_pylist()], dtype=np.int64)
                ranking.add(ids, rows, _joined(part.column(2)), impacts(tfs, lengths[rows], documents, occurrences))
        for q, (scores, found) in enumerate(zip(ranking.scores, ranking.documents, strict=True)):
            if len(scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(scores), q, dtype=np.int32)), pa.array(found[:, 1], mask=found[:, 0] > 0), pa.array(scores)],
                    names=["query", "doc_id", "score"])

    return vectors.where("n > 0").select("doc_id", "n", "terms", "tfs").mapInArrow(run, "query int, doc_id long, score long")


def _ranked(docs: DataFrame, block: QueryBlock, k: int) -> DataFrame:
    size = len(block.vocabulary)
    vectors = materialise(_vectors(docs, block.vocabulary), "term_vectors")
    documents, occurrences = vectors.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = _document_counts(vectors, size)
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) if d else 0 for d in held], dtype=np.int64)
    local = _search(vectors, block, weights, documents, max(occurrences, 1), k)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    names = docs.sparkSession.createDataFrame(list(enumerate(block.ids)), "query int, item_id long")
    best = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def rank_documents(
    docs: DataFrame, queries: DataFrame, k: int = K, id: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text"
) -> DataFrame:
    """The k highest-scoring documents of every query: (item_id, rank, doc_id, score).

    Scores above 0 only; equal scores go by ascending doc_id, a missing one last. Null and empty texts
    have no terms: such a document is in no result and in no count, such a query has no rows. Every
    row of `docs` is a document and every row of `queries` a query, also when ids or texts repeat.
    Other columns are not read. Documents are read once per QueryBlock, that is per MAX_TERMS terms
    or so of the queries; the driver holds one block at a time. Runs jobs when called.
    """
    named = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = queries.select(F.col(query_id).cast("long"), F.col(query_text))
    spark = docs.sparkSession
    path, parts = new_scratch_path(spark, "ranked"), 0
    for block in _blocks(asked):
        if block.vocabulary:
            _ranked(named, block, k).write.parquet(f"{path}/{parts}")
            parts += 1
    kind = "item_id long, rank int, doc_id long, score long"
    if not parts:
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(*[f"{path}/{n}" for n in range(parts)])
