"""Exact nearest codes by multi-index hashing with growing radii.

A vector's code has a bit per dimension, set where the value is positive. Equal codes are one entry with
their k + 1 smallest ids, which is all that a result can need of them, so a code that a third of all
rows share is one entry.

Entries are indexed in the tasks, at most BUCKET of them in one index, so nothing is shuffled by value
and no value is hot. An index cuts codes into segments of about log2(entries) bits, and has for each
segment the entries sorted by its value. A query looks up the values at distance 0 from each of its
segments, then those at distance 1, one segment after the other. When the first j + 1 of s
segments have been searched up to radius r and the others up to r - 1, every code within s * r + j
has been seen, because a code that has not differs in r + 1 bits in each of the first and in r in each
other segment. A query ends when its k-th verified distance is at most that, and never by a scan. The
distances found in one index bound the radii in the task's next one. The order is by distance, then
by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.sources.scratch import materialise

BITS = 64
# Queries that the tasks hold at once, with k results each; more of them are answered in further passes.
QUERIES_PER_PASS = 1 << 18
# Entries of one index.
BUCKET = 1 << 17
_QUERY = ("query_id", "query_code")


def codes(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, code) of up to 64 dimensions; shorter vectors have zeros, longer ones are an error.

    Rows without an id or a vector are left out; a null or NaN dimension is not positive.
    """
    bit = F.aggregate(
        F.transform(F.col("v"), lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).dropna()
    fits = F.when(F.size("v") > BITS, F.raise_error(F.lit(f"vectors have at most {BITS} dimensions")).cast("long")).otherwise(bit)
    return rows.select("vec_id", fits.alias("code"))


def _smallest_ids(rows: DataFrame, keep: int) -> DataFrame:
    """(code, ids): the `keep` smallest ids of every code, first of parts of a code, then of their results."""

    def least(df: DataFrame, *by: str) -> DataFrame:
        ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id")))
        return ranked.where(F.col("rank") <= keep).drop("rank")

    parts = rows.distinct().withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = least(least(parts, "code", "part").drop("part"), "code")
    return few.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _first_k(found: DataFrame, k: int, *order: str) -> DataFrame:
    """The first k rows of each query, with their rank from 1."""
    ranks = F.row_number().over(Window.partitionBy(*_QUERY).orderBy(*order)).cast("long")
    return found.withColumn("rank", ranks).where(F.col("rank") <= k)


def _near_codes(found: DataFrame, k: int) -> DataFrame:
    """The k nearest codes of each query; `first` is the code's smallest id that is not the query's own.

    Each code has such an id, so no vector of another code is among the k nearest.
    """
    return _first_k(found.distinct(), k, "distance", "first").drop("rank")


def _vectors(near: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """The k nearest vectors of each query among those of its nearest codes."""
    found = near.join(entries, "code").select(*_QUERY, "distance", F.explode("ids").alias("vec_id"))
    return _first_k(found.where("vec_id <> query_id"), k, "distance", "vec_id")


class Index:
    """Distinct codes by the values of their segments."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.segments = max(2, ceil(BITS / max(4, log2(max(len(codes), 2)))))
        width = -(-BITS // self.segments)
        self.cuts = [(lo, min(lo + width, BITS) - lo) for lo in range(0, BITS, width)]
        self.tables = []
        for lo, bits in self.cuts:
            values = self._values(codes, lo, bits)
            starts = np.zeros((1 << bits) + 1, dtype=np.int64)
            np.cumsum(np.bincount(values, minlength=1 << bits), out=starts[1:])
            self.tables.append((np.argsort(values, kind="stable"), starts))
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def _values(codes: np.ndarray, lo: int, bits: int) -> np.ndarray:
        return ((codes >> np.uint64(lo)) & np.uint64((1 << bits) - 1)).astype(np.int64)

    def _at_radius(self, bits: int, radius: int) -> np.ndarray:
        if (bits, radius) not in self.masks:
            self.masks[bits, radius] = np.array([sum(1 << place for place in places) for places in combinations(range(bits), radius)], dtype=np.int64)
        return self.masks[bits, radius]

    def look_up(self, code: np.uint64, number: int, radius: int) -> np.ndarray:
        """Places of the codes whose segment `number` is at `radius` from the query's."""
        lo, bits = self.cuts[number]
        order, starts = self.tables[number]
        values = int(self._values(code, lo, bits)) ^ self._at_radius(bits, radius)
        begins, sizes = starts[values], starts[values + 1] - starts[values]
        held = sizes > 0
        begins, sizes = begins[held], sizes[held]
        ends = np.cumsum(sizes)
        return order[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1])] if len(ends) else order[:0]

    def nearest(self, code: np.uint64, k: int, far: int, drop: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of all codes that can be among the k nearest, ties included.

        Codes beyond the distance `far` are not asked for, nor is the one at the place `drop`.
        """
        seen = np.zeros(len(self.codes), dtype=bool)
        if drop >= 0:
            seen[drop] = True
        counts = np.zeros(BITS + 1, dtype=np.int64)
        places, distances, left = [], [], len(self.codes) - (drop >= 0)
        for radius in range(max(bits for _, bits in self.cuts) + 1):
            for number, (_, bits) in enumerate(self.cuts):
                if radius <= bits:
                    found = self.look_up(code, number, radius)
                    found = found[~seen[found]]
                    seen[found] = True
                    left -= len(found)
                    away = np.bitwise_count(self.codes[found] ^ code).astype(np.int64)
                    close = away <= far
                    places.append(found[close])
                    distances.append(away[close])
                    counts += np.bincount(away, minlength=BITS + 1)
                    reached = np.flatnonzero(np.cumsum(counts) >= k)
                    if len(reached):
                        far = min(far, int(reached[0]))
                if far <= len(self.cuts) * radius + number or not left:
                    places, distances = np.concatenate(places), np.concatenate(distances)
                    near = distances <= far
                    return places[near], distances[near]
        raise AssertionError("all radii cover all codes")


def _search(light: DataFrame, listed: np.ndarray, k: int) -> DataFrame:
    """The k nearest codes of each query among those of each task: (query_id, query_code, distance, first, code)."""
    ids, wanted = listed[:, 0], listed[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((3, 0), dtype=np.int64)] * len(ids)

        def answer(entries: pa.Table) -> None:
            codes, first, second = (entries.column(n).fill_null(0).to_numpy() for n in range(3))
            single = entries.column(2).is_null().to_numpy()
            index = Index(codes.view(np.uint64))
            by_first = np.argsort(first, kind="stable")
            of_first = first[by_first]
            for q in range(len(ids)):
                far = int(held[q][0, -1]) if held[q].shape[1] == k else BITS
                # codes that only the query itself has are none of its neighbours; mostly there is one at most
                own = by_first[np.searchsorted(of_first, ids[q]) : np.searchsorted(of_first, ids[q], side="right")]
                alone = own[single[own]]
                at, d = index.nearest(wanted[q : q + 1].view(np.uint64)[0], k + max(0, len(alone) - 1), far, int(alone[0]) if len(alone) else -1)
                if len(alone) > 1:
                    other = ~np.isin(at, alone)
                    at, d = at[other], d[other]
                both = np.concatenate([held[q], np.stack([d, np.where(first[at] == ids[q], second[at], first[at]), codes[at]])], axis=1)
                held[q] = both[:, np.lexsort((both[1], both[0]))[:k]]

        waiting, size = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BUCKET - size)
                waiting.append(part)
                size += part.num_rows
                batch = batch.slice(part.num_rows)
                if size == BUCKET:
                    answer(pa.Table.from_batches(waiting))
                    waiting, size = [], 0
        if size:
            answer(pa.Table.from_batches(waiting))
        counts = [h.shape[1] for h in held]
        d, first, codes = np.concatenate([np.zeros((3, 0), dtype=np.int64), *held], axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, counts)), pa.array(np.repeat(wanted, counts)), pa.array(d), pa.array(first), pa.array(codes)],
            names=[*_QUERY, "distance", "first", "code"])

    return light.mapInArrow(run, "query_id long, query_code long, distance long, first long, code long")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k rows (vec_id, code) nearest to each query (query_id, query_code), the query's own id left out.

    Returns (query_id, rank, vec_id, distance), rank from 1. Fewer rows than k give fewer results.
    Ids that repeat with equal codes are one row, and with different codes are ranked each; a query
    id with several codes is answered for each. Queries go to the tasks 16 bytes each,
    QUERIES_PER_PASS at a time. Runs its jobs when called.
    """
    entries = materialise(_smallest_ids(rows, k + 1), "codes")
    light = entries.select("code", F.col("ids")[0].alias("first"), F.try_element_at("ids", F.lit(2)).alias("second"))
    asked = materialise(queries.select(*_QUERY).dropna().distinct(), "queries")
    passes = max(1, -(-asked.count() // QUERIES_PER_PASS))
    near = None
    for turn in range(passes):
        part = asked.where(F.pmod(F.xxhash64(*_QUERY), F.lit(passes)) == turn)
        listed = part.toPandas().to_numpy(np.int64)
        found = _near_codes(_search(light, listed, k), k)
        near = found if near is None else near.unionByName(found)
    return _vectors(materialise(near, "near_codes"), entries, k).select("query_id", "rank", "vec_id", "distance")
