"""Benchmark items inside documents, also with other numbers, names or units.

Texts become templates: runs of letters in lower case, with typed placeholders for numbers, for
units behind a number, and for names (capitalised words inside a sentence). Windows of WINDOW
template tokens are hashed; document windows that no benchmark window equals are dropped where
they are made, and the others are joined to the benchmark's by hash. What stands in the slots of
matching windows must then change consistently: one value for one value. So a question with other
numbers is found, and a text that merely has numbers in the same places is not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.text import mix, slices, windows
from flowsieve.sources.scratch import materialise

WINDOW = 8
# Tokens of an item, or the whole item if it is shorter, that a document must share.
LEAST_SHARED = 13
# Distinct benchmark window hashes that one pass over the documents looks for (8 bytes each).
HASHES_PER_PASS = 2_000_000
# Chunks between spaces that a task remembers, some 40 MB with their tokens; beyond it the memory starts anew.
REMEMBERED = 200_000

# Units that may stand behind a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml l gal s sec min h hr hrs hour hours minute minutes second seconds day days"
    " week weeks month months year years kb mb gb tb hz khz mhz ghz w kw v a j cal kcal euro euros dollar dollars cent cents"
    " usd eur percent degrees metres meters kilometres kilometers miles grams litres liters".split())
_TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,:]\d+)*|[.!?\n]")
_BREAK, _WORD, _CAPITAL, _NUMBER, _UNIT = range(5)


class Templates:
    """Template tokens of texts. Made once per task: it remembers what stands between two spaces.

    No token holds a space and none is cut by one, so a text's tokens are those of the chunks between
    its spaces, and a chunk is read once however often it occurs.
    """

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self._chunks: dict[str, bytes] = {}
        self._tokens: dict[str, int] = {}
        self.names: list[str] = []
        self._hashes = np.zeros(1024, dtype=np.uint64)
        self._kinds = np.zeros(1024, dtype=np.int8)

    def _learn(self, token: str) -> int:
        import xxhash

        at = self._tokens[token] = len(self.names)
        self.names.append(token)
        if at == len(self._hashes):
            self._hashes = np.concatenate([self._hashes, np.zeros_like(self._hashes)])
            self._kinds = np.concatenate([self._kinds, np.zeros_like(self._kinds)])
        if token in ".!?\n":
            kind = _BREAK
        elif token[0].isdigit():
            kind = _NUMBER
        elif token[0].isupper() and len(token) > 1:
            kind = _CAPITAL
        else:
            kind = _UNIT if token in UNITS else _WORD
        self._kinds[at] = kind
        self._hashes[at] = xxhash.xxh3_64_intdigest(token.lower())
        return at

    def _read_chunk(self, chunk: str) -> bytes:
        known, learn = self._tokens, self._learn
        return np.array([known[t] if t in known else learn(t) for t in _TOKEN.findall(chunk)], dtype="<i4").tobytes()

    def codes(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of each text's tokens, breaks included; `names` has the tokens until the next call."""
        if len(self._chunks) > REMEMBERED:
            self._forget()
        listed = [t.split(" ") for t in texts]
        for chunk in set().union(*listed).difference(self._chunks):
            self._chunks[chunk] = self._read_chunk(chunk)
        get = self._chunks.__getitem__
        return [np.frombuffer(b"".join(map(get, chunks)), dtype="<i4") for chunks in listed]

    def template(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the tokens without breaks, their template hashes and their slot kinds (0: none)."""
        kinds = self._kinds[codes]
        keep = np.flatnonzero(kinds != _BREAK)
        before = np.zeros(len(codes), dtype=np.int8)
        before[1:] = kinds[:-1]
        codes, kinds, before = codes[keep], kinds[keep], before[keep]
        slots = np.zeros(len(keep), dtype=np.int8)
        slots[kinds == _NUMBER] = 1
        slots[(kinds == _UNIT) & (before == _NUMBER)] = 2
        slots[(kinds == _CAPITAL) & (before != _BREAK)] = 3
        hashes = self._hashes[codes]
        placed = np.flatnonzero(slots)
        with np.errstate(over="ignore"):
            hashes[placed] = mix(slots[placed].astype(np.uint64))
        return codes, hashes, slots


def _window_rows(docs: DataFrame, wanted: np.ndarray | None, sizes: list[int], id: str) -> DataFrame:
    """(id, size, hash, at, tokens, slots) of the windows in `wanted`, or of all with enough plain words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            for part in slices(batch, 1):
                rows: list[tuple] = []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for key, read in zip(part.column(0).to_pylist(), templates.codes(texts), strict=True):
                    codes, hashes, slots = templates.template(read)
                    for size in sizes or [min(WINDOW, max(1, len(codes)))]:
                        found, _ = windows(hashes, np.array([len(hashes)]), size)
                        if wanted is None:
                            plain = np.convolve(slots == 0, np.ones(size, dtype=np.int64), "valid") if len(found) else found
                            at = np.flatnonzero(2 * plain >= size) if len(found) else []
                        else:
                            place = np.searchsorted(wanted, found)
                            at = np.flatnonzero(wanted[np.minimum(place, len(wanted) - 1)] == found)
                        for i in at:
                            named = [f"{slots[j]}:{templates.names[codes[j]]}" for j in range(i, i + size) if slots[j]]
                            rows.append((key, size, int(found[i].view(np.int64)), int(i), len(codes), named))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[id, "size", "hash", "at", "tokens", "slots"])

    return docs.mapInArrow(run, f"{id} long, size int, hash long, at long, tokens long, slots array<string>")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Pairs of documents and benchmark items that they contain.

    Returns (doc_id, item_id, shared_tokens, item_tokens, first_token, slots, changed_slots): how many
    of the item's tokens lie in windows that the document shares, each counted once, where the first
    window starts, how many distinct slot values meet and how many of them differ. A pair is reported
    when it shares LEAST_SHARED tokens or the whole of a shorter item, in copies whose slots change
    consistently; a changed plain word between shared windows does not end a copy.

    Windows of which more than half is placeholders are no evidence. Items without a window, null
    and empty texts match nothing; rows without an id are left out; documents and items that repeat
    an id count as one; other columns play no part; empty tables give an empty result.

    The benchmark may be of any size: its window hashes go to the tasks HASHES_PER_PASS at a time.
    """
    items = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id IS NOT NULL")
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    ours = materialise(_window_rows(items, None, [], "item_id"), "benchmark_windows")
    sizes = sorted(r["size"] for r in ours.select("size").distinct().collect())  # WINDOW values at most
    passes = max(1, -(-ours.count() // HASHES_PER_PASS))
    hits = None
    for turn in range(passes if sizes else 0):
        of_turn = ours.select("hash").distinct().where(F.pmod(F.xxhash64("hash"), F.lit(passes)) == turn)
        wanted = np.sort(of_turn.toPandas()["hash"].to_numpy(np.int64).view(np.uint64))
        found = _window_rows(docs, wanted, sizes, "doc_id") if len(wanted) else None
        hits = hits.unionByName(found) if hits is not None and found is not None else hits if found is None else found
    if hits is None:
        hits = ours.limit(0).withColumnRenamed("item_id", "doc_id")
    theirs = materialise(hits.drop("tokens"), "document_windows")

    pairs = theirs.withColumnsRenamed({"at": "doc_at", "slots": "doc_slots"}).join(
        ours.withColumnsRenamed({"at": "item_at", "slots": "item_slots"}), ["hash", "size"])
    pairs = pairs.where(F.size("doc_slots") == F.size("item_slots")).withColumn("line", F.col("doc_at") - F.col("item_at"))
    # a line is one copy of the item in the document; it has no more rows than the item has windows
    met = F.explode_outer(F.arrays_zip(F.col("item_slots").alias("own"), F.col("doc_slots").alias("other")))
    keys = ("doc_id", "item_id", "line")
    lines = pairs.select(*keys, "size", "tokens", "item_at", "doc_at", met.alias("met")).groupBy(*keys).agg(
        F.collect_set("item_at").alias("windows"), F.max("size").alias("size"), F.max("tokens").alias("tokens"),
        F.min("doc_at").alias("first_token"), F.collect_set("met").alias("met"))
    own, other = F.array_distinct("met.own"), F.array_distinct("met.other")
    consistent = (F.size(own) == F.size("met")) & (F.size(other) == F.size("met"))
    # the places in the item that any copy covers
    covered = F.array_distinct(F.flatten(F.transform("windows", lambda at: F.sequence(at, at + F.col("size") - 1))))
    changed = F.size(F.filter("met", lambda m: m["own"] != m["other"]))
    places = lines.where(consistent).select(
        "doc_id", "item_id", "tokens", "first_token", F.size("met").cast("long").alias("slots"), changed.cast("long").alias("changed"),
        F.explode(covered).alias("place"))
    # repeated copies of a phrase are one row a place before they are counted
    shared = places.groupBy("doc_id", "item_id", "place").agg(
        *[F.max(c).alias(c) for c in ("tokens", "slots", "changed")], F.min("first_token").alias("first_token")
    ).groupBy("doc_id", "item_id").agg(
        F.count("*").alias("shared_tokens"), F.max("tokens").alias("item_tokens"), F.min("first_token").alias("first_token"),
        F.max("slots").alias("slots"), F.max("changed").alias("changed_slots"))
    enough = F.least(F.lit(LEAST_SHARED).cast("long"), F.col("item_tokens"))
    return shared.where(F.col("shared_tokens") >= enough)
