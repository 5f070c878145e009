"""Near-duplicate groups by min-max hashing.

Every permutation of the shingle hashes gives two signature values, the smallest and the largest,
so PERMUTATIONS multiplications per shingle make 2 * PERMUTATIONS values. The values are cut into
BANDS bands of ROWS values; the two values of one permutation are in different bands. At a
similarity of 0.8 a pair shares no band with a probability of (1 - 0.8 ** 6) ** 48 < 5e-7.

1. Documents with the same shingle set form a class; only its smallest id goes on.
2. In every band bucket the members are compared with one head, the member that has the most
   bucket mates overall: for edited copies of one original that is the original. This takes one
   pair per member, not all pairs of the bucket.
3. Buckets whose members are still in different components are worked through in blocks: their
   members outside the bucket's largest component meet all members inside a task, and pairs of
   different components whose signatures agree nearly enough go on, packed by the blocks of
   documents that they are from. No pair inside a component is made.
4. All pairs are confirmed on full shingle sets; confirmed pairs are the links. The packed ones meet
   the sets of their two blocks in one task, so no row is made per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.components import connected_components
from flowsieve.llm.text import WordHasher, mix, shingle_sets, slices
from flowsieve.sources.scratch import materialise

ROWS = 6
BANDS = 48
PERMUTATIONS = ROWS * BANDS // 2
# Members of a bucket that meet in one task.
BLOCK = 2048
# Documents, and shingles, of a block whose full sets meet those of another block in one task.
BLOCK_DOCUMENTS, BLOCK_SHINGLES = 256, 500_000
# Share of equal signature values below which a pair is not near 0.8: 4.5 standard deviations of
# 2 * PERMUTATIONS draws. A pair at exactly 0.8 falls below it with a probability of about 3e-6.
SIGNATURE_SLACK = 0.106


def _multipliers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)


def signatures(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Smallest and largest value of each non-empty set under every permutation: (texts, 2 * PERMUTATIONS)."""
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), 2 * PERMUTATIONS), dtype=np.uint64)
    if not len(full):
        return out
    starts = (np.cumsum(sizes) - sizes)[full]
    with np.errstate(over="ignore"):
        for p, multiplier in enumerate(_multipliers()):
            values = sets * multiplier
            out[full, p] = np.minimum.reduceat(values, starts)
            out[full, PERMUTATIONS + p] = np.maximum.reduceat(values, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(signature), BANDS))
        values = signature.reshape(len(signature), BANDS, ROWS)
        for row in range(ROWS):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, :, row])
    return keys.view(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
    """(other columns, sets, sizes) of slices of batches whose last column is the text."""
    hasher = WordHasher()
    for batch in batches:
        text = batch.num_columns - 1
        for part in slices(batch, text):
            yield part.columns[:text], *shingle_sets(*hasher.words(part.column(text)), words)


def _sketch(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, low, high, bands) of every document; low and high identify its set."""

    def run(batches):
        for (ids,), sets, sizes in _sets(batches, words):
            full = sizes > 0
            starts = (np.cumsum(sizes) - sizes)[full]
            low, high = np.zeros(len(sizes), dtype=np.uint64), np.zeros(len(sizes), dtype=np.uint64)
            with np.errstate(over="ignore"):
                if len(starts):
                    low[full] = np.add.reduceat(mix(sets), starts)
                    high[full] = np.bitwise_xor.reduceat(mix(sets + np.uint64(0x632BE59BD9B4E019)), starts)
            keys = band_keys(signatures(sets, sizes))[full].reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)),
                 _lists(keys, full.astype(np.int64) * BANDS, pa.int64())],
                names=["doc_id", "n_shingles", "low", "high", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, low long, high long, bands array<long>")


def _full_sets(docs: DataFrame, words: int) -> DataFrame:
    """Of (node, home, text)."""

    def run(batches):
        for (nodes, homes), sets, sizes in _sets(batches, words):
            yield pa.RecordBatch.from_arrays(
                [nodes, homes, _lists(sets.view(np.int64), sizes, pa.int64())], names=["node", "home", "shingles"])

    return docs.select("node", "home", "text").mapInArrow(run, "node long, home long, shingles array<long>")


def _marks(sets: DataFrame) -> DataFrame:
    """Band keys and the low 16 bits of every signature value of (node, shingles)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                listed = part.column(1)
                sizes = np.diff(listed.offsets.to_numpy())
                found = signatures(listed.flatten().to_numpy().view(np.uint64), sizes)
                keys, short = band_keys(found), found.astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([k.tobytes() for k in keys], pa.binary()),
                     pa.array([s.tobytes() for s in short], pa.binary())], names=["node", "keys", "signature"])

    return sets.select("node", "shingles").mapInArrow(run, "node long, keys binary, signature binary")


def _confirmed(packed: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Links (a, b) among pairs packed by the blocks of both documents: (home_a, home_b, pairs binary)."""
    ways = packed.select(F.col("home_a").alias("from_a"), F.col("home_b").alias("from_b")).distinct()
    both = ways.select("*", F.explode(F.array_distinct(F.array("from_a", "from_b"))).alias("home"))
    needed = both.join(sets, "home").select("from_a", "from_b", "node", "shingles")

    def confirm(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        own: dict[int, list[np.ndarray]] = {}
        for chunk in sets.to_batches():
            listed = chunk.column("shingles")
            values, offsets = listed.values.to_numpy(), listed.offsets.to_numpy()
            for i, node in enumerate(chunk.column("node").to_pylist()):
                own.setdefault(node, []).append(values[offsets[i] : offsets[i + 1]])
        wanted = np.unique(np.frombuffer(b"".join(pairs["pairs"].to_pylist()), dtype=np.int64).reshape(-1, 2), axis=0)
        linked = [(a, b) for a, b in wanted.tolist() if any(similar(x, y) for x in own[a] for y in own[b])]
        return pa.table({"a": pa.array([a for a, _ in linked], pa.int64()), "b": pa.array([b for _, b in linked], pa.int64())})

    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            return False
        merged = np.sort(np.concatenate([x, y]))
        common = int((merged[1:] == merged[:-1]).sum())
        return 100 * common >= percent * (len(merged) - common)

    links = packed.groupBy("home_a", "home_b").cogroup(needed.groupBy("from_a", "from_b")).applyInArrow(confirm, "a long, b long")
    return materialise(links, name)


def _packs(pairs: np.ndarray) -> pa.Table:
    """Pairs (home, home, node, node) as one row per two blocks."""
    pairs = np.unique(np.where(pairs[0] <= pairs[1], pairs, pairs[[1, 0, 3, 2]]), axis=1)
    cuts = np.flatnonzero(np.any(pairs[:2, 1:] != pairs[:2, :-1], axis=0)) + 1 if pairs.size else []
    parts = [p for p in np.split(pairs, cuts, axis=1) if p.size]
    return pa.table({
        "home_a": pa.array([int(p[0, 0]) for p in parts], pa.int64()), "home_b": pa.array([int(p[1, 0]) for p in parts], pa.int64()),
        "pairs": pa.array([np.ascontiguousarray(p[2:].T).tobytes() for p in parts], pa.binary())})


def _headed(buckets: DataFrame) -> DataFrame:
    """The bucket rows with the head of the bucket and how many bucket mates the head has."""
    mates = buckets.groupBy("node").agg(F.sum("members").alias("mates"))
    ranked = buckets.join(mates, "node")
    heads = ranked.groupBy("key").agg(F.max(F.struct("mates", (-F.col("node")).alias("other"))).alias("top"))
    heads = heads.select("key", F.col("top.mates").alias("mates"), (-F.col("top.other")).alias("head"))
    return buckets.join(heads, "key")


def _star_pairs(headed: DataFrame, homes: DataFrame) -> DataFrame:
    """(head, member) of every bucket, packed."""
    pairs = headed.where("node <> head").select("head", "node").distinct()
    placed = pairs.join(homes.select("node", F.col("home").alias("home_b")), "node").join(
        homes.select(F.col("node").alias("head"), F.col("home").alias("home_a")), "head")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _packs(np.stack([c.to_numpy() for c in batch.columns])).to_batches()

    return placed.select("home_a", "home_b", "head", "node").mapInArrow(run, "home_a long, home_b long, pairs binary")


def _homes(headed: DataFrame, nodes: DataFrame) -> DataFrame:
    """The block of every node (node, n_shingles): nodes that have the same most popular head are near each other."""
    liked = headed.groupBy("node").agg(F.max(F.struct("mates", (-F.col("head")).alias("head"))).alias("top"))
    near = liked.select("node", F.col("top.head").alias("head")).join(nodes, "node")
    blocks = near.groupBy("head").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_DOCUMENTS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    return near.join(blocks, "head").select("node", F.xxhash64("head", block).alias("home"))


def _open_pairs(headed: DataFrame, components: DataFrame, homes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that share a bucket but no component, and whose signatures agree nearly enough, packed."""
    placed = headed.where("members > 2").join(components, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component"))
    by_component = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    split = by_component.groupBy("key").agg(
        F.count("*").alias("parts"), F.sum("n").alias("members"),
        F.max(F.struct("n", "component")).alias("largest")).where("parts > 1")
    split = split.select("key", "members", F.col("largest.component").alias("main"))
    rows = materialise(placed.join(split, "key"), "open_buckets")
    marks = materialise(_marks(sets.join(rows.select("node").distinct(), "node", "left_semi")), "signatures")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK)).cast("long")
    spread = rows.withColumn("blocks", blocks)
    members = spread.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("minor", F.lit(False))
    minors = spread.where("component <> main").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("minor", F.lit(True))
    fields = ("key", "block", "minor", "component", "node")
    met = members.select(*fields).unionByName(minors.select(*fields)).join(homes, "node").join(marks, "node")
    least = int(2 * PERMUTATIONS * (percent / 100 - SIGNATURE_SLACK))

    def meet(table: pa.Table) -> pa.Table:
        minor = table["minor"].to_numpy()
        node, home, component = (table[c].to_numpy() for c in ("node", "home", "component"))
        bucket = table["key"][0].as_py()
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), dtype=np.int64).reshape(-1, BANDS)
        marks = np.frombuffer(b"".join(table["signature"].to_pylist()), dtype=np.uint16).reshape(len(keys), -1)
        rest = np.flatnonzero(~minor)
        keys_rest, marks_rest = keys[rest], marks[rest]
        found = [np.zeros((4, 0), dtype=np.int64)]
        for i in np.flatnonzero(minor):
            near = (marks_rest == marks[i]).sum(axis=1) >= least
            near &= component[rest] != component[i]
            at = np.flatnonzero(near)
            # of all the buckets that both are in, the first reports the pair
            shared = (keys_rest[at] == keys[i]).argmax(axis=1)
            at = rest[at[keys_rest[at, shared] == bucket]]
            found.append(np.stack([np.full(len(at), home[i]), home[at], np.full(len(at), node[i]), node[at]]))
        return _packs(np.concatenate(found, axis=1))

    return materialise(met.groupBy("key", "block").applyInArrow(meet, "home_a long, home_b long, pairs binary"), "open_pairs")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Group documents whose sets of `words`-word shingles have a Jaccard similarity of `percent` / 100 or more.

    Returns (doc_id, n_shingles, component_id, kept) for every row of `docs`: component_id is the
    smallest id that links reach, kept is true for it. Other columns of `docs` play no part.

    Null and empty texts have no shingles, are linked with nothing and are kept. Rows that share an
    id are one document in the link graph: each is returned. A row without an id links nothing,
    has no component and is kept. An empty table gives an empty result.

    Runs its jobs when called; the result reads tables in the shared scratch folder.
    """
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = materialise(_sketch(docs, words), "sketch")
    named = docs.where(F.col("doc_id").isNotNull())
    known = sketch.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = materialise(known.groupBy("low", "high", "n_shingles").agg(F.min("doc_id").alias("node")), "classes")
    nodes = classes.select(F.col("node").alias("doc_id")).distinct()
    banded = known.join(nodes, "doc_id", "left_semi").select(
        F.col("doc_id").alias("node"), F.explode("bands").alias("key"))
    sizes = banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    buckets = materialise(banded.join(sizes, "key"), "buckets")

    headed = materialise(_headed(buckets), "headed_buckets")
    sizes = classes.groupBy("node").agg(F.max("n_shingles").alias("n_shingles"))
    homes = materialise(_homes(headed, sizes), "homes")
    # the one shuffle of texts; the same plan at every size
    chosen = named.join(homes.hint("merge"), named["doc_id"] == homes["node"])
    sets = materialise(_full_sets(chosen, words), "shingle_sets")
    links = _confirmed(materialise(_star_pairs(headed, homes), "star_pairs"), sets, percent, "links")
    components = materialise(connected_components(links), "components")
    more = _confirmed(_open_pairs(headed, components, homes, sets, percent), sets, percent, "open_links")
    copies = known.join(classes, ["low", "high", "n_shingles"]).select(F.col("doc_id").alias("b"), F.col("node").alias("a"))
    # rows that share an id but not their text tie two classes together
    ties = copies.groupBy("b").agg(F.min("a").alias("a"), F.max("a").alias("last")).where("a < last")
    tied = copies.join(ties.select("b", F.col("a").alias("least")), "b").select(F.col("least").alias("a"), F.col("a").alias("b"))
    components = connected_components(links.unionByName(more).unionByName(tied))

    labels = classes.join(components, "node", "left").select(
        "low", "high", "n_shingles", F.coalesce("component", "node").alias("component"))
    grouped = sketch.select("doc_id", "n_shingles", "low", "high").join(labels, ["low", "high", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return grouped.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
