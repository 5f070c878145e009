"""Shards of nearly equal size by sampled splitters.

Records are ordered by (hash of the text, id), so equal texts are neighbours. A sample in which a
record's chance is proportional to its size gives quantile boundaries of many more ranges than
shards. A boundary is moved to the first record of its text; only where a text fills whole ranges
by itself are its ranges subdivided by id. The exact size of every range is then measured, and a
record's place in the order of all bytes, range by range, decides its shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.sources.scratch import materialise

# Records besides their text: what a row costs.
OVERHEAD = 8
SAMPLES_PER_RANGE = 16
RANGES_PER_SHARD = 64
ROWS_PER_RANGE = 1_000_000
_LEAST = -(1 << 63)


def _splitters(records: DataFrame, ranges: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds (hash, id) of all ranges but the first, in order."""
    wanted = ranges * SAMPLES_PER_RANGE
    # a number in [0, 1) that a second run of the task draws again
    draw = (F.xxhash64("hash", "id", F.lit("draw")) / F.lit(2.0**64)) + F.lit(0.5)
    sample = records.where(draw < F.col("size") * F.lit(wanted / max(total, 1))).select("hash", "id")
    # about `wanted` rows of 16 bytes, whatever the table's size
    found = sample.toPandas().sort_values(["hash", "id"])
    picked = found.iloc[SAMPLES_PER_RANGE // 2 :: SAMPLES_PER_RANGE]
    hashes, ids = picked["hash"].to_numpy(np.int64), picked["id"].to_numpy(np.int64).copy()
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = hashes[1:] != hashes[:-1]
    ids[first] = _LEAST
    return hashes, ids


def _ranged(records: DataFrame, hashes: np.ndarray, ids: np.ndarray) -> DataFrame:
    """Add each record's range, and whether its text is spread over several."""
    single, counts = np.unique(hashes, return_counts=True)
    heavy = single[counts > 1]

    def run(batches):
        for batch in batches:
            h = batch.column(1).to_numpy()
            i = batch.column(0).to_numpy()
            place = np.searchsorted(hashes, h, side="left")
            for value in np.intersect1d(h, hashes):
                rows = np.flatnonzero(h == value)
                lo, hi = np.searchsorted(hashes, value, "left"), np.searchsorted(hashes, value, "right")
                place[rows] = lo + np.searchsorted(ids[lo:hi], i[rows], side="right")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place.astype(np.int64)), pa.array(np.isin(h, heavy))],
                names=[*batch.schema.names, "range", "heavy"])

    return records.mapInArrow(run, "id long, hash long, doc_id long, size long, text_crc32 long, range long, heavy boolean")


def assign_shards(docs: DataFrame, shards: int = 24, ranges: int | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and place of every document, under the law that shards have nearly equal bytes.

    Returns (doc_id, size, text_crc32, law, shard, slot, grown_shard). A document's size is the UTF-8
    bytes of its text (null: none) and OVERHEAD. Equal texts go to one shard unless they fill ranges
    of their own, of which each shard has RANGES_PER_SHARD at least. Slots are gapless from 0 in
    each shard. Null and empty texts are equal; null ids come first among equal texts; rows that
    repeat get slots of their own; an empty table gives an empty result. `law` is 'bytes', so
    grown_shard is null.

    Texts do not leave the scan: only five numbers a record are shuffled, once.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.col(id).cast("long")
    records = materialise(docs.select(
        F.coalesce(key, F.lit(_LEAST).cast("long")).alias("id"), F.xxhash64(body).alias("hash"), key.alias("doc_id"),
        (F.octet_length(body).cast("long") + OVERHEAD).alias("size"), F.crc32(body).alias("text_crc32")), "records")
    rows, total = records.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = ranges or shards * max(RANGES_PER_SHARD, -(-rows // (shards * ROWS_PER_RANGE)))
    ranged = _ranged(records, *_splitters(records, ranges, total))

    order = Window.partitionBy("range").orderBy("hash", "id")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("range", "hash")
    own = F.sum("size").over(before) - F.col("size")
    # twice the middle of the record's bytes, or of its text's records together
    middle = F.when(F.col("heavy"), 2 * F.col("own") + F.col("size")).otherwise(
        2 * F.min("own").over(same) + F.sum("size").over(same))
    placed = materialise(
        ranged.withColumn("own", own).withColumn("row", F.row_number().over(order) - 1).withColumn("middle", middle)
        .select("doc_id", "size", "text_crc32", "range", "row", "middle"), "ranges")
    # one row per range
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).select(
        "range", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"))
    share = (F.col("middle") + 2 * F.col("bytes_before")) / F.lit(2 * max(total, 1))
    ordered = placed.join(F.broadcast(starts), "range").select(
        "doc_id", "size", "text_crc32", F.least(F.lit(shards - 1), F.floor(share * shards)).cast("int").alias("shard"),
        (F.col("row") + F.col("rows_before")).alias("at"))
    firsts = ordered.groupBy("shard").agg(F.min("at").alias("first"))
    # one row per shard
    return ordered.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, id: str = "doc_id", text: str = "text") -> None:
    """Write the documents as Parquet, one folder `shard=N` per shard. Ids must be unique and not null."""
    homes = assign_shards(docs, shards, id=id, text=text).select(F.col("doc_id").alias(id), "shard", "slot")
    docs.join(homes, id).repartition("shard", F.pmod(F.col("slot"), F.lit(16))).write.partitionBy("shard").parquet(path)
