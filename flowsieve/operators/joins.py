"""Joins and positions that hold when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.schema import key_list
from flowsieve.sources.scratch import materialise

# A lookup table of at most this many bytes is broadcast.
BROADCAST_BYTES = 8 << 20


def is_small(table: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a materialised table of texts may be broadcast: by the bytes of its texts and 32 a row."""
    texts = [F.coalesce(F.octet_length(name), F.lit(0)) for name, kind in table.dtypes if kind == "string"]
    size = sum(texts, F.lit(32)).cast("bigint")
    return table.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= limit


def lookup_join(rows: DataFrame, lookup: DataFrame, on: Sequence[str] | str, small: bool, how: str = "left") -> DataFrame:
    """Join many rows to a lookup table that is unique in `on`.

    A small lookup is broadcast. Otherwise both sides are shuffled by `on`, and Spark splits the
    partitions in which a hot key has gathered many rows.
    """
    return rows.join(F.broadcast(lookup) if small else lookup, key_list(on), how)


def with_position(df: DataFrame, order: Sequence, position: str, name: str) -> DataFrame:
    """Add the 0-based position of each row under a total order, without one global window.

    Rows are range-partitioned and sorted within partitions; the written table keeps the row
    number inside its partition, and the row counts of the partitions give the offsets.
    """
    numbered = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("row_id", F.monotonically_increasing_id())
    )
    # monotonically_increasing_id is (partition << 33) + row number in the partition
    placed = (
        materialise(numbered, name)
        .withColumn("part", F.shiftright("row_id", 33))
        .withColumn("row_in_part", F.col("row_id").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    # one row per range partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg(F.count("*").alias("rows")).select(
        "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    return (
        placed.join(F.broadcast(offsets), "part")
        .withColumn(position, F.col("offset") + F.col("row_in_part"))
        .drop("part", "offset", "row_in_part", "row_id")
    )
