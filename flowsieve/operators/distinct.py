"""Exact distinct counts that merge: sets of addresses and ports as bitmaps.

A set of numbers is a table of bitmaps, one per bucket of 32,768 numbers, and its other members are
texts. Sets of the same fields, of two logs or of many days, unite by a bitwise or of their buckets,
and counting adds up set bits, so no row of the log is read again and none is multiplied for the
three fields. Each field is read by itself: of a columnar log that is each column once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.ip import ip_to_long
from flowsieve.operators.counts import row_count
from flowsieve.schema import FLOW_COUNT, key_list

# fields of a flow, with the SQL of their number
FIELDS = {"src_ip": ip_to_long("value"), "dst_ip": ip_to_long("value"), "dst_port": "CAST(value AS BIGINT)"}
PORTS_FIELD = "dst_port"
# what a bitmap table has besides its keys
COLUMNS = ("field", "bucket", "loose", "bitmap", "rows")


def _field_bitmaps(flows: DataFrame, field: str, keys: list[str]) -> DataFrame:
    weight = [FLOW_COUNT] if FLOW_COUNT in flows.columns else []
    values = flows.select(*keys, F.col(field).alias("value"), *weight).selectExpr("*", f"{FIELDS[field]} AS number")
    placed = values.selectExpr(
        "*", "bitmap_bucket_number(number) AS bucket", "CASE WHEN number IS NULL THEN CAST(value AS STRING) END AS loose")
    sets = placed.groupBy(*keys, "bucket", "loose").agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(number))").alias("bitmap"), row_count(values).alias("rows"))
    return sets.select(*keys, F.lit(field).alias("field"), "bucket", "loose", F.when(F.col("bucket").isNotNull(), F.col("bitmap")).alias("bitmap"), "rows")


def distinct_bitmaps(flows: DataFrame, keys: Sequence[str] = (), fields: Sequence[str] = tuple(FIELDS)) -> DataFrame:
    """The values of each field and key: (keys, field, bucket, loose, bitmap, rows).

    IPv4 addresses and ports are bits of `bitmap` in their bucket, other texts stand in `loose`, and the
    rows without a value are in the row where both are null. `rows` counts log rows.
    """
    keys = key_list(keys)
    return reduce(DataFrame.unionByName, [_field_bitmaps(flows, field, keys) for field in fields])


def merge_bitmaps(tables: Sequence[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """The bitmaps of all logs together, from those of each."""
    keys = key_list(keys)
    united = reduce(DataFrame.unionByName, tables).groupBy(*keys, "field", "bucket", "loose").agg(
        F.expr("bitmap_or_agg(bitmap)").alias("bitmap"), F.sum("rows").alias("rows"))
    return united.withColumn("bitmap", F.when(F.col("bucket").isNotNull(), F.col("bitmap"))).select(*keys, *COLUMNS)


def count_bitmaps(bitmaps: DataFrame, keys: Sequence[str] = (), unique: bool = False) -> DataFrame:
    """(keys, rows, src_ip, dst_ip, dst_port): log rows, and distinct values of each field, nulls ignored.

    Bitmaps of one bucket, from several logs or finer keys, are united first; `unique` says there are none.
    """
    keys = key_list(keys)
    if not unique:
        bitmaps = merge_bitmaps([bitmaps.select(*keys, *COLUMNS)], keys)
    members = F.when(F.col("bucket").isNotNull(), F.expr("bitmap_count(bitmap)")).otherwise(F.col("loose").isNotNull().cast("bigint"))
    nothing = F.lit(0).cast("bigint")
    # every field has seen every row
    rows = F.coalesce(F.max("seen"), nothing).alias("rows")
    by_field = bitmaps.groupBy(*keys, "field").agg(F.sum(members).alias("members"), F.sum("rows").alias("seen"))
    return by_field.groupBy(*keys).agg(
        rows, *[F.coalesce(F.max(F.when(F.col("field") == field, F.col("members"))), nothing).alias(field) for field in FIELDS])


def port_lists(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, destination_ports): the ascending ports of each key, at most 65,536."""
    names = [f"`{k}`" for k in key_list(keys)]
    ports = bitmaps.where((F.col("field") == PORTS_FIELD) & F.col("bucket").isNotNull())
    # number 0 is bit 0 of bucket 0; bit p of a later bucket b is number (b - 1) * 32768 + p + 1
    filled = ports.selectExpr(*names, "bucket", "explode(sequence(0, octet_length(bitmap) - 1)) AS at", "bitmap").selectExpr(
        *names, "CASE WHEN bucket = 0 THEN 0 ELSE (bucket - 1) * 32768 + 1 END + 8 * at AS first",
        "CAST(conv(hex(substring(bitmap, at + 1, 1)), 16, 10) AS INT) AS bits").where("bits <> 0")
    found = filled.selectExpr(
        *names, "explode(filter(transform(sequence(0, 7), i -> CASE WHEN (bits >> i) & 1 = 1 THEN CAST(first + i AS INT) END), x -> x IS NOT NULL)) AS port")
    return found.groupBy(*key_list(keys)).agg(F.sort_array(F.collect_list("port")).alias("destination_ports"))
