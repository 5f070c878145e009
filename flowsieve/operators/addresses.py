"""Joining ordered addresses to one text, and dropping networks that lie inside others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.ip import cidr_high, cidr_low, loose_block
from flowsieve.operators.joins import with_position
from flowsieve.schema import key_list


# Members of a chunk of an address list.
CHUNK = 1000


def address_rows(networks: DataFrame, keys: Sequence[str] = (), order: str = "first_addr", name: str = "address_rows") -> DataFrame:
    """The address list of each key as rows (keys, pos, cidr): address order, other labels last, pos from 0.

    `networks` has distinct CIDRs per key. Runs a job.
    """
    keys = key_list(keys)
    placed = with_position(networks.select(*keys, order, "cidr"), [*keys, F.col(order).asc_nulls_last(), "cidr"], "row_no", name)
    first = placed.groupBy(*keys).agg(F.min("row_no").alias("first_row"))
    joined = placed.join(first, keys) if keys else placed.withColumn("first_row", F.lit(0).cast("bigint"))
    return joined.select(*keys, (F.col("row_no") - F.col("first_row")).alias("pos"), "cidr")


def address_text(networks: DataFrame, keys: Sequence[str] = (), order: str = "first_addr") -> DataFrame:
    """One row per key: its distinct CIDRs joined with ', ' in address order, other labels last.

    A last step for results whose record is one text: the text grows with the list, up to the 2 GB
    that a value may have, and nothing is cut. `address_rows` has the same lists without that limit.
    Rows are sorted by ranges and joined CHUNK at a time before the chunks of a key meet.
    """
    keys = key_list(keys)
    by = [*keys, F.col(order).asc_nulls_last(), "cidr"]
    # the id is (partition << 33) + row number, and range partitions follow each other in order
    row = networks.select(*keys, order, "cidr").repartitionByRange(*by).sortWithinPartitions(*by).withColumn(
        "row_id", F.monotonically_increasing_id())
    chunks = (
        row.withColumn("part", F.shiftright("row_id", 33))
        .withColumn("chunk", F.floor(F.col("row_id").bitwiseAND(F.lit((1 << 33) - 1)) / CHUNK))
        .groupBy(*keys, "part", "chunk")
        .agg(F.sort_array(F.collect_list(F.struct("row_id", "cidr"))).alias("members"))
        .select(*keys, F.struct("part", "chunk", F.array_join("members.cidr", ", ").alias("text")).alias("chunk"))
    )
    return chunks.groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_list("chunk")).getField("text"), ", ").alias("addresses"))


def outermost_networks(cidrs: DataFrame, keys: Sequence[str] = (), cidr: str = "cidr") -> DataFrame:
    """Distinct CIDRs of each key without those that another one contains; adds `lo`.

    Texts that are no IPv4 CIDR stay, with a null `lo`. A network wider than /16 is repeated for
    every /16 it covers: at most 65,536 copies of each of the nested widths.
    """
    keys = key_list(keys)
    nets = (
        cidrs.select(*keys, F.col(cidr).alias("cidr"))
        .distinct()
        .selectExpr("*", f"{cidr_low('cidr')} AS lo", f"{cidr_high('cidr')} AS hi")
        .selectExpr("*", f"coalesce(lo >> 16, {loose_block('cidr')}) AS home")
    )
    covered = nets.selectExpr("*", "explode(sequence(home, coalesce(hi >> 16, home))) AS block")
    wider = (
        Window.partitionBy(*keys, "block")
        .orderBy("lo", F.desc("hi"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    kept = covered.withColumn("reach", F.max("hi").over(wider))
    return kept.where("block = home AND NOT coalesce(reach >= hi, false)").select(*keys, "cidr", "lo")
