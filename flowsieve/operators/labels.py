"""Which network an address belongs to.

Networks can nest, and the first containing one in network order wins. A network never leaves
its /16 block, and a block touches fewer than 400 networks: at most 256 runs with a step of more
than 256 between them, plus the pieces of the two runs that can cross its borders (each halving
level has at most two split pieces there). So a block's networks fit in one array, the lookup
is an equi-join on the block, and no address-network pairs are ever emitted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.ip import ip_to_long
from flowsieve.operators.networks import ADDRESS_TEXT, distinct_addresses, folded_sources, networks_in_blocks, placed_addresses
from flowsieve.schema import key_list


def networks_by_block(networks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per (keys, /16 block) with its networks in order, from `networks_in_blocks`."""
    keys = key_list(keys)
    entry = F.struct("first_addr", "lo", "hi", "cidr")
    return (
        networks.where(F.col("lo").isNotNull())
        .groupBy(*keys, "block")
        .agg(F.sort_array(F.collect_list(entry)).alias("networks"))
    )


def _label(ip: str) -> str:
    """SQL: the first of `networks` that holds `addr`, else 'text/32'."""
    first = "try_element_at(filter(networks, n -> n.lo <= addr AND addr <= n.hi), 1).cidr"
    return f"coalesce({first}, {ip} || '/32')"


def labels_from_blocks(ips: DataFrame, blocks: DataFrame, keys: Sequence[str] = (), ip: str = "ip") -> DataFrame:
    """Label of every distinct address by `networks_by_block`."""
    keys = key_list(keys)
    return _labelled(distinct_addresses(ips, keys, ip), blocks, keys)


def _labelled(addresses: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    return addresses.join(blocks, [*keys, "block"], "left").select(
        *keys, F.expr(ADDRESS_TEXT).alias("ip"), F.expr(_label("loose")).alias("cidr"))


def labelled_sources(table: DataFrame) -> DataFrame:
    """`ip_to_cidr` of the sources of a log table that `write_log_table` has bucketed by block: addresses stay where they are."""
    return _labelled(placed_addresses(table), networks_by_block(folded_sources(table)), [])


def label_by_block(rows: DataFrame, blocks: DataFrame, ip: str, label: str) -> DataFrame:
    """Rows with the label of their address `ip`, by a broadcast of `networks_by_block` that is small."""
    placed = rows.selectExpr("*", f"{ip_to_long(ip)} AS addr").withColumn("block", F.expr("addr >> 16"))
    joined = placed.join(F.broadcast(blocks.select("block", "networks")), "block", "left")
    return joined.withColumn(label, F.expr(_label(ip))).drop("block", "addr", "networks")


def ip_to_cidr(ips: DataFrame, keys: Sequence[str] = (), ip: str = "ip") -> DataFrame:
    """Label of every distinct address: its first containing network, else 'text/32'."""
    keys = key_list(keys)
    return labels_from_blocks(ips, networks_by_block(networks_in_blocks(ips, keys, ip), keys), keys, ip)
