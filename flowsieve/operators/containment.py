"""Containment in networks that the caller brings: any prefix length, nested or not, in the caller's order.

An address lies in a network of n leading bits if its own first n bits are the network's. So an address
is looked up once for every prefix length that occurs, 33 at most, by an equi-join on (first bits,
length): no range join, and no address-network pairs but the true ones.

A small table of networks is broadcast. Of a large one only the networks of up to WIDE bits are, of
which there are fewer than 2 ** 17 for each of the join's other keys; they are the ones that very many
addresses share. The others meet the addresses in a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.ip import cidr_low, clear_low_bits, ip_to_long
from flowsieve.functions.services import ANY
from flowsieve.operators.joins import is_small
from flowsieve.operators.networks import DESTINATION, SOURCE
from flowsieve.schema import key_list
from flowsieve.sources.scratch import materialise

WIDE = 16
ALL_ADDRESSES = "0.0.0.0/0"
# Orders in which the first containing network is meant, besides a column of the network table.
BY_NETWORK, BY_LENGTH = "network", "longest"


def _order(order: str) -> Column:
    """Sortable: the smallest one wins."""
    if order == BY_NETWORK:
        return F.struct(F.col("net").alias("first"), F.col("plen").alias("second"), F.lit(0).cast("bigint").alias("third"))
    if order == BY_LENGTH:
        return F.struct((-F.col("plen")).cast("bigint").alias("first"), F.lit(0).alias("second"), F.lit(0).cast("bigint").alias("third"))
    return F.struct(F.col("ordinal").cast("bigint").alias("first"), F.col("plen").alias("second"), F.col("net").alias("third"))


def parse_networks(networks: DataFrame, keys: Sequence[str] = (), cidr: str = "cidr", order: str = BY_NETWORK) -> DataFrame:
    """Distinct networks of each key: (keys, net, plen, hit), where hit is (order, cidr).

    'a.b.c.d/n' may have host bits, which are cleared; 'a.b.c.d' is one address and 'any' all of
    them. Other texts drop out, see `unreadable_networks`. Of one network in several spellings the
    first in the order stays.
    """
    keys = key_list(keys)
    extra = [] if order in (BY_NETWORK, BY_LENGTH) else [F.col(order).alias("ordinal")]
    text = F.trim(F.col(cidr))
    named = networks.select(*keys, F.col(cidr).alias("cidr"), F.when(text == ANY, ALL_ADDRESSES).when(
        text.contains("/"), text).otherwise(F.concat(text, F.lit("/32"))).alias("text"), *extra)
    placed = named.selectExpr("*", f"{cidr_low('text')} AS net").where("net IS NOT NULL").selectExpr(
        "*", "CAST(substring_index(text, '/', -1) AS INT) AS plen")
    first = F.min(F.struct(_order(order).alias("order"), "cidr")).alias("hit")
    return placed.groupBy(*keys, "net", "plen").agg(first)


def unreadable_networks(networks: DataFrame, cidr: str = "cidr") -> DataFrame:
    """Texts that `parse_networks` leaves out, with the number of rows."""
    kept = parse_networks(networks.select(F.col(cidr).alias("text_read")).distinct(), ["text_read"], "text_read").select("text_read").distinct()
    seen = networks.groupBy(F.col(cidr).alias("text_read")).agg(F.count(F.lit(1)).alias("rows"))
    return seen.join(kept, "text_read", "left_anti").select(F.col("text_read").alias("cidr"), "rows")


def ip_to_given_networks(
    ips: DataFrame,
    networks: DataFrame,
    keys: Sequence[str] = (),
    ip: str = "ip",
    cidr: str = "cidr",
    order: str = BY_NETWORK,
    network_keys: Sequence[str] = (),
) -> DataFrame:
    """Label of every distinct address of each key: its first containing network, else 'text/32'.

    Returns (keys, ip, cidr, given); `given` says whether a network was found. `order` is 'network'
    (ascending first address, wider ones first), 'longest' (the most specific one) or the name of a
    column of `networks`. Networks hold for all keys, or where `network_keys`, some of `keys`, are
    equal. Null addresses and keys drop out. Runs a job that reads `networks`.
    """
    keys, on = key_list(keys), key_list(network_keys)
    table = materialise(parse_networks(networks, on, cidr, order), "given_networks")
    # 33 values at most
    lengths = sorted(r.plen for r in table.select("plen").distinct().collect())
    # the text stays beside its number, so that the rows of an address stay where the distinct has put them
    found = ips.select(*keys, F.col(ip).alias("ip")).dropna().distinct().selectExpr("*", f"{ip_to_long('ip')} AS addr")

    def probe(rows: DataFrame, lengths: Sequence[int]) -> DataFrame:
        probes = rows.withColumn("plen", F.explode(F.array(*[F.lit(n) for n in lengths])))
        return probes.selectExpr("*", f"{clear_low_bits('addr', '(32 - plen)')} AS net")

    nothing = F.lit(None).cast(table.schema["hit"].dataType).alias("hit")
    columns = [*keys, "ip", "hit"]
    if not lengths:
        hits = found.select(*keys, "ip", nothing)
    elif is_small(table):
        hits = probe(found, lengths).join(F.broadcast(table), [*on, "net", "plen"], "left").select(*columns)
    else:
        parts = [found.select(*keys, "ip", nothing)]
        for kept in ([n for n in lengths if n <= WIDE], [n for n in lengths if n > WIDE]):
            if kept:
                of_length = table.where(F.col("plen").isin(kept))
                small = kept[-1] <= WIDE and (not on or is_small(of_length))
                matched = probe(found.where("addr IS NOT NULL"), kept).join(
                    F.broadcast(of_length) if small else of_length, [*on, "net", "plen"])
                parts.append(matched.select(*columns))
        hits = reduce(DataFrame.unionByName, parts)
    first = hits.groupBy(*keys, "ip").agg(F.min("hit").alias("hit"))
    return first.select(
        *keys, "ip", F.coalesce(F.col("hit.cidr"), F.concat("ip", F.lit("/32"))).alias("cidr"), F.col("hit").isNotNull().alias("given"))


def rule_networks(rules: DataFrame) -> DataFrame:
    """The address lists of a rule table as rows (rule_name, side, pos, cidr), in list order from 0."""
    sides = F.stack(F.lit(2), F.lit(SOURCE), F.col("source_address"), F.lit(DESTINATION), F.col("destination_address"))
    lists = rules.select("rule_name", sides.alias("side", "list")).where("list IS NOT NULL")
    parts = F.transform(F.split("list", ","), lambda part: F.trim(part))
    return lists.select("rule_name", "side", F.posexplode(parts).alias("pos", "cidr")).where("cidr <> ''")
