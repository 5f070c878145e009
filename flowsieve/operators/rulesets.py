"""Rules proposed from the traffic: one for all of it, one per network pair, or at most seven."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.services import CUSTOM_PREFIX, ports_to_services, services_text, text_or_any
from flowsieve.operators.addresses import address_text, outermost_networks
from flowsieve.operators.containment import BY_NETWORK, ip_to_given_networks
from flowsieve.operators.joins import is_small, lookup_join, with_position
from flowsieve.operators.labels import label_by_block, labels_from_blocks, networks_by_block
from flowsieve.operators.networks import DESTINATION, SOURCE, both_sides, count_sides_and_ports, ip_networks, networks_in_blocks
from flowsieve.operators.counts import row_count
from flowsieve.operators.traffic import summarise_flows
from flowsieve.schema import FLOW_COUNT
from flowsieve.sources.scratch import materialise

MAX_RULES = 7
TOP_RULES = MAX_RULES - 1
RULE_FIELDS = ("rule_name", "source_address", "destination_address", "service", "log_count")


def aggregate_single_rule(flows: DataFrame) -> DataFrame:
    """One rule that covers the whole log: its networks, services and row count. Runs a job that reads a log."""
    sides, ports = count_sides_and_ports(flows)
    return single_rule_of(ip_networks(sides, "side"), ports)


def single_rule_of(networks: DataFrame, flows: DataFrame, inline: int | None = None) -> DataFrame:
    """`aggregate_single_rule` from networks (side, cidr, first_addr) and the ports of the flows.

    Of a side with more than `inline` networks the text only says how many there are, so that no
    record grows with the log.
    """
    listed = networks
    if inline is not None:
        # two rows
        sizes = networks.groupBy("side").agg(F.count(F.lit(1)).alias("size"))
        sized = networks.join(F.broadcast(sizes), "side")
        counted = sizes.where(F.col("size") > inline).select(
            "side", F.concat(F.col("size").cast("string"), F.lit(" networks")).alias("cidr"), F.lit(0).cast("bigint").alias("first_addr"))
        listed = sized.where(F.col("size") <= inline).select("side", "cidr", "first_addr").unionByName(counted)
    addresses = address_text(listed, "side").select("side", "addresses", F.lit(0).cast("bigint").alias("rows"))
    by_port = flows.groupBy("dst_port").agg(row_count(flows).alias("rows"))
    # at most one row per port
    traffic = by_port.agg(
        F.lit("traffic").alias("side"),
        services_text(F.sort_array(F.collect_list("dst_port"))).alias("addresses"),
        F.coalesce(F.sum("rows"), F.lit(0).cast("bigint")).alias("rows"),
    )
    parts = addresses.unionByName(traffic)

    def part(side: str):
        return text_or_any(F.max(F.when(F.col("side") == side, F.col("addresses"))))

    return parts.agg(
        part(SOURCE).alias("source_address"),
        part(DESTINATION).alias("destination_address"),
        part("traffic").alias("service"),
        F.sum("rows").alias("log_count"),
    )


def label_flows(flows: DataFrame, networks: DataFrame | None = None, order: str = BY_NETWORK) -> DataFrame:
    """Row counts and ports by (source network, destination network).

    Rows are merged per (source, destination, port) first. Without `networks` they are labelled with
    the networks that their own addresses fold into. Those are kept by /16 block; a small table of
    blocks is broadcast and rows take their labels where they are. Otherwise every distinct address
    is labelled once and rows take their two labels by an equi-join on the address, whose hot keys
    Spark splits at run time.

    `networks` are the caller's own: (cidr), or (side, cidr) to tell sources from destinations, with
    the `order` of `ip_to_given_networks`. Rows without an address take no part. Runs a job.
    """
    flows = flows.dropna(subset=["src_ip", "dst_ip"])
    weight = [FLOW_COUNT] if FLOW_COUNT in flows.columns else []
    rows = materialise(summarise_flows(flows.select("src_ip", "dst_ip", "dst_port", *weight)), "merged_flows")
    sides = ((SOURCE, "src_ip", "src_cidr"), (DESTINATION, "dst_ip", "dst_cidr"))
    if networks is None:
        folded = materialise(networks_in_blocks(both_sides(rows), "side"), "networks")
        blocks = networks_by_block(folded, "side")
        if is_small(folded):
            for side, ip, label in sides:
                rows = label_by_block(rows, blocks.where(F.col("side") == side), ip, label)
            return _by_pair(rows)
        labels = materialise(labels_from_blocks(both_sides(rows), blocks, "side"), "labels")
    else:
        by_side = ["side"] if "side" in networks.columns else []
        labels = materialise(
            ip_to_given_networks(both_sides(rows), networks, "side", order=order, network_keys=by_side), "labels")
    small = is_small(labels)
    for side, ip, label in sides:
        of_side = labels.where(F.col("side") == side).select(F.col("ip").alias(ip), F.col("cidr").alias(label))
        rows = lookup_join(rows, of_side, ip, small)
    return _by_pair(rows)


def _by_pair(rows: DataFrame) -> DataFrame:
    by_port = rows.groupBy("src_cidr", "dst_cidr", "dst_port").agg(row_count(rows).alias("rows"))
    return by_port.groupBy("src_cidr", "dst_cidr").agg(
        F.sum("rows").alias("log_count"),
        F.sort_array(F.collect_list("dst_port")).alias("ports"),
    )


def generate_cidr_pair_rules(flows: DataFrame, networks: DataFrame | None = None, order: str = BY_NETWORK) -> DataFrame:
    """One rule per network pair, numbered in text order of the pair; `networks` as in `label_flows`."""
    numbered = with_position(label_flows(flows, networks, order), ["src_cidr", "dst_cidr"], "rule_idx", "cidr_pairs")
    return numbered.select(
        "rule_idx",
        F.concat(F.lit("cidr_pair_rule_"), F.col("rule_idx").cast("string")).alias("rule_name"),
        F.col("src_cidr").alias("source_address"),
        F.col("dst_cidr").alias("destination_address"),
        services_text(F.col("ports")).alias("service"),
        "log_count",
    )


def _kept(rules: DataFrame) -> DataFrame:
    """The rules that stay: all of seven or fewer, else the six busiest."""
    first = rules.orderBy(F.desc("log_count"), "rule_idx").limit(MAX_RULES + 1)
    # eight rows at most
    total = F.count("*").over(Window.partitionBy(F.lit(0)))
    place = F.row_number().over(Window.orderBy(F.desc("log_count"), "rule_idx"))
    return first.withColumn("total", total).withColumn("kept_place", place).where(
        (F.col("total") <= MAX_RULES) | (F.col("kept_place") <= TOP_RULES)).drop("total", "kept_place")


def rule_tail(rules: DataFrame) -> DataFrame:
    """The rules that are merged: all but the six busiest, and none of seven or fewer."""
    # the broadcast side has seven rows at most
    return rules.join(F.broadcast(_kept(rules).select("rule_idx")), "rule_idx", "left_anti")


def _listed(text: str) -> Column:
    return F.transform(F.split(text, ","), lambda part: F.trim(part))


def tail_addresses(tail: DataFrame) -> DataFrame:
    """Two lists of addresses as rows: (rule_idx, log_count, side, pos, cidr)."""
    sides = F.stack(F.lit(2), F.lit(SOURCE), F.col("source_address"), F.lit(DESTINATION), F.col("destination_address"))
    lists = tail.select("rule_idx", "log_count", sides.alias("side", "list"))
    return lists.select("rule_idx", "log_count", "side", F.posexplode(_listed("list")).alias("pos", "cidr"))


def catch_all_networks(rules: DataFrame) -> DataFrame:
    """The networks of the catch-all rule as rows (side, cidr, lo); empty while no rule is merged."""
    return outermost_networks(tail_addresses(rule_tail(rules)), "side")


def catch_all_labels(rules: DataFrame) -> DataFrame:
    """The catch-all addresses in the literal form: every CIDR of the tail with '/32' appended.

    Rows (side, pos, address), repeats kept, busiest rule first.
    """
    listed = tail_addresses(rule_tail(rules))
    placed = with_position(
        listed, ["side", F.desc("log_count"), "rule_idx", "pos"], "row_no", "catch_all_labels")
    first = placed.groupBy("side").agg(F.min("row_no").alias("first_row"))
    # two rows, one per side
    return placed.join(F.broadcast(first), "side").select(
        "side", (F.col("row_no") - F.col("first_row")).alias("pos"), F.concat("cidr", F.lit("/32")).alias("address"))


def _catch_all_services(tail: DataFrame) -> DataFrame:
    """The labels of all services in the tail, as one row; custom ports merge into one label."""
    token = F.explode(_listed("service"))
    tokens = tail.select(token.alias("token")).distinct()
    custom = F.col("token").startswith(CUSTOM_PREFIX)
    ports = F.split(F.substring_index("token", CUSTOM_PREFIX, -1), "-")
    parts = tokens.select(F.explode(F.when(custom, ports).otherwise(F.array("token"))).alias("part"), custom.alias("custom"))
    known = parts.distinct().agg(
        F.collect_list(F.when(~F.col("custom"), F.col("part"))).alias("names"),
        F.sort_array(F.collect_list(F.when(F.col("custom"), F.col("part").try_cast("int")))).alias("ports"),
    )
    labels = F.array_sort(F.array_distinct(F.concat("names", ports_to_services(F.col("ports")))))
    return known.select(F.array_join(labels, ", ").alias("text"))


def cap_rules_to_seven(rules: DataFrame, compat: bool = False) -> DataFrame:
    """Keep the six busiest rules and merge the others; seven rules or fewer stay as they are.

    `rules` has rule_idx and the five rule fields. Adds `place`, the 1-based order of the result:
    by count after a merge, by rule_idx otherwise. With `compat` the catch-all's addresses are in the
    literal form of `catch_all_labels`, joined to one text each; that runs a job.
    """
    literal = None
    if compat:
        literal = address_text(catch_all_labels(rules).withColumnRenamed("address", "cidr"), "side", order="pos")
    return _capped(_kept(rules), rule_tail(rules), literal)


def _capped(kept: DataFrame, tail: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """The kept rules and, if there is a tail, its catch-all with these (side, addresses) or its outermost networks."""
    totals = tail.agg(
        F.count("*").alias("merged"),
        F.sum("log_count").alias("log_sum"),
    )
    if addresses is None:
        addresses = address_text(outermost_networks(tail_addresses(tail), "side"), "side", order="lo")
    texts = addresses.select(F.col("side").alias("part"), F.col("addresses").alias("text")).unionByName(
        _catch_all_services(tail).select(F.lit("service").alias("part"), "text"))
    parts = totals.unionByName(texts, allowMissingColumns=True)

    def text(name):
        return F.max(F.when(F.col("part") == name, F.col("text")))

    # four rows at most: the tail's totals, its two address texts and its services
    joined = parts.agg(
        F.max("merged").alias("merged"),
        F.max("log_sum").alias("log_sum"),
        text_or_any(text(SOURCE)).alias("source_address"),
        text_or_any(text(DESTINATION)).alias("destination_address"),
        text_or_any(text("service")).alias("service"),
    ).where("merged > 0")
    last = joined.select(
        F.lit(None).cast("bigint").alias("rule_idx"), F.lit("catch_all_tail").alias("rule_name"), "source_address",
        "destination_address", "service", F.col("log_sum").alias("log_count"))
    capped = kept.select("rule_idx", *RULE_FIELDS).unionByName(last)
    # seven rows at most reach these windows
    merged = F.max(F.col("rule_idx").isNull()).over(Window.partitionBy(F.lit(0)))
    order = Window.orderBy("last", F.when(F.col("is_merged"), -F.col("log_count")), "rule_idx")
    return (
        capped.withColumn("is_merged", merged)
        .withColumn("last", F.col("rule_idx").isNull())
        .withColumn("place", F.row_number().over(order))
        .select(*RULE_FIELDS, "place")
    )


def generate_lean_rule_set(flows: DataFrame, networks: DataFrame | None = None, order: str = BY_NETWORK) -> DataFrame:
    """At most seven rules that cover the traffic; `networks` as in `label_flows`.

    The same as `cap_rules_to_seven` over `generate_cidr_pair_rules`, without numbering all pairs:
    only the rules that stay have numbers in their names, and such a number is the count of pairs
    that sort before. Runs its jobs when called.
    """
    pairs = materialise(label_flows(flows, networks, order), "cidr_pairs")
    first = pairs.orderBy(F.desc("log_count"), "src_cidr", "dst_cidr").limit(MAX_RULES + 1).collect()
    kept = first if len(first) <= MAX_RULES else first[:TOP_RULES]
    pair = F.struct("src_cidr", "dst_cidr")
    keys = [F.struct(F.lit(r.src_cidr).alias("src_cidr"), F.lit(r.dst_cidr).alias("dst_cidr")) for r in kept]
    # one pass: a count for each of seven pairs at most
    before = pairs.agg(F.lit(0), *[F.count(F.when(pair < key, 1)) for key in keys]).first()[1:]
    number = F.coalesce(*[F.when(pair == key, F.lit(n)) for key, n in zip(keys, before, strict=True)], F.lit(-1)).cast("bigint")
    rules = pairs.withColumn("rule_idx", number).select(
        "rule_idx", F.concat(F.lit("cidr_pair_rule_"), F.col("rule_idx").cast("string")).alias("rule_name"),
        F.col("src_cidr").alias("source_address"), F.col("dst_cidr").alias("destination_address"),
        services_text(F.col("ports")).alias("service"), "log_count")
    return _capped(rules.where("rule_idx >= 0"), rules.where("rule_idx < 0"))
