"""Comparing a rule table with the log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.services import ANY, services_text, text_or_any
from flowsieve.operators import distinct
from flowsieve.operators.addresses import address_text
from flowsieve.operators.joins import is_small, lookup_join
from flowsieve.operators.counts import row_count
from flowsieve.operators.networks import DESTINATION, SOURCE, both_sides, count_sides_and_ports, ip_networks
from flowsieve.schema import FLOW_COUNT
from flowsieve.sources.scratch import materialise

REMOVE_UNUSED = "Consider removing this unused rule"
REVIEW_RISKY = "This rule is marked as risky and should be reviewed"
NOTHING_TO_DO = "No optimization needed"
Grouping = Callable[..., DataFrame]


def _of_rules(flows: DataFrame) -> DataFrame:
    return flows.where(F.col("rule_name").isNotNull())


def _usage(flows: DataFrame) -> DataFrame:
    return _of_rules(flows).groupBy("rule_name").agg(row_count(flows).alias("log_count"))


def rule_usage(flows: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule table with the number of log rows of each rule, 0 for unused ones."""
    joined = rules.join(_usage(flows), "rule_name", "left")
    return joined.withColumn("log_count", F.coalesce("log_count", F.lit(0).cast("bigint")))


def rule_hits(flows: DataFrame, rules: DataFrame, add: bool = False) -> DataFrame:
    """The rule table with `hits` replaced by the counts of this log, or increased by them."""
    hits = F.col("log_count")
    if add:
        hits += F.coalesce(F.col("hits"), F.lit(0))
    # a table without the column gets it at its end
    return rule_usage(flows, rules).withColumn("hits", hits).drop("log_count").select(*dict.fromkeys([*rules.columns, "hits"]))


def unused_rules(flows: DataFrame, rules: DataFrame) -> DataFrame:
    return rule_usage(flows, rules).where("log_count = 0").select("rule_name", "description", "priority")


def permissive_rules(flows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules marked permissive that the log uses."""
    used = rule_usage(flows, rules).where("risky_permissive = 'permissive' AND log_count > 0")
    return used.select(
        "rule_name", "description", "source_address", "destination_address", "service", "log_count")


def rule_patterns(flows: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct sources, destinations and ports of every used rule, and its port list.

    The address lists, which grow with the log, are rows of `rule_pattern_values`. Runs a job that
    reads the log, each field by itself.
    """
    return patterns_of_bitmaps(distinct.distinct_bitmaps(_of_rules(flows), "rule_name"), rules)


def patterns_of_bitmaps(bitmaps: DataFrame, rules: DataFrame) -> DataFrame:
    """`rule_patterns` of stored bitmaps by rule_name, each bucket once. Runs a job that reads them."""
    sets = materialise(bitmaps.join(rules.select("rule_name"), "rule_name", "left_semi"), "rule_bitmaps")
    patterns = distinct.count_bitmaps(sets, "rule_name", unique=True).select(
        "rule_name", F.col("src_ip").alias("unique_source_ips"), F.col("dst_ip").alias("unique_destination_ips"),
        F.col("dst_port").alias("unique_destination_ports"))
    return patterns.join(distinct.port_lists(sets, "rule_name"), "rule_name", "left").withColumn(
        "destination_ports", F.coalesce("destination_ports", F.array().cast("array<int>")))


def _port_lists(flows: DataFrame) -> DataFrame:
    """At most 65,536 ports per rule, merged before they meet."""
    ports = _of_rules(flows).select("rule_name", "dst_port").dropna().distinct()
    return ports.groupBy("rule_name").agg(F.sort_array(F.collect_list("dst_port")).alias("destination_ports"))


def rule_pattern_values(flows: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct values behind `rule_patterns`, as rows (rule_name, field, value)."""
    names = materialise(rules.select("rule_name"), "rule_names")
    fields = F.stack(
        F.lit(3),
        F.lit("source_ips"), F.col("src_ip"),
        F.lit("destination_ips"), F.col("dst_ip"),
        F.lit("destination_ports"), F.col("dst_port").cast("string"),
    )
    values = _of_rules(flows).select("rule_name", fields.alias("field", "value")).dropna().distinct()
    return lookup_join(values, names, "rule_name", is_small(names), "left_semi")


def port_services(flows: DataFrame, to_services: Callable[[Column], Column] = services_text) -> DataFrame:
    """Service labels of each rule's ports, in ascending port order."""
    return _port_lists(flows).select("rule_name", to_services(F.col("destination_ports")).alias("service"))


def networks_by_rule_addresses(flows: DataFrame) -> DataFrame:
    """(rule_name, side, ip) of the log rows that name a rule."""
    return both_sides(_of_rules(flows), "rule_name")


def networks_by_rule(flows: DataFrame, group_ips: Grouping = ip_networks) -> DataFrame:
    """Networks of every rule and side: (rule_name, side, cidr, first_addr, ...)."""
    return group_ips(networks_by_rule_addresses(flows), ["rule_name", "side"])


def _traffic_of_rules(
    sides: DataFrame, ports: DataFrame, group_ips: Grouping, to_services: Callable[[Column], Column]
) -> DataFrame:
    """One row per rule in the log: row count, services, and the texts of its addresses in `sides`."""
    folded = group_ips(sides.drop(FLOW_COUNT), ["rule_name", "side"])
    texts = address_text(folded, ["rule_name", "side"])

    def side(name: str) -> Column:
        return F.max(F.when(F.col("side") == name, F.col("addresses")))

    addresses = texts.groupBy("rule_name").agg(
        side(SOURCE).alias("seen_sources"), side(DESTINATION).alias("seen_destinations"))
    by_port = ports.groupBy("rule_name", "dst_port").agg(row_count(ports).alias("rows"))
    totals = by_port.groupBy("rule_name").agg(
        F.sum("rows").alias("log_count"),
        to_services(F.sort_array(F.collect_list("dst_port"))).alias("seen_services"),
    )
    return totals.join(addresses, "rule_name", "left")


def log_based_rules(
    flows: DataFrame, group_ips: Grouping = ip_networks, to_services: Callable[[Column], Column] = services_text
) -> DataFrame:
    """A rule and a recommendation for every rule name in the log, without a rule table. Runs a job that reads a log."""
    sides, ports = count_sides_and_ports(_of_rules(flows), "rule_name")
    rule = _traffic_of_rules(sides, ports, group_ips, to_services).select(
        "rule_name",
        text_or_any(F.col("seen_sources")).alias("source_address"),
        text_or_any(F.col("seen_destinations")).alias("destination_address"),
        text_or_any(F.col("seen_services")).alias("service"),
        "log_count",
    )
    advice = F.concat(
        F.lit("Optimize source address to "), "source_address",
        F.lit("; Optimize destination address to "), "destination_address",
        F.lit("; Optimize service to "), "service",
    )
    return rule.withColumn("recommendation", advice)


def generate_optimized_rules(
    flows: DataFrame,
    rules: DataFrame | None,
    group_ips: Grouping = ip_networks,
    to_services: Callable[[Column], Column] = services_text,
) -> DataFrame:
    """Advice for every rule of the table: (rule_name, original_rule, recommendation, optimized_rule).

    A field that is 'any' is narrowed to what the log shows. `optimized_rule` is null for unused
    rules and for those with nothing to advise. Without a rule table the rules of `log_based_rules`
    are the optimized ones; their fields, `log_count` included, are also columns of their own.
    """
    if rules is None:
        found = log_based_rules(flows, group_ips, to_services)
        optimized = F.struct("rule_name", "source_address", "destination_address", "service", "log_count")
        nothing = F.lit(None).cast(found.select(optimized).schema[0].dataType)
        return found.select(
            "rule_name", nothing.alias("original_rule"), "recommendation", optimized.alias("optimized_rule"),
            "source_address", "destination_address", "service", "log_count")
    sides, ports = count_sides_and_ports(_of_rules(flows), "rule_name")
    seen = {
        "source_address": ("seen_sources", "Restrict source address to "),
        "destination_address": ("seen_destinations", "Restrict destination address to "),
        "service": ("seen_services", "Restrict service to "),
    }
    # only these rules need their networks; a large rule table is matched at the end instead
    open_rules = materialise(
        rules.where((F.col("source_address") == ANY) | (F.col("destination_address") == ANY)).select("rule_name"),
        "open_rules")
    if is_small(open_rules):
        sides = sides.join(F.broadcast(open_rules), "rule_name", "left_semi")
    traffic = _traffic_of_rules(sides, ports, group_ips, to_services)
    advised = rules.join(traffic, "rule_name", "left")
    narrowed = {
        name: F.when((F.col(name) == ANY) & (F.col(text) != ANY), F.col(text)) for name, (text, _) in seen.items()
    }
    sentences = [F.concat(F.lit(verb), narrowed[name]) for name, (_, verb) in seen.items()]
    sentences.append(F.when(F.col("risky_permissive") == "risky", F.lit(REVIEW_RISKY)))
    advice = F.array_compact(F.array(*sentences))
    changed = [F.coalesce(narrowed[c], F.col(c)).alias(c) if c in narrowed else F.col(c) for c in rules.columns]
    unused = F.col("log_count").isNull()
    return advised.select(
        "rule_name",
        F.struct(*rules.columns).alias("original_rule"),
        F.when(unused, REMOVE_UNUSED)
        .when(F.size(advice) > 0, F.array_join(advice, "; "))
        .otherwise(NOTHING_TO_DO)
        .alias("recommendation"),
        F.when(~unused & (F.size(advice) > 0), F.struct(*changed)).alias("optimized_rule"),
    )
