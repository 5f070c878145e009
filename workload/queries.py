"""Every registered query: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowsieve.operators import addresses, containment, distinct, graph, labels, networks, report, rulesets, sketches, traffic, usage
from flowsieve.plans.sections import LogSections
from flowsieve.sources.parts import read_list_parts, write_list_parts
from flowsieve.sources.scratch import materialise, new_scratch_path
from flowsieve.sources.sinks import extract_minimal_fields, minimal_fields, write_back_hits, write_log, write_log_csv, write_log_table, write_rules
from flowsieve.sources.tables import invalid_values, load_logs, load_rules
from workload import views

Query = Callable[[SparkSession, str], DataFrame]


def _with_big_port(df: DataFrame) -> DataFrame:
    return df.withColumn("dst_port", F.col("dst_port").cast("bigint"))


def _minimal_fields_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    full, slim = new_scratch_path(spark, "full_log"), new_scratch_path(spark, "minimal_log")
    write_log_csv(views.dirty_flows(spark, sf_dir).drop("event_id"), full)
    extract_minimal_fields(spark, full, slim)
    return _with_big_port(load_logs(spark, slim))


def _log_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_scratch_path(spark, "parquet_log")
    write_log(views.dirty_flows(spark, sf_dir).drop("event_id"), path)
    return _with_big_port(load_logs(spark, path, "parquet").drop("ts"))


def _rejected_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reader leaves out of a log with odd ports and rows that have a field too many."""
    path = new_scratch_path(spark, "odd_log")
    odd = views.odd_log(spark, sf_dir)
    # whole lines, so that a comma in a rule name is not quoted and makes one more field
    line = F.concat_ws(",", *[F.col(f"`{c}`") for c in odd.columns])
    odd.select(line.alias(",".join(odd.columns))).write.csv(path, header=True, sep="\t")
    return invalid_values(spark, path)


def _hits_written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule table after two logs have been counted into it."""
    path = new_scratch_path(spark, "rule_table")
    write_rules(views.rules(spark, sf_dir), path)
    for _ in range(2):
        write_back_hits(spark, views.flows(spark, sf_dir), path, add=True)
    return load_rules(spark, path).select("rule_name", "hits", F.col("priority").cast("bigint").alias("priority"))


def _bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"bucketed_log_{uuid.uuid4().hex}"
    write_log_table(views.wide_flows(spark, sf_dir), name, 16, new_scratch_path(spark, name))
    return spark.table(name)


def _observed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What folding has skipped, as the job that folds has counted it."""
    seen = Observation()
    sides = networks.observe_rejects(networks.both_sides(views.dirty_flows(spark, sf_dir)), seen)
    materialise(networks.ip_networks(sides, "side"), "observed_networks")
    return spark.createDataFrame([seen.get], "rows bigint, missing bigint, not_ipv4 bigint")


def _merged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct counts by rule from the stored sets of three parts of the log."""
    flows = views.dirty_flows(spark, sf_dir)
    parts = [materialise(distinct.distinct_bitmaps(flows.where(F.col("event_id") % 3 == k), "rule_name"), "bitmaps") for k in range(3)]
    return distinct.count_bitmaps(distinct.merge_bitmaps(parts, "rule_name"), "rule_name")


def _sketched_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by rule from stored sketches, and whether their bounds hold the true distinct counts."""
    flows, path = views.wide_flows(spark, sf_dir), new_scratch_path(spark, "sketches")
    for k in range(2):
        stored = sketches.update_sketches(spark, path, flows.where(F.col("event_id") % 2 == k))
    exact = distinct.count_bitmaps(distinct.distinct_bitmaps(flows, "rule_name"), "rule_name").drop("rows")
    found = sketches.estimate_distinct(stored, "rule_name", deviations=4).join(exact, "rule_name")
    return found.select("rule_name", "rows", *[
        F.col(field).between(F.col(f"unique_{name}_low"), F.col(f"unique_{name}_high")).alias(f"{name}_within")
        for field, name in sketches.SKETCHES.items()])


def _log_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = LogSections(views.dirty_flows(spark, sf_dir)).counts().where("section <> 'after_hours'")
    keys = ["src_ip", "dst_ip", "dst_port", "rule_name", "hour", "day_of_week", "ingress_zone", "egress_zone"]
    return counts.select("section", *[F.col(k).cast("bigint").alias(k) if k in ("dst_port", "hour", "day_of_week") else k for k in keys], "flow_count")


def _list_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_scratch_path(spark, "list_parts")
    folded = networks.ip_networks(networks.both_sides(views.wide_flows(spark, sf_dir)), "side")
    write_list_parts(addresses.address_rows(folded, "side"), path, "side")
    return read_list_parts(spark, path, "side string")


def _rule_patterns(flows: DataFrame, rules: DataFrame) -> DataFrame:
    return usage.rule_patterns(flows, rules).withColumn("destination_ports", F.array_join("destination_ports", ","))


def _optimized_rules(flows: DataFrame, rules: DataFrame) -> DataFrame:
    fields = ("source_address", "destination_address", "service")
    return usage.generate_optimized_rules(flows, rules).select(
        "rule_name",
        "original_rule.priority",
        *[f"original_rule.{f}" for f in fields],
        "recommendation",
        *[F.col(f"optimized_rule.{f}").alias(f"optimized_{f}") for f in fields],
    )


def _networks(flows: DataFrame, ip: str) -> DataFrame:
    plen = F.col("plen").cast("bigint").alias("plen")
    return networks.ip_networks(flows, ip=ip).select("cidr", "lo", "hi", plen, "first_addr")


def _rules_only(rules: DataFrame) -> DataFrame:
    return rules.drop("rule_idx")


def queries() -> dict[str, Query]:
    def on(view: Callable, operator: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: operator(view(spark, sf_dir))

    def with_rules(view: Callable, operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: operator(view(spark, sf_dir), views.rules(spark, sf_dir))

    flows, wide, dirty = views.flows, views.wide_flows, views.dirty_flows
    out: dict[str, Query] = {
        "minimal_fields": on(flows, lambda f: _with_big_port(minimal_fields(f))),
        "minimal_fields_csv": _minimal_fields_csv,
        "flow_summary": on(dirty, lambda f: _with_big_port(traffic.summarise_flows(f))),
        "pair_counts": on(flows, traffic.pair_counts),
        "pair_counts_wide": on(wide, traffic.pair_counts),
        "low_occurrence_pairs": on(flows, traffic.low_occurrence_pairs),
        "graph_edges": on(flows, graph.graph_edges),
        "graph_nodes": on(flows, graph.graph_nodes),
        "invalid_ips": on(dirty, networks.invalid_ips),
        "rule_usage": with_rules(flows, lambda f, r: usage.rule_usage(f, r).select(
            "rule_name", "priority", "risky_permissive", "log_count")),
        "rule_hits": with_rules(flows, lambda f, r: usage.rule_hits(f, r).select("rule_name", "hits", "priority")),
        "unused_rules": with_rules(flows, usage.unused_rules),
        "permissive_rules": with_rules(flows, usage.permissive_rules),
        "rule_patterns": with_rules(dirty, _rule_patterns),
        "rule_pattern_values": with_rules(dirty, usage.rule_pattern_values),
        "port_services": on(dirty, usage.port_services),
        "traffic_by_hour": on(flows, lambda f: traffic.traffic_by_hour(f).withColumns(
            {c: F.col(c).cast("bigint") for c in ("hour", "day_of_week")})),
        "traffic_by_zone": on(flows, traffic.traffic_by_zone),
        "after_hours": on(flows, lambda f: _with_big_port(
            traffic.after_hours(f).select("event_id", "src_ip", "dst_ip", "dst_port"))),
        "report_rows": on(flows, report.report_rows),
        "report_json": on(flows, report.report_json),
    }
    for suffix, view in (("", flows), ("_dirty", dirty)):
        out["basic_stats" + suffix] = on(view, traffic.basic_stats)
        out["top_source_ips" + suffix] = on(view, traffic.top_source_ips)
        out["top_destination_ips" + suffix] = on(view, traffic.top_destination_ips)
        out["top_destination_ports" + suffix] = on(view, lambda f: _with_big_port(traffic.top_destination_ports(f)))
        out["top_pairs" + suffix] = on(view, traffic.top_pairs)
        out["unusual_ports" + suffix] = on(view, lambda f: _with_big_port(traffic.unusual_ports(f)))
        out["optimized_rules" + suffix] = with_rules(view, _optimized_rules)
        out["log_based_rules" + suffix] = on(view, usage.log_based_rules)
    for suffix, view in (("", flows), ("_wide", wide), ("_dirty", dirty)):
        out["ip_blocks" + suffix] = on(
            view, lambda f: networks.ip_blocks(networks.both_sides(f), "side").drop("addr"))
        out["src_networks" + suffix] = on(view, lambda f: _networks(f, "src_ip"))
        out["dst_networks" + suffix] = on(view, lambda f: _networks(f, "dst_ip"))
        out["networks_by_rule" + suffix] = on(
            view, lambda f: usage.networks_by_rule(f).select("rule_name", "side", "cidr", "first_addr"))
        out["ip_to_cidr" + suffix] = on(view, lambda f: labels.ip_to_cidr(networks.both_sides(f), "side"))
        out["single_rule" + suffix] = on(view, rulesets.aggregate_single_rule)
        out["cidr_pair_rules" + suffix] = on(view, lambda f: _rules_only(rulesets.generate_cidr_pair_rules(f)))
        out |= _capped(view, suffix)
    for pairs, suffix in ((rulesets.MAX_RULES, "_seven"), (rulesets.MAX_RULES + 1, "_eight")):
        out |= _capped(lambda spark, sf_dir, pairs=pairs: views.few_pairs(spark, sf_dir, pairs), suffix)
    for suffix, view in (("", flows), ("_wide", wide), ("_dirty", dirty)):
        out["single_rule_networks" + suffix] = on(view, lambda f: addresses.address_rows(
            networks.ip_networks(networks.both_sides(f), "side"), "side"))
        out["rule_networks" + suffix] = on(view, lambda f: addresses.address_rows(
            usage.networks_by_rule(f), ["rule_name", "side"]))
    for suffix, view in (("", flows), ("_wide", wide), ("_dirty", dirty)):
        out["ip_to_given_networks" + suffix] = _given(view, lambda f, n: containment.ip_to_given_networks(networks.both_sides(f), n, "side"))
        out["ip_to_longest_network" + suffix] = _given(view, lambda f, n: containment.ip_to_given_networks(
            networks.both_sides(f), n, "side", order=containment.BY_LENGTH))
        out["given_pair_rules" + suffix] = _given(view, lambda f, n: _rules_only(rulesets.generate_cidr_pair_rules(f, n, "ordinal")))
    out["rule_networks_listed"] = lambda spark, sf_dir: containment.rule_networks(views.rules(spark, sf_dir)).withColumn(
        "pos", F.col("pos").cast("bigint"))
    out |= {
        "log_parquet": _log_parquet, "rejected_values": _rejected_values, "hits_written_back": _hits_written_back,
        "observed_rejects": _observed_rejects, "merged_distinct_counts": _merged_counts, "sketched_counts": _sketched_counts,
        "log_sections": _log_sections, "list_parts": _list_parts,
        "bucketed_networks": lambda spark, sf_dir: networks.folded_sources(_bucketed(spark, sf_dir)).select(
            "cidr", "lo", "hi", F.col("plen").cast("bigint").alias("plen"), "first_addr"),
        "bucketed_labels": lambda spark, sf_dir: labels.labelled_sources(_bucketed(spark, sf_dir)),
    }
    out["networks_without_ipv4"] = on(views.host_flows, lambda f: usage.networks_by_rule(f).select("rule_name", "side", "cidr"))
    out["networks_all_host"] = on(dirty, lambda f: networks.ip_networks(
        usage.networks_by_rule_addresses(f), ["rule_name", "side"], on_invalid="all_host").select("rule_name", "side", "cidr"))
    return out


def _given(view: Callable, operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(view(spark, sf_dir), views.given_networks(spark, sf_dir))


def _capped(view: Callable, suffix: str) -> dict[str, Query]:
    def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rulesets.generate_cidr_pair_rules(view(spark, sf_dir))

    return {
        "lean_rules" + suffix: lambda spark, sf_dir: rulesets.generate_lean_rule_set(view(spark, sf_dir)).withColumn(
            "place", F.col("place").cast("bigint")),
        "capped_rules_literal" + suffix: lambda spark, sf_dir: rulesets.cap_rules_to_seven(rules(spark, sf_dir), compat=True).withColumn(
            "place", F.col("place").cast("bigint")),
        "catch_all_networks" + suffix: lambda spark, sf_dir: rulesets.catch_all_networks(rules(spark, sf_dir)).drop("lo"),
        "catch_all_labels" + suffix: lambda spark, sf_dir: rulesets.catch_all_labels(rules(spark, sf_dir)),
    }
