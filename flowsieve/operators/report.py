"""The report: every section as rows, or as one JSON document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.operators.rulesets import aggregate_single_rule, generate_lean_rule_set
from flowsieve.operators.traffic import (
    basic_stats,
    low_occurrence_pairs,
    rare_pairs,
    summarise_flows,
    top_destination_ips,
    top_destination_ports,
    top_pairs,
    top_source_ips,
    unusual_ports,
)
from flowsieve.schema import FLOW_COUNT
from flowsieve.sources.scratch import materialise

STATS = ("total_log_entries", "unique_source_ips", "unique_destination_ips", "unique_destination_ports")
# Fixed value: unusual ports of the short preview.
PREVIEW = 5
FIELDS = ("name", "source_address", "destination_address", "service", "count")


def _summarised(flows: DataFrame) -> DataFrame:
    """Read the log once: the sections work on distinct flows with their counts."""
    if FLOW_COUNT in flows.columns:
        return flows
    return materialise(summarise_flows(flows.select("src_ip", "dst_ip", "dst_port")), "flow_summary")


def _section(rows: DataFrame, section: str, place: Column, **fields: Column) -> DataFrame:
    absent = F.lit(None).cast("string")
    return rows.select(
        F.lit(section).alias("section"),
        place.cast("bigint").alias("place"),
        *[fields.get(f, absent).cast("bigint" if f == "count" else "string").alias(f) for f in FIELDS],
    )


def _ranked(top: DataFrame, section: str, key: str) -> DataFrame:
    # a top list has ten rows at most
    place = F.row_number().over(Window.orderBy(F.desc("count"), key))
    return _section(top, section, place, name=F.col(key), count=F.col("count"))


def _stats_rows(flows: DataFrame) -> DataFrame:
    stats = basic_stats(flows)
    pairs = [part for i, c in enumerate(STATS) for part in (F.lit(i + 1), F.lit(c), F.col(c))]
    rows = stats.select(F.stack(F.lit(len(STATS)), *pairs).alias("place", "name", "count"))
    return _section(rows, "basic_stats", F.col("place"), name=F.col("name"), count=F.col("count"))


def _base_sections(flows: DataFrame, single: DataFrame | None = None) -> DataFrame:
    pairs = low_occurrence_pairs(flows)
    in_text_order = F.row_number().over(Window.orderBy("src_ip", "dst_ip"))
    single = aggregate_single_rule(flows) if single is None else single
    sections = [
        _stats_rows(flows),
        _ranked(top_source_ips(flows), "top_source_ips", "src_ip"),
        _ranked(top_destination_ips(flows), "top_destination_ips", "dst_ip"),
        _ranked(top_destination_ports(flows), "top_destination_ports", "dst_port"),
        _ranked(top_pairs(flows), "top_source_dest_pairs", "src_dst_pair"),
        _ranked(unusual_ports(flows), "unusual_ports", "dst_port"),
        _section(pairs, "low_occurrence_pairs", in_text_order, source_address=F.col("src_ip"),
                 destination_address=F.col("dst_ip"), count=F.col("count")),
        _section(single, "optimized_single_rule", F.lit(1), source_address=F.col("source_address"),
                 destination_address=F.col("destination_address"), service=F.col("service"),
                 count=F.col("log_count")),
    ]
    rows = sections[0]
    for section in sections[1:]:
        rows = rows.unionByName(section)
    return rows


def report_rows(flows: DataFrame) -> DataFrame:
    """All report tables as rows: section, place and the fields that the section has.

    `low_occurrence_total` is the number of all rare pairs, of which the report lists ten at most;
    `low_occurrence_listed` is how many it lists. `unusual_ports_preview` has the first PREVIEW of
    the unusual ports.
    """
    flows = _summarised(flows)
    total = rare_pairs(flows).agg(F.count("*").alias("count"))
    listed = low_occurrence_pairs(flows).agg(F.count("*").alias("count"))
    lean = generate_lean_rule_set(flows)
    return (
        _base_sections(flows)
        .unionByName(_section(total, "low_occurrence_total", F.lit(1), count=F.col("count")))
        .unionByName(_section(listed, "low_occurrence_listed", F.lit(1), count=F.col("count")))
        .unionByName(_ranked(unusual_ports(flows, PREVIEW), "unusual_ports_preview", "dst_port"))
        .unionByName(_section(
            lean, "lean_rules", F.col("place"), name=F.col("rule_name"), source_address=F.col("source_address"),
            destination_address=F.col("destination_address"), service=F.col("service"), count=F.col("log_count")))
    )


def report_json(flows: DataFrame, single: DataFrame | None = None) -> DataFrame:
    """The report as one JSON text; anomaly sections without rows are left out.

    `single` is the rule that it shows, by default `aggregate_single_rule` of the flows.
    """

    def rows(section: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("section") == section, F.struct("place", *FIELDS))))

    # each section has ten rows at most
    lists = _base_sections(_summarised(flows), single).groupBy().agg(*[
        rows(s).alias(s) for s in (
            "basic_stats", "top_source_ips", "top_destination_ips", "top_destination_ports",
            "top_source_dest_pairs", "unusual_ports", "low_occurrence_pairs", "optimized_single_rule")])

    def counts(section: str) -> Column:
        return F.map_from_entries(F.transform(section, lambda r: F.struct(r["name"], r["count"])))

    def filled(section: str, value: Column) -> Column:
        return F.when(F.size(section) > 0, value).alias(section)

    pairs = F.transform("low_occurrence_pairs", lambda r: F.struct(
        r["source_address"].alias("source.ip"), r["destination_address"].alias("destination.ip"),
        r["count"].alias("count")))
    rule = F.col("optimized_single_rule")[0]
    patterns = ("top_source_ips", "top_destination_ips", "top_destination_ports", "top_source_dest_pairs")
    document = F.struct(
        F.struct(*[F.col("basic_stats")[i]["count"].alias(c) for i, c in enumerate(STATS)]).alias("basic_stats"),
        F.struct(*[counts(s).alias(s) for s in patterns]).alias("traffic_patterns"),
        F.struct(filled("unusual_ports", counts("unusual_ports")),
                 filled("low_occurrence_pairs", pairs)).alias("anomalies"),
        F.struct(rule["source_address"].alias("source_address"),
                 rule["destination_address"].alias("destination_address"),
                 rule["service"].alias("service"),
                 rule["count"].alias("log_count")).alias("optimized_single_rule"),
    )
    return lists.select(F.to_json(document, {"timestampFormat": "yyyy-MM-dd HH:mm:ss"}).alias("report"))
