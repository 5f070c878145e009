"""The analyzer: one object per log, one method per analysis."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowsieve.operators import addresses, graph, networks, report, rulesets, traffic, usage
from flowsieve.operators.containment import BY_NETWORK, ip_to_given_networks
from flowsieve.plans.sections import LogSections
from flowsieve.schema import FLOW_COUNT, require_columns
from flowsieve.sources.parts import write_list_parts
from flowsieve.sources.scratch import materialise
from flowsieve.sources.sinks import write_json_report
from flowsieve.sources.tables import REJECTED, ROW, check_rule_names, list_rejected, load_logs, load_rules


# Networks of a side that the report states in its text.
INLINE_NETWORKS = 100_000


class FlowAnalyzer:
    """Analyses of one flow log and, optionally, its rule table.

    The log is read once, on first use: `sections` keeps its counts by several sets of columns as a
    table in spark.checkpoint.dir, and every method starts from those. Only `flows` itself is the
    log, for callers that want its rows.
    """

    def __init__(self, flows: DataFrame, rules: DataFrame | None = None):
        require_columns(flows, ("src_ip", "dst_ip", "dst_port"), "flows")
        if rules is not None:
            require_columns(flows, ("rule_name",), "flows, which a rule table is compared with")
            check_rule_names(rules)
        self.sections = LogSections(flows)
        self.flows = flows
        if REJECTED in flows.columns:
            self.flows = flows.where(~F.coalesce(F.exists(REJECTED, lambda r: r["column"] == ROW), F.lit(False))).drop(REJECTED)
        self.rules = rules

    @classmethod
    def from_files(
        cls, spark: SparkSession, log_path: str, rule_path: str | None = None, fmt: str = "csv", multi_line: bool = False
    ) -> FlowAnalyzer:
        # load_rules has checked the names
        rules = load_rules(spark, rule_path, fmt, multi_line) if rule_path else None
        return cls(load_logs(spark, log_path, fmt, multi_line, keep_rejected=True), rules)

    @cached_property
    def summary(self) -> DataFrame:
        """One row per distinct source, destination, port and rule, as `summarise_flows` gives it."""
        return self.sections.of("flow" if "flow" in self.sections.sections else "plain_flow")

    @cached_property
    def _networks(self) -> tuple[DataFrame, Observation]:
        """The networks of both sides, and what the job that folded them saw."""
        seen = Observation("folded_addresses")
        sides = self.sections.of("source").select(F.lit(networks.SOURCE).alias("side"), F.col("src_ip").alias("ip"), FLOW_COUNT).unionByName(
            self.sections.of("destination").select(F.lit(networks.DESTINATION).alias("side"), F.col("dst_ip").alias("ip"), FLOW_COUNT))
        return materialise(networks.ip_networks(networks.observe_rejects(sides, seen), "side"), "networks"), seen

    def rejects(self) -> dict[str, int]:
        """Log rows, of both sides together, whose addresses folding has skipped: rows, missing, not_ipv4.

        The counts come from the job that folds the addresses, see `networks.invalid_ips` for the texts.
        """
        return dict(self._networks[1].get)

    def invalid_values(self) -> DataFrame:
        """What the reader left out, see `tables.invalid_values`; needs a log from `from_files`."""
        return list_rejected(self.sections.of("rejected"), FLOW_COUNT)

    def invalid_ips(self) -> DataFrame:
        return networks.invalid_ips(self.sections.of("pair"))

    def get_basic_stats(self) -> DataFrame:
        return traffic.basic_stats(self.sections.of("plain_flow"))

    def analyze_traffic_patterns(self) -> dict[str, DataFrame]:
        return {
            "top_source_ips": traffic.top_source_ips(self.sections.of("source")),
            "top_destination_ips": traffic.top_destination_ips(self.sections.of("destination")),
            "top_destination_ports": traffic.top_destination_ports(self.sections.of("port")),
            "top_source_dest_pairs": traffic.top_pairs(self.sections.of("pair")),
        }

    def identify_anomalies(self) -> dict[str, DataFrame]:
        return {
            "unusual_ports": traffic.unusual_ports(self.sections.of("port")),
            "low_occurrence_pairs": traffic.low_occurrence_pairs(self.sections.of("pair")),
        }

    def analyze_times_and_zones(self) -> dict[str, DataFrame]:
        """Needs the time and zone columns of the full log."""
        require_columns(self.flows, ("ts", "ingress_zone", "egress_zone"), "flows")
        return {
            "traffic_by_hour": traffic.traffic_by_hour(self.sections.of("hour")),
            "traffic_by_zone": traffic.traffic_by_zone(self.sections.of("zones")),
            "after_hours": self.sections.after_hours(),
        }

    def optimize_single_rule(self) -> DataFrame:
        return rulesets.single_rule_of(self._networks[0], self.sections.of("port"))

    def generate_cidr_pair_rules(self, given: DataFrame | None = None, order: str = BY_NETWORK) -> DataFrame:
        """`given` are networks of the caller's own, see `rulesets.label_flows`."""
        return rulesets.generate_cidr_pair_rules(self.sections.of("plain_flow"), given, order)

    def generate_lean_rule_set(self, given: DataFrame | None = None, order: str = BY_NETWORK) -> DataFrame:
        return rulesets.generate_lean_rule_set(self.sections.of("plain_flow"), given, order)

    def label_addresses(self, given: DataFrame, order: str = BY_NETWORK) -> DataFrame:
        """Every address of the log with its first containing network among the caller's: (side, ip, cidr, given)."""
        return ip_to_given_networks(networks.both_sides(self.sections.of("pair")), given, "side", order=order)

    def address_lists(self) -> dict[str, DataFrame]:
        """The address lists behind the rule texts, as rows of any number."""
        lists = {"single_rule_networks": addresses.address_rows(self._networks[0], "side")}
        if "rule_name" in self.flows.columns:
            lists["rule_networks"] = addresses.address_rows(usage.networks_by_rule(self.summary), ["rule_name", "side"])
        return lists

    def analyze_rule_usage(self) -> dict[str, DataFrame]:
        if self.rules is None:
            raise ValueError("analyze_rule_usage needs a rule table")
        return {
            "unused_rules": usage.unused_rules(self.summary, self.rules),
            "permissive_rules": usage.permissive_rules(self.summary, self.rules),
            "rule_patterns": usage.rule_patterns(self.summary, self.rules),
            "rule_pattern_values": usage.rule_pattern_values(self.summary, self.rules),
        }

    def generate_optimized_rules(self) -> DataFrame:
        """One schema with and without a rule table; without one original_rule is null."""
        require_columns(self.flows, ("rule_name",), "flows")
        return usage.generate_optimized_rules(self.summary, self.rules)

    def chart_data(self) -> dict[str, DataFrame]:
        """The rows behind the three bar charts and the network graph."""
        return {
            **{name: rows for name, rows in self.analyze_traffic_patterns().items() if name != "top_source_dest_pairs"},
            "graph_edges": graph.graph_edges(self.sections.of("pair")),
            "graph_nodes": graph.graph_nodes(self.sections.of("pair")),
        }

    def write_chart_data(self, folder: str, fmt: str = "parquet") -> dict[str, str]:
        paths = {}
        for name, rows in self.chart_data().items():
            paths[name] = f"{folder.rstrip('/')}/{name}"
            rows.write.save(paths[name], format=fmt)
        return paths

    def report_rows(self) -> DataFrame:
        return report.report_rows(self.sections.of("plain_flow"))

    def generate_report(self, path: str | None = None, inline: int = INLINE_NETWORKS) -> DataFrame:
        """The JSON report as a one-row DataFrame, also written to `path` if given.

        The rule's addresses stand in the report up to `inline` networks a side. `write_report_lists`
        writes them whatever their number.
        """
        single = rulesets.single_rule_of(self._networks[0], self.sections.of("port"), inline)
        document = report.report_json(self.sections.of("plain_flow"), single)
        if path:
            write_json_report(document, path)
        return document

    def write_report_lists(self, folder: str) -> None:
        """The address lists of the single rule, and of every rule in the log, as ordered part files with manifests."""
        for name, rows in self.address_lists().items():
            write_list_parts(rows, f"{folder.rstrip('/')}/{name}", [c for c in rows.columns if c not in ("pos", "cidr")])
