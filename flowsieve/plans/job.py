"""spark-submit job: analyse a flow log and write all outputs below one folder."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from flowsieve.plans.analyzer import FlowAnalyzer
from flowsieve.sources.scratch import scratch_scope


def run(
    spark: SparkSession, log_file: str, output_dir: str, rule_file: str | None = None, fmt: str = "csv",
    report_tables: bool = False,
) -> None:
    out = output_dir.rstrip("/")
    with scratch_scope(spark):
        analyzer = FlowAnalyzer.from_files(spark, log_file, rule_file, fmt)
        analyzer.write_chart_data(f"{out}/visualizations")
        analyzer.generate_report(f"{out}/analysis_report")
        analyzer.write_report_lists(f"{out}/report_lists")
        analyzer.generate_lean_rule_set().write.json(f"{out}/lean_rules")
        tables = analyzer.address_lists() | {"invalid_ips": analyzer.invalid_ips(), "invalid_values": analyzer.invalid_values()}
        if {"ts", "ingress_zone", "egress_zone"} <= set(analyzer.flows.columns):
            tables |= analyzer.analyze_times_and_zones()
        if analyzer.rules is not None:
            tables |= analyzer.analyze_rule_usage()
        for name, rows in tables.items():
            rows.write.parquet(f"{out}/{name}")
        if report_tables:
            analyzer.report_rows().write.parquet(f"{out}/report_rows")
        if "rule_name" in analyzer.flows.columns:
            analyzer.generate_optimized_rules().write.json(f"{out}/optimized_rules")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Analyse a flow log and propose access rules")
    parser.add_argument("--log-file", required=True, help="flow log with source, destination and port")
    parser.add_argument("--rule-file", help="rule table")
    parser.add_argument("--output-dir", default="output", help="folder for all outputs")
    parser.add_argument("--format", default="csv", choices=("csv", "parquet"), help="format of the inputs")
    parser.add_argument("--html-report", "--report-tables", dest="report_tables", action="store_true",
                        help="also write the tables of the report as rows")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("flowsieve").getOrCreate()
    run(spark, args.log_file, args.output_dir, args.rule_file, args.format, args.report_tables)


if __name__ == "__main__":
    main()
