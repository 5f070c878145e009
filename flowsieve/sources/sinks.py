"""Writers. Every sink is a Spark write: a folder of part files, one per task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.ip import address_block, ip_to_long
from flowsieve.operators.usage import rule_hits
from flowsieve.schema import LOG_COLUMNS
from flowsieve.sources.swap import replace_table, restore
from flowsieve.sources.tables import load_logs, load_rules

# Buckets of a log table. More of them for larger logs: a bucket is read by one task.
BUCKETS = 64
SOURCE_BLOCK, DAY = "src_block", "day"


def minimal_fields(flows: DataFrame) -> DataFrame:
    return flows.select("src_ip", "dst_ip", "dst_port")


def write_log_csv(flows: DataFrame, path: str) -> None:
    """Write flows as CSV under the header names of the log format, without an index column."""
    header = {name: head for head, name in LOG_COLUMNS.items()}
    if "ts" in flows.columns:
        flows = flows.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    named = flows.toDF(*[header.get(c, c) for c in flows.columns])
    named.write.csv(path, header=True, escape='"', mode="errorifexists")


def write_log(flows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write flows for `load_logs`: Parquet unless CSV is asked for, under the header names of the log format."""
    if fmt == "csv":
        write_log_csv(flows, path)
    elif fmt == "parquet":
        header = {name: head for head, name in LOG_COLUMNS.items()}
        flows.toDF(*[header.get(c, c) for c in flows.columns]).write.parquet(path)
    else:
        raise ValueError(f"Unsupported format {fmt!r}: use 'csv' or 'parquet'")


def write_log_table(flows: DataFrame, table: str, buckets: int = BUCKETS, path: str | None = None) -> None:
    """Save flows as a table that is laid out for folding source addresses.

    Rows are bucketed by the /16 block of the source and sorted by it, and partitioned by day if they
    have times. `networks.folded_sources` folds such a table without a shuffle of its addresses. The
    files are below `path`, or in the warehouse.
    """
    placed = flows.selectExpr("*", f"{ip_to_long('src_ip')} AS src_addr").selectExpr(
        "*", f"coalesce({address_block('src_ip', 'src_addr')}, -1L) AS {SOURCE_BLOCK}").drop("src_addr")
    # each bucket's rows meet in one task, so a bucket is one file per day
    writer = placed.repartition(buckets, SOURCE_BLOCK)
    if "ts" in flows.columns:
        writer = writer.withColumn(DAY, F.to_date("ts")).write.partitionBy(DAY)
    else:
        writer = writer.write
    writer = writer.option("path", path) if path else writer
    writer.bucketBy(buckets, SOURCE_BLOCK).sortBy(SOURCE_BLOCK, "src_ip").format("parquet").saveAsTable(table)


def extract_minimal_fields(spark: SparkSession, input_path: str, output_path: str, fmt: str = "csv") -> None:
    """Slim a full log CSV to source address, destination address and destination port."""
    write_log(minimal_fields(load_logs(spark, input_path)), output_path, fmt)


def write_rules(rules: DataFrame, path: str, fmt: str = "csv") -> None:
    """Put a rule table in the place of the one at `path`, which it may have been read from."""
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"Unsupported format {fmt!r}: use 'csv' or 'parquet'")
    options = {"header": True, "escape": '"', "dateFormat": "yyyy-MM-dd"} if fmt == "csv" else {}
    replace_table(rules, path, fmt, **options)


def write_back_hits(
    spark: SparkSession, flows: DataFrame, rule_path: str, output_path: str | None = None, fmt: str = "csv", add: bool = False
) -> None:
    """Write the rule table back with `hits` counted in this log, or with `add` on top of the earlier ones.

    The rows keep their order. Without `output_path` the table at `rule_path` is replaced, as a whole
    or not at all; a single file becomes a folder of part files.
    """
    restore(spark, rule_path)
    rules = load_rules(spark, rule_path, fmt)
    place = "row_place"
    # an order of rows that files give, not a number that anyone sees
    counted = rule_hits(flows, rules.withColumn(place, F.monotonically_increasing_id()), add)
    write_rules(counted.orderBy(place).drop(place), output_path or rule_path, fmt)


def write_json_report(report: DataFrame, path: str) -> None:
    """Write the one-row report of `report_json` as JSON text."""
    report.select("report").write.text(path)
