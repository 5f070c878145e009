"""Counts, top talkers and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.services import is_named_port
from flowsieve.operators import distinct
from flowsieve.operators.counts import row_count
from flowsieve.schema import FLOW_COUNT

TOP = 10
# Fixed value: a pair seen fewer times than this is rare.
RARE_BELOW = 5


def summarise_flows(flows: DataFrame) -> DataFrame:
    """One row per distinct (source, destination, port[, rule]) with its number of log rows.

    All operators but the time and zone ones give the same result on the summary as on the log.
    """
    keys = [c for c in ("src_ip", "dst_ip", "dst_port", "rule_name") if c in flows.columns]
    return flows.groupBy(*keys).agg(row_count(flows).alias(FLOW_COUNT))


def basic_stats(flows: DataFrame) -> DataFrame:
    """Log rows and exact distinct counts, from one set of bitmaps per field."""
    return stats_of_bitmaps(distinct.distinct_bitmaps(flows), unique=True)


def stats_of_bitmaps(bitmaps: DataFrame, unique: bool = False) -> DataFrame:
    """`basic_stats` of stored bitmaps, of any keys; `unique` as in `count_bitmaps`."""
    return distinct.count_bitmaps(bitmaps, unique=unique).select(
        F.col("rows").alias("total_log_entries"), F.col("src_ip").alias("unique_source_ips"),
        F.col("dst_ip").alias("unique_destination_ips"), F.col("dst_port").alias("unique_destination_ports"))


def value_counts(flows: DataFrame, *columns: str) -> DataFrame:
    """Frequency of each combination of non-null values."""
    return flows.dropna(subset=list(columns)).groupBy(*columns).agg(row_count(flows).alias("count"))


def _top(counts: DataFrame, *keys: str, n: int = TOP) -> DataFrame:
    return counts.orderBy(F.desc("count"), *keys).limit(n)


def top_source_ips(flows: DataFrame, n: int = TOP) -> DataFrame:
    return _top(value_counts(flows, "src_ip"), "src_ip", n=n)


def top_destination_ips(flows: DataFrame, n: int = TOP) -> DataFrame:
    return _top(value_counts(flows, "dst_ip"), "dst_ip", n=n)


def top_destination_ports(flows: DataFrame, n: int = TOP) -> DataFrame:
    return _top(value_counts(flows, "dst_port"), "dst_port", n=n)


def pair_counts(flows: DataFrame) -> DataFrame:
    return value_counts(flows, "src_ip", "dst_ip")


def top_pairs(flows: DataFrame, n: int = TOP) -> DataFrame:
    label = F.concat("src_ip", F.lit(" -> "), "dst_ip")
    counts = pair_counts(flows).select(label.alias("src_dst_pair"), "count")
    return _top(counts, "src_dst_pair", n=n)


def unusual_ports(flows: DataFrame, n: int = TOP) -> DataFrame:
    """Busiest ports outside the named ones."""
    return top_destination_ports(flows.where(~is_named_port(F.col("dst_port"))), n)


def rare_pairs(flows: DataFrame) -> DataFrame:
    return pair_counts(flows).where(F.col("count") < RARE_BELOW)


def low_occurrence_pairs(flows: DataFrame, n: int = TOP) -> DataFrame:
    """First rare pairs in text order of source and destination."""
    return rare_pairs(flows).orderBy("src_ip", "dst_ip").limit(n)


def traffic_by_hour(flows: DataFrame) -> DataFrame:
    """Rows by hour of day and day of week (1 = Sunday), in UTC."""
    if "ts" in flows.columns:
        flows = flows.withColumns({"hour": F.hour("ts"), "day_of_week": F.dayofweek("ts")})
    return flows.groupBy("hour", "day_of_week").agg(row_count(flows).alias("count"))


def traffic_by_zone(flows: DataFrame) -> DataFrame:
    return flows.groupBy("ingress_zone", "egress_zone").agg(row_count(flows).alias("count"))


def after_hours(flows: DataFrame, opens: int = 8, closes: int = 18) -> DataFrame:
    """Flows at weekends or outside [opens, closes) in UTC."""
    return flows.where(is_after_hours(opens, closes))


def is_after_hours(opens: int = 8, closes: int = 18) -> Column:
    hour, day = F.hour("ts"), F.dayofweek("ts")
    return (hour < opens) | (hour >= closes) | day.isin(1, 7)
