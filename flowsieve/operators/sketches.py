"""Approximate distinct counts from stored sketches, which later logs are merged into.

A sketch table has one row per hour and rule, with a sketch of 2 ** LOG2_SIZE registers for each of
sources, destinations and ports, whatever the number of flows. A new log's sketches are united with
the stored ones; any coarser grouping, a day or all rules, unites rows once more. The log itself is
not read again, and flows that were counted before change no estimate.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.operators.counts import row_count
from flowsieve.schema import key_list
from flowsieve.sources.swap import read_or_none, replace_table

LOG2_SIZE = 12
# Standard deviation of an estimate, as a share of the true count: 1.04 / sqrt(registers).
RELATIVE_ERROR = 1.04 / 2 ** (LOG2_SIZE / 2)
SKETCHES = {"src_ip": "sources", "dst_ip": "destinations", "dst_port": "ports"}
HOUR, RULE = "hour_start", "rule_name"


def flow_sketches(flows: DataFrame) -> DataFrame:
    """(hour_start, rule_name, rows, sources, destinations, ports) of a log with times; nulls are not counted."""
    placed = flows.withColumn(HOUR, F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return placed.groupBy(HOUR, RULE).agg(
        row_count(flows).alias("rows"), *[F.hll_sketch_agg(field, LOG2_SIZE).alias(name) for field, name in SKETCHES.items()])


def merge_sketches(tables: Sequence[DataFrame], keys: Sequence[str] = (HOUR, RULE)) -> DataFrame:
    """Sketches of all tables together, by `keys`."""
    return reduce(DataFrame.unionByName, tables).groupBy(*key_list(keys)).agg(
        F.sum("rows").alias("rows"), *[F.hll_union_agg(name).alias(name) for name in SKETCHES.values()])


def estimate_distinct(sketches: DataFrame, keys: Sequence[str] = (), deviations: float = 3.0) -> DataFrame:
    """(keys, rows) and for each field its estimate with bounds: unique_<field>, ..._low, ..._high.

    The true count lies within the bounds with the probability of `deviations` standard deviations,
    0.997 for three.
    """
    keys = key_list(keys)
    united = sketches.groupBy(*keys).agg(
        F.coalesce(F.sum("rows"), F.lit(0).cast("bigint")).alias("rows"),
        *[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(name)), F.lit(0).cast("bigint")).alias(name) for name in SKETCHES.values()])
    slack = deviations * RELATIVE_ERROR
    columns = []
    for name in SKETCHES.values():
        columns += [
            F.col(name).alias(f"unique_{name}"), F.floor(F.col(name) / (1 + slack)).alias(f"unique_{name}_low"),
            F.ceil(F.col(name) / (1 - slack)).alias(f"unique_{name}_high")]
    return united.select(*keys, "rows", *columns)


def update_sketches(spark: SparkSession, path: str, flows: DataFrame) -> DataFrame:
    """Merge a log into the sketch table at `path`, which is made if there is none; returns the new table."""
    stored = read_or_none(spark, path)
    fresh = flow_sketches(flows)
    replace_table(fresh if stored is None else merge_sketches([stored, fresh]), path)
    return spark.read.parquet(path)
