"""Long lists as ordered part files with a manifest, instead of one text.

A list is cut into records of CHUNK members. Records are range-partitioned by list and place, so the
part files in the order of their names, and the lines in each, give the list from its start, and no
task holds more than a partition's records. The manifest has a line per part file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.schema import key_list

CHUNK = 1000
# Records of one part file.
FILE_RECORDS = 2000
PARTS, MANIFEST = "parts", "manifest"


def write_list_parts(rows: DataFrame, path: str, keys: Sequence[str] | str = (), value: str = "cidr", position: str = "pos") -> None:
    """Write lists, given as rows (keys, position from 0, value), as JSON lines below `path`.

    `path`/parts has lines (keys, first, members), at most CHUNK members each. `path`/manifest has a line
    per part file in order: its name, the lists and positions of its first and last member, and
    how many members it has.
    """
    keys = key_list(keys)
    chunk = F.floor(F.col(position) / CHUNK)
    records = rows.groupBy(*keys, chunk.alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(position).alias("pos"), F.col(value).alias("value")))).alias("members"))
    lines = records.select(*keys, F.col("members")[0]["pos"].alias("first"), F.col("members.value").alias("members"))
    files = max(1, -(-rows.count() // (CHUNK * FILE_RECORDS)))
    by = [*keys, "first"]
    lines.repartitionByRange(files, *by).sortWithinPartitions(*by).write.json(f"{path}/{PARTS}")

    spark = rows.sparkSession
    written = spark.read.schema(lines.schema).json(f"{path}/{PARTS}").withColumn("file", F.col("_metadata.file_name"))
    last = F.col("first") + F.size("members") - 1
    manifest = written.groupBy("file").agg(
        F.min(F.struct(*keys, F.col("first").alias("pos"))).alias("begins"),
        F.max(F.struct(*keys, last.alias("pos"))).alias("ends"),
        F.count(F.lit(1)).alias("records"), F.sum(F.size("members")).alias("members"))
    # a line per part file
    manifest.coalesce(1).sortWithinPartitions("file").write.json(f"{path}/{MANIFEST}")


def read_list_parts(spark: SparkSession, path: str, keys: str = "") -> DataFrame:
    """The rows (keys, pos, value) of written lists; `keys` are their names and types, as in 'side string'."""
    names = [part.split()[0] for part in keys.split(",") if part.strip()]
    kind = ", ".join(part for part in (keys, "first bigint, members array<string>") if part)
    lines = spark.read.schema(kind).json(f"{path}/{PARTS}")
    return lines.select(*names, "first", F.posexplode("members").alias("at", "value")).select(
        *names, (F.col("first") + F.col("at")).alias("pos"), "value")
