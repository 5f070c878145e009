"""Replacing a written table as a whole, also by a result that is read from it.

The new table is written beside the old one, and only a complete one takes its place, by two renames.
A job that dies before them leaves the old table as it was. One that dies between them leaves the
old table under its name for the way back, and the next read or write here puts it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_NEW, _OLD = ".flowsieve-new-", ".flowsieve-old"


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _beside(spark: SparkSession, target, suffix: str):
    """A hidden sibling, which Spark's readers pass over when they list the folder above."""
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target.getParent(), f"{suffix}-{target.getName()}")


def restore(spark: SparkSession, path: str) -> None:
    """Finish or undo a replacement that was broken off."""
    target, files = _file_system(spark, path)
    old = _beside(spark, target, _OLD)
    if files.exists(old):
        if files.exists(target):
            files.delete(old, True)
        elif not files.rename(old, target):
            raise OSError(f"{old} cannot be moved back to {target}")


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at `path`, or None if there is none."""
    restore(spark, path)
    target, files = _file_system(spark, path)
    return spark.read.parquet(path) if files.exists(target) else None


def replace_table(table: DataFrame, path: str, fmt: str = "parquet", **options: str | bool) -> None:
    """Write `table` and put it in the place of what is at `path`. One writer at a time."""
    spark = table.sparkSession
    restore(spark, path)
    target, files = _file_system(spark, path)
    new = _beside(spark, target, f"{_NEW}{uuid.uuid4().hex}")
    try:
        table.write.format(fmt).options(**options).save(new.toString())
        _swap(spark, files, new, target)
    finally:
        if files.exists(new):
            files.delete(new, True)


def _swap(spark: SparkSession, files, new, target) -> None:
    old = _beside(spark, target, _OLD)
    if files.exists(target) and not files.rename(target, old):
        raise OSError(f"{target} cannot be moved")
    if not files.rename(new, target):
        if files.exists(old):
            files.rename(old, target)
        raise OSError(f"{new} cannot be moved to {target}")
    if files.exists(old):
        files.delete(old, True)
    # cached listings of the old files are dropped
    spark.catalog.refreshByPath(target.toString())
