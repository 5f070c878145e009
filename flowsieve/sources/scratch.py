"""Intermediate tables kept in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# folders that this process has named, in order
_named: list[str] = []
_CHECKPOINT_DIR = "spark.checkpoint.dir"


def scratch_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local session that has none gets a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get(_CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError(f"Set {_CHECKPOINT_DIR} to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="flowsieve-"))
    return context.getCheckpointDir()


def new_scratch_path(spark: SparkSession, name: str) -> str:
    folder = f"{scratch_folder(spark).rstrip('/')}/flowsieve-{uuid.uuid4().hex}"
    _named.append(folder)
    return f"{folder}/{name}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables that are written inside, also after a failure.

    Results that still read such a table must be written before the scope ends. Only folders that
    were named inside are removed, so scopes must not run beside each other in one process.
    """
    start = len(_named)
    try:
        yield
    finally:
        for folder in _named[start:]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        del _named[start:]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and read it back: later plans start from the table, not from the log."""
    spark = df.sparkSession
    path = new_scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
