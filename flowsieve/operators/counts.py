"""Counting log rows, of a log or of its summary, by one set of columns or by several in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.schema import FLOW_COUNT


def row_count(flows: DataFrame) -> Column:
    """Aggregate that counts log rows, whether or not `flows` is a summary."""
    if FLOW_COUNT in flows.columns:
        return F.coalesce(F.sum(FLOW_COUNT), F.lit(0).cast("bigint"))
    return F.count(F.lit(1))


def grouped_counts(flows: DataFrame, sets: Mapping[str, Sequence[str]], within: Sequence[str] = ()) -> DataFrame:
    """Log rows by each of several sets of columns: (section, within, all columns, flow_count).

    One scan: rows are combined in the tasks for every set before they are shuffled. `section` is the
    name of the set; columns that are not in it are null. `within` are columns of every set.
    """
    keys = list(dict.fromkeys(c for columns in sets.values() for c in columns))
    # the grouping id has one bit for each column that is not in the set, the first column's highest
    marks = {name: sum(1 << (len(keys) - 1 - i) for i, key in enumerate(keys) if key not in columns) for name, columns in sets.items()}
    names = F.create_map(*[part for name, mark in marks.items() for part in (F.lit(mark).cast("bigint"), F.lit(name))])
    counted = flows.groupingSets([[*within, *columns] for columns in sets.values()], *within, *keys).agg(
        F.grouping_id().cast("bigint").alias("mark"), row_count(flows).alias(FLOW_COUNT))
    return counted.select(F.try_element_at(names, "mark").alias("section"), *within, *keys, FLOW_COUNT)
