"""Readers for flow logs and rule tables. Columns are bound by header name, never by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.ip import is_ipv4
from flowsieve.schema import (
    LARGEST_PORT,
    LOG_COLUMNS,
    NULL_TEXTS,
    REQUIRED_LOG_COLUMNS,
    REQUIRED_RULE_COLUMNS,
    RULE_COLUMNS,
    require_columns,
)


# Column of the raw text of a CSV row whose number of fields is not the header's.
_CORRUPT = "_corrupt_record"
# Column of `load_logs(..., keep_rejected=True)`: what was not read of a row.
REJECTED = "rejected"
# In `rejected`, stands for the whole row.
ROW = "row"
_REJECTED_TYPE = "array<struct<column:string,text:string>>"


def _read(spark: SparkSession, path: str, fmt: str, multi_line: bool = False) -> DataFrame:
    """All columns as they are; of CSV as texts, and with a column for rows that do not fit the header."""
    if fmt == "csv":
        # enforceSchema=False makes Spark check every file's header, so that a file
        # with another column order fails instead of being read into the wrong columns.
        options = {"header": True, "escape": '"', "enforceSchema": False, "multiLine": multi_line}
        names = spark.read.csv(path, **options).columns
        kinds = ", ".join(f"`{name.replace('`', '``')}` string" for name in [*names, _CORRUPT])
        return spark.read.schema(kinds).csv(path, columnNameOfCorruptRecord=_CORRUPT, **options)
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported format {fmt!r}: use 'csv' or 'parquet'")


def _quotes(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))


def _lost_row(raw: DataFrame, misplaced: Column, multi_line: bool) -> Column:
    """The text of a CSV row that cannot be placed in the columns, else null.

    Such a row has more fields than the header, or is one end of a quoted line break: its quotes do
    not pair up, and where its number of fields happens to be right, it is `misplaced`. A row with
    fewer fields has nulls at its end and is no such row. A reader of multiple lines has no such ends.
    """
    names = [c for c in raw.columns if c != _CORRUPT]
    record = F.col(_CORRUPT)
    fields = F.from_csv(record, ", ".join(f"c{i} string" for i in range(len(names) + 1)), {"escape": '"', "multiLine": str(multi_line).lower()})
    lost = record.isNotNull() & fields[f"c{len(names)}"].isNotNull()
    joined = F.concat_ws(",", *[F.col(f"`{name}`") for name in names])
    if not multi_line:
        lost |= record.isNotNull() & (_quotes(record) % 2 == 1)
        lost |= record.isNull() & (_quotes(joined) % 2 == 1) & misplaced
    return F.when(lost, F.coalesce(record, joined))


def _text(name: str) -> Column:
    value = F.col(name).cast("string")
    return F.when(~value.isin(*NULL_TEXTS), value)


def _whole_number(value: Column, to: str) -> Column:
    """The number that a text states; one with a fraction other than zero is none."""
    # "443.0" is what a CSV holds once the column has been float for a while
    whole = F.regexp_extract(value, r"^\s*([+-]?\d+)(?:\.0*)?\s*$", 1)
    return whole.try_cast(to)


def _port(value: Column) -> Column:
    number = _whole_number(value, "int")
    return F.when(number.between(0, LARGEST_PORT), number)


def _utc_of(instant: Column) -> Column:
    """The UTC wall-clock time of an instant, whatever the session's zone."""
    seconds = F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    since = F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + since


def _utc(value: Column) -> Column:
    """A time with an offset is converted to UTC; one without is taken as UTC."""
    zoned = value.rlike(r"(Z|[+-]\d{2}:?\d{2})\s*$") & value.rlike(r"\d:\d")
    return F.when(zoned, _utc_of(value.try_cast("timestamp"))).otherwise(value.try_cast("timestamp_ntz"))


def _time(raw: DataFrame, name: str) -> Column:
    kind = raw.schema[name].dataType.typeName()
    if kind == "timestamp_ntz":
        return F.col(name)
    if kind == "timestamp":
        return _utc_of(F.col(name))
    return _utc(_text(name))


def load_logs(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False, keep_rejected: bool = False) -> DataFrame:
    """Read a minimal or full flow log; extra columns pass through unchanged.

    Times become UTC without a zone. Ports are whole numbers from 0 to LARGEST_PORT; any other
    text is null and still counts as a log row. CSV rows with more fields than the header are no
    flows. Nor is an end of a quoted line break, except one that has the addresses and the port; its
    broken field has what stands in that line. With `multi_line` such fields are read whole, and each
    file by one task. `invalid_values` lists what is left out. With `keep_rejected` these rows stay,
    all null, and a column `rejected` says for every row what was not read, null if nothing.
    """
    raw = _read(spark, path, fmt, multi_line)
    require_columns(raw, REQUIRED_LOG_COLUMNS, path)
    logs = raw.toDF(*[LOG_COLUMNS.get(c, c) for c in raw.columns])
    casts = {}
    for name in set(LOG_COLUMNS.values()) & set(logs.columns):
        if name == "dst_port":
            casts[name] = _port(_text(name))
        elif name == "ts":
            casts[name] = _time(logs, name)
        else:
            casts[name] = _text(name)
    columns = [c for c in logs.columns if c != _CORRUPT]
    lost = F.lit(None).cast("string")
    if _CORRUPT in raw.columns:
        not_a_flow = F.coalesce(~F.expr(is_ipv4("src_ip")), F.lit(True)) | F.coalesce(~F.expr(is_ipv4("dst_ip")), F.lit(True))
        lost = _lost_row(logs, not_a_flow | casts["dst_port"].isNull(), multi_line)
    if not keep_rejected:
        return logs.where(lost.isNull()).withColumns(casts).select(*[F.col(f"`{c}`") for c in columns])
    unread = [
        F.when(casts[name].isNull() & _text(name).isNotNull(), F.struct(F.lit(name).alias("column"), _text(name).alias("text")))
        for name in ("dst_port", "ts") if name in casts]
    texts = F.array_compact(F.array(*unread))
    row = F.array(F.struct(F.lit(ROW).alias("column"), F.col("lost_row").alias("text")))
    marked = logs.withColumn("lost_row", lost)
    rejected = F.when(F.col("lost_row").isNotNull(), row).when(F.size(texts) > 0, texts).cast(_REJECTED_TYPE).alias(REJECTED)
    return marked.select(*[F.when(F.col("lost_row").isNull(), casts.get(c, F.col(f"`{c}`"))).alias(c) for c in columns], rejected)


def list_rejected(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """(column, text, rows) of a log that was read with `keep_rejected`."""
    counted = F.sum(weight) if weight else F.count(F.lit(1))
    cells = rows.where(F.col(REJECTED).isNotNull()).select(F.explode(REJECTED).alias("cell"), *([weight] if weight else []))
    return cells.groupBy("cell.column", "cell.text").agg(counted.alias("rows"))


def invalid_values(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    """What the reader of a log leaves out, as (column, text, rows).

    Port and time texts that become null, and under the column 'row' whole rows that are no flows.
    """
    return list_rejected(load_logs(spark, path, fmt, multi_line, keep_rejected=True))


def load_rules(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    """Read a rule table and check that every row has its place and every rule name occurs once."""
    raw = _read(spark, path, fmt, multi_line)
    require_columns(raw, REQUIRED_RULE_COLUMNS, path)
    if _CORRUPT in raw.columns:
        priority = _whole_number(_text("priority"), "int")
        lost = raw.select(_lost_row(raw, priority.isNull(), multi_line).alias("text")).where("text IS NOT NULL").limit(5).collect()
        if lost:
            raise ValueError(f"Rows of {path} that do not fit its header: {[row.text for row in lost]}")
        raw = raw.drop(_CORRUPT)
    casts = {}
    for name, to in RULE_COLUMNS.items():
        if name not in raw.columns:
            continue
        if to == "string":
            casts[name] = _text(name)
        elif to == "date":
            casts[name] = _text(name).try_cast("date")
        else:
            casts[name] = _whole_number(_text(name), to)
    rules = raw.withColumns(casts)
    check_rule_names(rules)
    return rules


def check_rule_names(rules: DataFrame) -> None:
    """Raise ValueError when a rule name is repeated."""
    repeated = rules.groupBy("rule_name").count().where("count > 1").orderBy("rule_name").limit(5)
    names = [row.rule_name for row in repeated.collect()]
    if names:
        raise ValueError(f"Repeated rule_name in rule table: {names}")
