"""Column names and types of the flow log and the rule table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

# Header names of the flow log CSV and the names used inside the library.
LOG_COLUMNS = {
    "timestamp": "ts",
    "source.ip": "src_ip",
    "host.collector": "collector",
    "destination.port": "dst_port",
    "destination.ip": "dst_ip",
    "observer.egress.zone": "egress_zone",
    "observer.ingress.zone": "ingress_zone",
    "rule.name": "rule_name",
}
REQUIRED_LOG_COLUMNS = ("source.ip", "destination.ip", "destination.port")

# The rule table, in header order, with the type of each column.
RULE_COLUMNS = {
    "rule_name": "string",
    "hits": "bigint",
    "priority": "int",
    "description": "string",
    "recommended_action": "string",
    "source_zone": "string",
    "source_address": "string",
    "destination_zone": "string",
    "destination_address": "string",
    "application": "string",
    "service": "string",
    "url_category": "string",
    "action": "string",
    "profile_group": "string",
    "options": "string",
    "modified_date": "date",
    "created_date": "date",
    "risky_permissive": "string",
    "ingress_egress": "string",
}
REQUIRED_RULE_COLUMNS = (
    "rule_name",
    "description",
    "priority",
    "source_address",
    "destination_address",
    "service",
    "risky_permissive",
)

# Cell texts that mean "no value" in the CSV files.
NULL_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Fixed value: the largest port number.
LARGEST_PORT = 65_535

# Optional multiplicity of a flow row: present after `summarise_flows`, absent in a raw log.
FLOW_COUNT = "flow_count"


def require_columns(df: DataFrame, required: Iterable[str], what: str) -> None:
    """Raise ValueError naming the columns that `df` lacks; runs no job."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Missing columns in {what}: {missing}")


def key_list(keys: Sequence[str] | str) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)
