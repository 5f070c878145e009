"""Port sets and service labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ports with a service name. The same ports count as usual in the anomaly report.
PORT_SERVICES = {
    80: "http",
    443: "https",
    22: "ssh",
    3389: "rdp",
    21: "ftp",
    25: "smtp",
    53: "dns",
    123: "ntp",
    161: "snmp",
    3306: "mysql",
    1433: "mssql",
}
CUSTOM_PREFIX = "custom-ports-"
ANY = "any"


def is_named_port(port: Column) -> Column:
    return port.isin(*PORT_SERVICES)


def ports_to_services(ports: Column) -> Column:
    """Array of labels: the named ports in their order, then one label for all others."""
    names = F.create_map(*[F.lit(v) for pair in PORT_SERVICES.items() for v in pair])
    named = F.transform(F.filter(ports, is_named_port), lambda p: F.try_element_at(names, p))
    other = F.filter(ports, lambda p: ~is_named_port(p))
    custom = F.concat(F.lit(CUSTOM_PREFIX), F.array_join(other, "-"))
    return F.when(F.size(other) > 0, F.concat(named, F.array(custom))).otherwise(named)


def text_or_any(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(ANY))


def services_text(ports: Column) -> Column:
    return text_or_any(F.array_join(ports_to_services(ports), ", "))
