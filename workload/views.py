"""Flow logs and a rule table derived from the `events` and `region` tables.

The expressions are plain SQL that Spark and DuckDB both read, so that a query and its SQL check
start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SRC = """CASE WHEN user_id % 11 = 0 THEN 2886729728 + (user_id * 3) % 9000
       ELSE 3232235777 + (user_id * 37) % 1300 END"""
_DST = "167837440 + ((event_id * event_id) % 23) * 97"
_PORT = """CASE CAST(event_id % 10 AS INT) WHEN 0 THEN 443 WHEN 1 THEN 443 WHEN 2 THEN 80 WHEN 3 THEN 22
       WHEN 4 THEN 53 WHEN 5 THEN 23 WHEN 6 THEN 8080 WHEN 7 THEN 8443 WHEN 8 THEN 3306 ELSE 3389 END"""
# Addresses that spread over many /16 blocks and cross their borders; three of four rows come from one source block.
_WIDE_SRC = """CASE WHEN event_id % 4 < 3 THEN 184483840 + (user_id * 101 + event_id * 7) % 140000
       ELSE (event_id * 1103515245 + 12345) % 4026531840 END"""
_WIDE_DST = "3405803520 + (event_id * event_id * 13 + user_id * 211) % 400000"


def _zone(shift: int) -> str:
    return f"""CASE CAST((event_id + {shift}) % 5 AS INT) WHEN 0 THEN 'internal' WHEN 1 THEN 'external' WHEN 2 THEN 'dmz'
       WHEN 3 THEN 'database' ELSE 'application' END"""


def _dotted(number: str) -> str:
    octets = ", ".join(f"CAST(({number} >> {s}) & 255 AS VARCHAR(3))" for s in (24, 16, 8, 0))
    return f"concat_ws('.', {octets})"


def _log(src: str, dst: str) -> str:
    return f"""SELECT event_id, ts, {_dotted('src')} AS src_ip, 'collector-' || CAST(event_id % 3 AS VARCHAR(3)) AS collector,
       port AS dst_port, {_dotted('dst')} AS dst_ip, egress_zone, ingress_zone, rule_name
  FROM (SELECT event_id, ts, event_type AS rule_name, {src} AS src, {dst} AS dst, {_PORT} AS port,
               {_zone(0)} AS egress_zone, {_zone(2)} AS ingress_zone FROM events) AS numbered"""


FLOWS = _log(_SRC, _DST)
WIDE_FLOWS = _log(_WIDE_SRC, _WIDE_DST)
# The first log with missing and malformed values in it.
DIRTY_FLOWS = f"""SELECT event_id, ts,
       CASE CAST(event_id % 101 AS INT) WHEN 7 THEN NULL
            WHEN 13 THEN '300.1.1.' || CAST(event_id % 7 AS VARCHAR(3))
            WHEN 29 THEN '2001:db8::' || CAST(event_id % 13 AS VARCHAR(3))
            WHEN 31 THEN '01.2.3.' || CAST(event_id % 5 AS VARCHAR(3)) ELSE src_ip END AS src_ip,
       collector,
       CASE WHEN event_id % 50 = 3 THEN NULL ELSE dst_port END AS dst_port,
       CASE CAST(event_id % 97 AS INT) WHEN 11 THEN NULL WHEN 12 THEN 'host-' || CAST(event_id % 4 AS VARCHAR(3))
            ELSE dst_ip END AS dst_ip,
       egress_zone, ingress_zone,
       CASE WHEN event_id % 89 = 5 THEN NULL ELSE rule_name END AS rule_name
  FROM ({FLOWS}) AS clean"""

# A log without any IPv4 address at one side of some rules.
HOST_FLOWS = f"""SELECT event_id, ts, 'host-' || CAST(event_id % 40 AS VARCHAR(3)) AS src_ip, collector, dst_port,
       CASE WHEN rule_name = 'click' AND event_id % 3 = 0 THEN 'db-' || CAST(event_id % 9 AS VARCHAR(3)) ELSE dst_ip END AS dst_ip,
       egress_zone, ingress_zone, rule_name FROM ({FLOWS}) AS clean"""

# Networks of many lengths, from one that holds every address to single ones, nested and repeated; the order is the caller's.
_PREFIX = """CASE CAST(event_id % 11 AS INT) WHEN 0 THEN 8 WHEN 1 THEN 12 WHEN 2 THEN 15 WHEN 3 THEN 16 WHEN 4 THEN 17 WHEN 5 THEN 20
       WHEN 6 THEN 24 WHEN 7 THEN 26 WHEN 8 THEN 30 WHEN 9 THEN 32 ELSE CASE WHEN event_id < 600 THEN 1 ELSE 22 END END"""
GIVEN_NETWORKS = f"""SELECT {_dotted('net')} || '/' || CAST(plen AS VARCHAR(2)) AS cidr, side, max(event_id) AS ordinal
  FROM (SELECT event_id, plen, side, (addr >> (32 - plen)) << (32 - plen) AS net
          FROM (SELECT event_id, {_PREFIX} AS plen, CASE WHEN event_id % 2 = 0 THEN 'source' ELSE 'destination' END AS side,
                       CASE WHEN event_id % 3 = 0 THEN {_SRC} WHEN event_id % 2 = 0 THEN {_WIDE_SRC}
                            WHEN event_id % 3 = 1 THEN {_DST} ELSE {_WIDE_DST} END AS addr
                  FROM events WHERE event_id % 7 < 3) AS drawn) AS cut GROUP BY net, plen, side"""

# A minimal log as texts: ports that are none, and rule names with a comma that nothing quotes.
ODD_LOG = f"""SELECT src_ip AS "source.ip", dst_ip AS "destination.ip",
       CASE WHEN event_id % 37 = 0 THEN '70000' WHEN event_id % 53 = 0 THEN 'ssh' ELSE CAST(dst_port AS VARCHAR(5)) END AS "destination.port",
       CASE WHEN event_id % 41 = 0 THEN rule_name || ',' || CAST(event_id % 5 AS VARCHAR(3)) ELSE rule_name END AS "rule.name"
  FROM ({FLOWS}) AS clean"""


def few_pairs_log(pairs: int) -> str:
    return f"""SELECT event_id, ts, '10.0.0.1' AS src_ip, collector, dst_port,
       '172.' || CAST(16 + event_id % {pairs} AS VARCHAR(3)) || '.0.1' AS dst_ip, egress_zone, ingress_zone, rule_name
  FROM ({FLOWS}) AS clean"""


RULES = """SELECT name AS rule_name, CAST(0 AS BIGINT) AS hits, priority, 'Traffic of ' || name AS description,
       CAST(NULL AS VARCHAR(10)) AS recommended_action, 'internal' AS source_zone,
       CASE WHEN name = 'click' OR priority > 5 THEN 'any' ELSE '192.168.0.0/16' END AS source_address,
       'external' AS destination_zone,
       CASE WHEN name IN ('click', 'view') OR priority > 5 THEN 'any' ELSE '10.0.0.0/8' END AS destination_address,
       'any' AS application,
       CASE WHEN name IN ('click', 'purchase') OR priority > 5 THEN 'any' ELSE 'http' END AS service,
       'any' AS url_category, 'allow' AS action, 'default' AS profile_group, 'log both ends' AS options,
       CAST('2023-06-30' AS DATE) AS modified_date, CAST('2022-02-11' AS DATE) AS created_date,
       CASE WHEN name IN ('click', 'signup') THEN 'risky' WHEN name = 'error' THEN 'normal'
            ELSE 'permissive' END AS risky_permissive,
       'egress' AS ingress_egress
  FROM (SELECT DISTINCT event_type AS name,
               CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4
                    ELSE 5 END AS priority FROM events
        UNION ALL SELECT 'legacy-' || r_name AS name, CAST(6 + r_regionkey AS INT) AS priority FROM region) AS named"""


def _named(sql: str) -> str:
    """Name the tables the way spark.sql binds DataFrames."""
    for table in ("events", "region"):
        sql = sql.replace(f"FROM {table}", "FROM {" + table + "}")
    return sql


def _run(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(_named(sql), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, FLOWS, "events")


def wide_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, WIDE_FLOWS, "events")


def dirty_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, DIRTY_FLOWS, "events")


def few_pairs(spark: SparkSession, sf_dir: str, pairs: int) -> DataFrame:
    """A log whose addresses fold into exactly `pairs` network pairs."""
    return _run(spark, sf_dir, few_pairs_log(pairs), "events")


def host_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, HOST_FLOWS, "events")


def odd_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, ODD_LOG.replace('"', "`"), "events")


def given_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, GIVEN_NETWORKS, "events")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, RULES, "events", "region")
