"""DuckDB SQL for every query, written independently of the Spark plans.

Folding is a gap-and-island window and a recursive halving of runs; labels are a plain
containment join. Both are fine at check scale and say directly what the result must be.
"""

from __future__ import annotations

from workload.views import DIRTY_FLOWS, FLOWS, GIVEN_NETWORKS, HOST_FLOWS, ODD_LOG, RULES, WIDE_FLOWS, few_pairs_log

_NAMED = "(80, 443, 22, 3389, 21, 25, 53, 123, 161, 3306, 1433)"
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def _is_ipv4(ip: str) -> str:
    return f"regexp_full_match({ip}, '({_OCTET}[.]){{3}}{_OCTET}')"



def _number(ip: str) -> str:
    parts = " + ".join(f"CAST(split_part({ip}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4))
    return f"CASE WHEN {_is_ipv4(ip)} THEN {parts} END"


def _dotted(n: str) -> str:
    return " || '.' || ".join(f"CAST(({n} >> {s}) & 255 AS VARCHAR)" for s in (24, 16, 8, 0))


def _service_name(port: str) -> str:
    return (f"CASE {port} WHEN 80 THEN 'http' WHEN 443 THEN 'https' WHEN 22 THEN 'ssh' WHEN 3389 THEN 'rdp' "
            f"WHEN 21 THEN 'ftp' WHEN 25 THEN 'smtp' WHEN 53 THEN 'dns' WHEN 123 THEN 'ntp' WHEN 161 THEN 'snmp' "
            f"WHEN 3306 THEN 'mysql' WHEN 1433 THEN 'mssql' END")


def _services(port: str) -> str:
    """Aggregate: service text of distinct ports, ascending; null when there is no port."""
    named = f"string_agg({_service_name(port)}, ', ' ORDER BY {port}) FILTER (WHERE {port} IN {_NAMED})"
    custom = (f"'custom-ports-' || string_agg(CAST({port} AS VARCHAR), '-' ORDER BY {port}) "
              f"FILTER (WHERE {port} NOT IN {_NAMED})")
    return f"nullif(concat_ws(', ', {named}, {custom}), '')"


def _with(sql: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {sql}"


def _log(view: str) -> str:
    return f"flows AS ({view})"


_RULE_TABLE = f"rules AS ({RULES})"
_SIDES = """sides AS (SELECT 'source' AS k, src_ip AS ip, rule_name FROM flows
  UNION ALL SELECT 'destination', dst_ip, rule_name FROM flows)"""
_BY_RULE = "sides AS (SELECT * FROM both_sides WHERE rule_name IS NOT NULL)"


def _networks(source: str, p: str = "") -> list[str]:
    """CTEs {p}blocks and {p}nets over `source`, a query with columns k and ip."""
    return [
        f"{p}texts AS (SELECT DISTINCT k, ip FROM ({source}) WHERE k IS NOT NULL AND ip IS NOT NULL)",
        f"{p}addrs AS (SELECT k, ip, {_number('ip')} AS a FROM {p}texts)",
        f"""{p}marked AS (SELECT k, ip, a, CASE WHEN a - lag(a) OVER (PARTITION BY k ORDER BY a) <= 256 THEN 0 ELSE 1 END AS opens
  FROM {p}addrs WHERE a IS NOT NULL)""",
        f"""{p}blocks AS (SELECT k, ip, a, CAST(sum(opens) OVER (PARTITION BY k ORDER BY a ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS b
  FROM {p}marked)""",
        f"""{p}ranked AS (SELECT k, b, a, row_number() OVER (PARTITION BY k, b ORDER BY a) - 1 AS rn FROM {p}blocks)""",
        f"""{p}node(k, b, lo, hi, first, last) AS (
  SELECT k, b, CAST(0 AS BIGINT), count(*), min(a), max(a) FROM {p}ranked GROUP BY k, b
  UNION ALL
  SELECT h.k, h.b, h.lo, h.hi, x.a, y.a
  FROM (SELECT k, b, CASE WHEN half = 0 THEN lo ELSE lo + (hi - lo) // 2 END AS lo,
               CASE WHEN half = 0 THEN lo + (hi - lo) // 2 ELSE hi END AS hi
          FROM (SELECT *, unnest([0, 1]) AS half FROM {p}node WHERE (first >> 16) <> (last >> 16))) AS h
  JOIN {p}ranked x ON x.k = h.k AND x.b = h.b AND x.rn = h.lo
  JOIN {p}ranked y ON y.k = h.k AND y.b = h.b AND y.rn = h.hi - 1)""",
        f"""{p}sized AS (SELECT k, first, CASE WHEN first = last THEN 0 ELSE length(bin(xor(first, last))) END AS bits
  FROM {p}node WHERE (first >> 16) = (last >> 16))""",
        f"""{p}nets AS (SELECT k, first, (first >> bits) << bits AS lo, ((first >> bits) << bits) + (CAST(1 AS BIGINT) << bits) - 1 AS hi,
       {_dotted('((first >> bits) << bits)')} || '/' || CAST(32 - bits AS VARCHAR) AS cidr,
       CAST(32 - bits AS BIGINT) AS plen FROM {p}sized)""",
    ]


def _labels(p: str = "") -> str:
    return f"""{p}labels AS (SELECT t.k, t.ip, coalesce(arg_min(n.cidr, n.first), t.ip || '/32') AS cidr
  FROM {p}addrs t LEFT JOIN {p}nets n ON n.k = t.k AND n.lo >> 16 = t.a >> 16 AND t.a BETWEEN n.lo AND n.hi
  GROUP BY t.k, t.ip)"""


def _given(order: str, by_side: str = "TRUE") -> list[str]:
    """CTEs given_labels: every address of `sides` with its first containing given network, by plain BETWEEN."""
    return [
        f"given AS ({GIVEN_NETWORKS})",
        f"""given_nets AS (SELECT cidr, side, ordinal, plen, lo, lo + (CAST(1 AS BIGINT) << (32 - plen)) - 1 AS hi
  FROM (SELECT *, CAST(split_part(cidr, '/', 2) AS INT) AS plen, ({_number("split_part(cidr, '/', 1)")}) AS lo FROM given))""",
        f"given_addrs AS (SELECT DISTINCT k, ip, {_number('ip')} AS a FROM sides WHERE ip IS NOT NULL)",
        f"""given_labels AS (SELECT t.k, t.ip, coalesce(arg_min(n.cidr, ({order})), t.ip || '/32') AS cidr, count(n.cidr) > 0 AS given
  FROM given_addrs t LEFT JOIN given_nets n ON t.a BETWEEN n.lo AND n.hi AND {by_side} GROUP BY t.k, t.ip)""",
    ]


_NETS_BY_SIDE = _networks("SELECT k, ip FROM sides")
_PAIRS = [
    *_networks("SELECT 'source' AS k, src_ip AS ip FROM flows WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL "
               "UNION ALL SELECT 'destination', dst_ip FROM flows WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL"),
    _labels(),
    """pair_ports AS (SELECT s.cidr AS src_cidr, d.cidr AS dst_cidr, dst_port, count(*) AS n FROM flows
  JOIN labels s ON s.k = 'source' AND s.ip = src_ip JOIN labels d ON d.k = 'destination' AND d.ip = dst_ip GROUP BY ALL)""",
    f"""pair_rules AS (SELECT row_number() OVER (ORDER BY src_cidr, dst_cidr) - 1 AS idx, src_cidr AS source_address,
       dst_cidr AS destination_address, coalesce({_services('dst_port')}, 'any') AS service, CAST(sum(n) AS BIGINT) AS log_count
  FROM pair_ports GROUP BY src_cidr, dst_cidr)""",
    "named_rules AS (SELECT idx, 'cidr_pair_rule_' || CAST(idx AS VARCHAR) AS rule_name, * EXCLUDE (idx) FROM pair_rules)",
]
_CAP = [
    """placed AS (SELECT *, row_number() OVER (ORDER BY log_count DESC, idx) AS place, count(*) OVER () AS total FROM named_rules)""",
    "tail AS (SELECT * FROM placed WHERE total > 7 AND place > 6)",
    f"""tail_cidrs AS (SELECT DISTINCT side, cidr, split_part(cidr, '/', 1) AS base, CAST(split_part(cidr, '/', 2) AS BIGINT) AS plen
  FROM (SELECT 'source' AS side, source_address AS cidr FROM tail UNION ALL SELECT 'destination', destination_address FROM tail))""",
    f"""tail_nets AS (SELECT side, cidr, plen, lo, lo + (CAST(1 AS BIGINT) << (32 - plen)) - 1 AS hi
  FROM (SELECT *, {_number('base')} AS lo FROM tail_cidrs))""",
    """tail_text AS (SELECT side, string_agg(cidr, ', ' ORDER BY lo NULLS LAST, cidr) AS addresses FROM tail_nets x
  WHERE NOT EXISTS (SELECT 1 FROM tail_nets y WHERE y.side = x.side AND y.lo <= x.lo AND y.hi >= x.hi AND y.plen < x.plen)
  GROUP BY side)""",
    "tail_tokens AS (SELECT DISTINCT trim(unnest(string_split(service, ','))) AS token FROM tail)",
    """tail_labels AS (SELECT token AS label FROM tail_tokens WHERE token NOT LIKE 'custom-ports-%'
  UNION SELECT 'custom-ports-' || string_agg(CAST(port AS VARCHAR), '-' ORDER BY port) FROM
    (SELECT DISTINCT CAST(unnest(string_split(substr(token, 14), '-')) AS INT) AS port FROM tail_tokens
      WHERE token LIKE 'custom-ports-%') HAVING count(*) > 0)""",
    """lean AS (SELECT rule_name, source_address, destination_address, service, log_count,
         CASE WHEN total > 7 THEN place ELSE idx + 1 END AS place FROM placed WHERE total <= 7 OR place <= 6
  UNION ALL
  SELECT 'catch_all_tail', (SELECT addresses FROM tail_text WHERE side = 'source'),
         (SELECT addresses FROM tail_text WHERE side = 'destination'),
         (SELECT string_agg(label, ', ' ORDER BY label) FROM tail_labels), CAST(sum(log_count) AS BIGINT), 7
    FROM tail HAVING count(*) > 0)""",
]
# the literal catch-all: every network of the tail, busiest rule first, with '/32' behind it
_LITERAL = """tail_text AS (SELECT side, string_agg(cidr || '/32', ', ' ORDER BY log_count DESC, idx) AS addresses
  FROM (SELECT 'source' AS side, source_address AS cidr, log_count, idx FROM tail
        UNION ALL SELECT 'destination', destination_address, log_count, idx FROM tail) GROUP BY side)"""
_SINGLE = [
    "side_text AS (SELECT k, string_agg(cidr, ', ' ORDER BY first) AS addresses FROM nets GROUP BY k)",
    f"""single AS (SELECT coalesce((SELECT addresses FROM side_text WHERE k = 'source'), 'any') AS source_address,
       coalesce((SELECT addresses FROM side_text WHERE k = 'destination'), 'any') AS destination_address,
       coalesce((SELECT {_services('p')} FROM (SELECT DISTINCT dst_port AS p FROM flows)), 'any') AS service,
       (SELECT count(*) FROM flows) AS log_count)""",
]
_RULE_TEXTS = [
    *_networks("SELECT rule_name || '|' || k AS k, ip FROM sides WHERE rule_name IS NOT NULL"),
    "rule_text AS (SELECT k, string_agg(cidr, ', ' ORDER BY first) AS addresses FROM nets GROUP BY k)",
    f"""rule_ports AS (SELECT rule_name, {_services('dst_port')} AS service
  FROM (SELECT DISTINCT rule_name, dst_port FROM flows WHERE rule_name IS NOT NULL AND dst_port IS NOT NULL) GROUP BY rule_name)""",
    "usage AS (SELECT rule_name, count(*) AS log_count FROM flows WHERE rule_name IS NOT NULL GROUP BY rule_name)",
    """seen AS (SELECT u.rule_name, u.log_count, s.addresses AS src, d.addresses AS dst, p.service AS svc FROM usage u
  LEFT JOIN rule_text s ON s.k = u.rule_name || '|source' LEFT JOIN rule_text d ON d.k = u.rule_name || '|destination'
  LEFT JOIN rule_ports p ON p.rule_name = u.rule_name)""",
]


def _top(column: str, alias: str, n: int = 10, where: str = "TRUE") -> str:
    return (f"SELECT {column} AS {alias}, count(*) AS count FROM flows WHERE {column} IS NOT NULL AND {where} "
            f"GROUP BY 1 ORDER BY count DESC, 1 LIMIT {n}")


_UNUSUAL = _top("dst_port", "dst_port", where=f"dst_port NOT IN {_NAMED}")
_PAIR = "src_ip || ' -> ' || dst_ip"
_PAIR_COUNTS = """SELECT src_ip, dst_ip, count(*) AS count FROM flows
  WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL GROUP BY src_ip, dst_ip"""
_RARE = f"SELECT * FROM ({_PAIR_COUNTS}) WHERE count < 5"
_STATS = """SELECT count(*) AS total_log_entries, count(DISTINCT src_ip) AS unique_source_ips,
  count(DISTINCT dst_ip) AS unique_destination_ips, count(DISTINCT dst_port) AS unique_destination_ports FROM flows"""
_EDGES = "edges AS (SELECT * FROM pairs ORDER BY count DESC, src_ip, dst_ip LIMIT 30)"
_USAGE = """SELECT r.*, coalesce(u.n, 0) AS log_count FROM rules r
  LEFT JOIN (SELECT rule_name, count(*) AS n FROM flows GROUP BY rule_name) u ON u.rule_name = r.rule_name"""
_LEAN_FIELDS = "rule_name, source_address, destination_address, service, log_count, CAST(place AS BIGINT) AS place"


def _report_part(section: str, place: str, source: str, name="NULL", src="NULL", dst="NULL", service="NULL",
                 count="count") -> str:
    return (f"SELECT '{section}' AS section, CAST({place} AS BIGINT) AS place, CAST({name} AS VARCHAR) AS name, "
            f"CAST({src} AS VARCHAR) AS source_address, CAST({dst} AS VARCHAR) AS destination_address, "
            f"CAST({service} AS VARCHAR) AS service, CAST({count} AS BIGINT) AS count FROM ({source})")


def _ranked(section: str, top: str, key: str) -> str:
    return _report_part(section, f"row_number() OVER (ORDER BY count DESC, {key})", top, name=key)


def _report_rows() -> str:
    stats = ", ".join(
        f"{{'place': {i + 1}, 'name': '{c}', 'count': {c}}}" for i, c in enumerate(
            ("total_log_entries", "unique_source_ips", "unique_destination_ips", "unique_destination_ports")))
    parts = [
        _report_part("basic_stats", "s.place", f"SELECT unnest([{stats}]) AS s FROM ({_STATS})", name="s.name",
                     count="s.count"),
        _ranked("top_source_ips", _top("src_ip", "src_ip"), "src_ip"),
        _ranked("top_destination_ips", _top("dst_ip", "dst_ip"), "dst_ip"),
        _ranked("top_destination_ports", _top("dst_port", "dst_port"), "dst_port"),
        _ranked("top_source_dest_pairs", _top(_PAIR, "pair"), "pair"),
        _ranked("unusual_ports", _UNUSUAL, "dst_port"),
        _report_part("low_occurrence_pairs", "row_number() OVER (ORDER BY src_ip, dst_ip)",
                     f"{_RARE} ORDER BY src_ip, dst_ip LIMIT 10", src="src_ip", dst="dst_ip"),
        _report_part("low_occurrence_total", "1", f"SELECT count(*) AS count FROM ({_RARE})"),
        _report_part("low_occurrence_listed", "1", f"SELECT least(count(*), 10) AS count FROM ({_RARE})"),
        _ranked("unusual_ports_preview", f"SELECT * FROM ({_UNUSUAL}) ORDER BY count DESC, dst_port LIMIT 5", "dst_port"),
        _report_part("optimized_single_rule", "1", "SELECT * FROM single", src="source_address",
                     dst="destination_address", service="service", count="log_count"),
        _report_part("lean_rules", "place", "SELECT * FROM lean", name="rule_name", src="source_address",
                     dst="destination_address", service="service", count="log_count"),
    ]
    return " UNION ALL ".join(parts)


def _json_counts(top: str, key: str) -> str:
    return (f"(SELECT '{{' || string_agg('\"' || {key} || '\":' || count, ',' ORDER BY count DESC, {key}) || '}}' "
            f"FROM ({top}))")


def _report_json() -> str:
    stats = "'{' || " + " || ',' || ".join(
        f"'\"{c}\":' || {c}" for c in ("total_log_entries", "unique_source_ips", "unique_destination_ips",
                                       "unique_destination_ports")) + " || '}'"
    pairs = ("(SELECT '[' || string_agg('{\"source.ip\":\"' || src_ip || '\",\"destination.ip\":\"' || dst_ip || "
             f"'\",\"count\":' || count || '}}', ',' ORDER BY src_ip, dst_ip) || ']' "
             f"FROM ({_RARE} ORDER BY src_ip, dst_ip LIMIT 10))")
    patterns = " || ',' || ".join(f"'\"{name}\":' || {_json_counts(top, key)}" for name, top, key in (
        ("top_source_ips", _top("src_ip", "src_ip"), "src_ip"),
        ("top_destination_ips", _top("dst_ip", "dst_ip"), "dst_ip"),
        ("top_destination_ports", _top("dst_port", "dst_port"), "dst_port"),
        ("top_source_dest_pairs", _top(_PAIR, "pair"), "pair"),
    ))
    rule = ("(SELECT '{\"source_address\":\"' || source_address || '\",\"destination_address\":\"' || "
            "destination_address || '\",\"service\":\"' || service || '\",\"log_count\":' || log_count || '}' FROM single)")
    return f"""SELECT '{{"basic_stats":' || (SELECT {stats} FROM ({_STATS})) || ',"traffic_patterns":{{' || {patterns}
  || '}},"anomalies":{{' || concat_ws(',', '"unusual_ports":' || {_json_counts(_UNUSUAL, 'dst_port')},
  '"low_occurrence_pairs":' || {pairs}) || '}},"optimized_single_rule":' || {rule} || '}}' AS report"""


def _optimized(where: str = "") -> str:
    def narrowed(field: str, text: str) -> str:
        return f"CASE WHEN r.{field} = 'any' THEN s.{text} END"

    fields = (("source_address", "src"), ("destination_address", "dst"), ("service", "svc"))
    verbs = ("Restrict source address to ", "Restrict destination address to ", "Restrict service to ")
    advice = "concat_ws('; ', " + ", ".join(
        f"'{verb}' || {narrowed(*f)}" for f, verb in zip(fields, verbs)) + (
        ", CASE WHEN r.risky_permissive = 'risky' THEN 'This rule is marked as risky and should be reviewed' END)")
    new = ", ".join(f"CASE WHEN advice <> '' THEN coalesce(new_{f}, {f}) END AS optimized_{f}" for f, _ in fields)
    inner = ", ".join(f"r.{f}, {narrowed(f, t)} AS new_{f}" for f, t in fields)
    return f"""SELECT rule_name, priority, source_address, destination_address, service,
  CASE WHEN advice IS NULL THEN 'Consider removing this unused rule' WHEN advice = '' THEN 'No optimization needed'
       ELSE advice END AS recommendation, {new}
  FROM (SELECT r.rule_name, r.priority, {inner}, CASE WHEN s.rule_name IS NOT NULL THEN {advice} END AS advice
          FROM rules r LEFT JOIN seen s ON s.rule_name = r.rule_name)"""


_LOG_RULES = """SELECT *, 'Optimize source address to ' || source_address || '; Optimize destination address to '
    || destination_address || '; Optimize service to ' || service AS recommendation
  FROM (SELECT rule_name, coalesce(src, 'any') AS source_address, coalesce(dst, 'any') AS destination_address,
               coalesce(svc, 'any') AS service, log_count FROM seen)"""


def _capped(log: str, suffix: str) -> dict[str, str]:
    out = {}
    out["lean_rules" + suffix] = _with(f"SELECT {_LEAN_FIELDS} FROM lean", log, *_PAIRS, *_CAP, recursive=True)
    out["capped_rules_literal" + suffix] = _with(
        f"SELECT {_LEAN_FIELDS} FROM lean", log, *_PAIRS, *_CAP[:2], _LITERAL, *_CAP[5:], recursive=True)
    out["catch_all_networks" + suffix] = _with(
        "SELECT side, cidr FROM tail_nets x WHERE NOT EXISTS (SELECT 1 FROM tail_nets y WHERE y.side = x.side "
        "AND y.lo <= x.lo AND y.hi >= x.hi AND y.plen < x.plen)", log, *_PAIRS,
        *_CAP[:4], recursive=True)
    out["catch_all_labels" + suffix] = _with(
        "SELECT side, row_number() OVER (PARTITION BY side ORDER BY log_count DESC, idx) - 1 AS pos, cidr || '/32' AS address "
        "FROM (SELECT 'source' AS side, source_address AS cidr, log_count, idx FROM tail "
        "UNION ALL SELECT 'destination', destination_address, log_count, idx FROM tail)",
        log, *_PAIRS, *_CAP[:2], recursive=True)
    return out


def _sections() -> str:
    kinds = {"src_ip": "VARCHAR", "dst_ip": "VARCHAR", "dst_port": "BIGINT", "rule_name": "VARCHAR", "hour": "BIGINT", "day_of_week": "BIGINT",
             "ingress_zone": "VARCHAR", "egress_zone": "VARCHAR"}
    sets = {"flow": "src_ip dst_ip dst_port rule_name", "plain_flow": "src_ip dst_ip dst_port", "pair": "src_ip dst_ip", "source": "src_ip",
            "destination": "dst_ip", "port": "dst_port", "hour": "hour day_of_week", "zones": "ingress_zone egress_zone"}
    return " UNION ALL ".join(
        f"SELECT '{name}' AS section, " + ", ".join(f"CAST({c if c in keys.split() else 'NULL'} AS {kind}) AS {c}" for c, kind in kinds.items())
        + f", count(*) AS flow_count FROM timed GROUP BY {keys.replace(' ', ', ')}" for name, keys in sets.items())


def oracle_sql() -> dict[str, str]:
    flows, wide, dirty = _log(FLOWS), _log(WIDE_FLOWS), _log(DIRTY_FLOWS)
    by_source = _networks("SELECT 0 AS k, src_ip AS ip FROM flows")
    by_destination = _networks("SELECT 0 AS k, dst_ip AS ip FROM flows")
    net_rows = "SELECT cidr, lo, hi, plen, first AS first_addr FROM nets"
    out = {
        "minimal_fields": _with("SELECT src_ip, dst_ip, CAST(dst_port AS BIGINT) AS dst_port FROM flows", flows),
        "minimal_fields_csv": _with("SELECT src_ip, dst_ip, CAST(dst_port AS BIGINT) AS dst_port FROM flows", dirty),
        "flow_summary": _with("SELECT src_ip, dst_ip, CAST(dst_port AS BIGINT) AS dst_port, rule_name, "
                              "count(*) AS flow_count FROM flows GROUP BY ALL", dirty),
        "pair_counts": _with(_PAIR_COUNTS, flows),
        "pair_counts_wide": _with(_PAIR_COUNTS, wide),
        "low_occurrence_pairs": _with(f"{_RARE} ORDER BY src_ip, dst_ip LIMIT 10", flows),
        "graph_edges": _with("SELECT src_ip, dst_ip, count AS weight, count / 10.0 AS width FROM edges", flows,
                             f"pairs AS ({_PAIR_COUNTS})", _EDGES),
        "graph_nodes": _with(
            "SELECT id, arg_max(type, turn) AS type, CASE WHEN arg_max(type, turn) = 'source' THEN 'skyblue' "
            "ELSE 'lightgreen' END AS colour FROM written GROUP BY id", flows, f"pairs AS ({_PAIR_COUNTS})", _EDGES,
            "ranked_edges AS (SELECT *, row_number() OVER (ORDER BY count DESC, src_ip, dst_ip) AS r FROM edges)",
            "written AS (SELECT src_ip AS id, 'source' AS type, 2 * r AS turn FROM ranked_edges "
            "UNION ALL SELECT dst_ip, 'destination', 2 * r + 1 FROM ranked_edges)"),
        "invalid_ips": _with(
            f"SELECT k AS side, ip, CASE WHEN ip IS NULL THEN 'missing' ELSE 'not_ipv4' END AS reason, count(*) AS rows "
            f"FROM sides WHERE ip IS NULL OR NOT {_is_ipv4('ip')} GROUP BY k, ip", dirty, _SIDES),
        "rule_usage": _with(f"SELECT rule_name, priority, risky_permissive, log_count FROM ({_USAGE})", flows, _RULE_TABLE),
        "rule_hits": _with(f"SELECT rule_name, log_count AS hits, priority FROM ({_USAGE})", flows, _RULE_TABLE),
        "unused_rules": _with(
            f"SELECT rule_name, description, priority FROM ({_USAGE}) WHERE log_count = 0", flows, _RULE_TABLE),
        "permissive_rules": _with(
            "SELECT rule_name, description, source_address, destination_address, service, log_count "
            f"FROM ({_USAGE}) WHERE risky_permissive = 'permissive' AND log_count > 0", flows, _RULE_TABLE),
        "rule_patterns": _with(
            "SELECT rule_name, count(DISTINCT src_ip) AS unique_source_ips, count(DISTINCT dst_ip) AS unique_destination_ips, "
            "count(DISTINCT dst_port) AS unique_destination_ports, array_to_string(list_sort(list(DISTINCT dst_port) "
            "FILTER (WHERE dst_port IS NOT NULL)), ',') AS destination_ports FROM flows WHERE rule_name IN "
            "(SELECT rule_name FROM rules) GROUP BY rule_name", dirty, _RULE_TABLE),
        "rule_pattern_values": _with(
            "SELECT DISTINCT rule_name, field, value FROM (SELECT rule_name, 'source_ips' AS field, src_ip AS value FROM flows "
            "UNION ALL SELECT rule_name, 'destination_ips', dst_ip FROM flows "
            "UNION ALL SELECT rule_name, 'destination_ports', CAST(dst_port AS VARCHAR) FROM flows) "
            "WHERE value IS NOT NULL AND rule_name IN (SELECT rule_name FROM rules)", dirty, _RULE_TABLE),
        "port_services": _with("SELECT rule_name, service FROM rule_ports", dirty, _RULE_TEXTS[-3]),
        "traffic_by_hour": _with("SELECT CAST(hour(ts) AS BIGINT) AS hour, CAST(dayofweek(ts) + 1 AS BIGINT) AS day_of_week, "
                                 "count(*) AS count FROM flows GROUP BY ALL", flows),
        "traffic_by_zone": _with("SELECT ingress_zone, egress_zone, count(*) AS count FROM flows GROUP BY ALL", flows),
        "after_hours": _with("SELECT event_id, src_ip, dst_ip, CAST(dst_port AS BIGINT) AS dst_port FROM flows "
                             "WHERE hour(ts) < 8 OR hour(ts) >= 18 OR dayofweek(ts) IN (0, 6)", flows),
        "report_rows": _with(_report_rows(), flows, _SIDES, *_networks("SELECT k, ip FROM sides"), *_SINGLE,
                             _labels(), *_PAIRS[-3:], *_CAP, recursive=True),
        "report_json": _with(_report_json(), flows, _SIDES, *_NETS_BY_SIDE, *_SINGLE, recursive=True),
    }
    for suffix, log in (("", flows), ("_dirty", dirty)):
        out["basic_stats" + suffix] = _with(_STATS, log)
        out["top_source_ips" + suffix] = _with(_top("src_ip", "src_ip"), log)
        out["top_destination_ips" + suffix] = _with(_top("dst_ip", "dst_ip"), log)
        out["top_destination_ports" + suffix] = _with(_top("CAST(dst_port AS BIGINT)", "dst_port"), log)
        out["top_pairs" + suffix] = _with(_top(_PAIR, "src_dst_pair"), log)
        out["unusual_ports" + suffix] = _with(
            _top("CAST(dst_port AS BIGINT)", "dst_port", where=f"dst_port NOT IN {_NAMED}"), log)
        out["optimized_rules" + suffix] = _with(
            _optimized(), log, _SIDES, _RULE_TABLE, *_RULE_TEXTS, recursive=True)
        out["log_based_rules" + suffix] = _with(_LOG_RULES, log, _SIDES, *_RULE_TEXTS, recursive=True)
    for suffix, log in (("", flows), ("_wide", wide), ("_dirty", dirty)):
        out["ip_blocks" + suffix] = _with(
            "SELECT k AS side, ip, b AS run_no FROM blocks", log, _SIDES, *_NETS_BY_SIDE, recursive=True)
        out["src_networks" + suffix] = _with(net_rows, log, *by_source, recursive=True)
        out["dst_networks" + suffix] = _with(net_rows, log, *by_destination, recursive=True)
        out["networks_by_rule" + suffix] = _with(
            "SELECT split_part(k, '|', 1) AS rule_name, split_part(k, '|', 2) AS side, cidr, first AS first_addr FROM nets",
            log, _SIDES, *_RULE_TEXTS[:-4], recursive=True)
        out["ip_to_cidr" + suffix] = _with(
            "SELECT k AS side, ip, cidr FROM labels", log, _SIDES, *_NETS_BY_SIDE, _labels(), recursive=True)
        out["single_rule" + suffix] = _with("SELECT * FROM single", log, _SIDES, *_NETS_BY_SIDE, *_SINGLE, recursive=True)
        out["cidr_pair_rules" + suffix] = _with(
            "SELECT rule_name, source_address, destination_address, service, log_count FROM named_rules",
            log, *_PAIRS, recursive=True)
        out |= _capped(log, suffix)
        in_order = "ORDER BY first NULLS LAST, cidr) - 1 AS pos, cidr"
        out["single_rule_networks" + suffix] = _with(
            f"SELECT k AS side, row_number() OVER (PARTITION BY k {in_order} FROM nets", log, _SIDES, *_NETS_BY_SIDE, recursive=True)
        out["rule_networks" + suffix] = _with(
            f"SELECT split_part(k, '|', 1) AS rule_name, split_part(k, '|', 2) AS side, row_number() OVER (PARTITION BY k {in_order} FROM nets",
            log, _SIDES, *_RULE_TEXTS[:-4], recursive=True)
    for pairs, suffix in ((7, "_seven"), (8, "_eight")):
        out |= _capped(_log(few_pairs_log(pairs)), suffix)
    out["log_parquet"] = _with("SELECT src_ip, collector, CAST(dst_port AS BIGINT) AS dst_port, dst_ip, egress_zone, ingress_zone, "
                               "rule_name FROM flows", dirty)
    line = """concat_ws(',', "source.ip", "destination.ip", "destination.port", "rule.name")"""
    out["rejected_values"] = _with(
        f"""SELECT 'row' AS "column", {line} AS text, count(*) AS rows FROM odd WHERE "rule.name" LIKE '%,%' GROUP BY ALL UNION ALL
        SELECT 'dst_port', "destination.port", count(*) FROM odd WHERE "rule.name" NOT LIKE '%,%'
        AND "destination.port" IN ('70000', 'ssh') GROUP BY ALL""", f"odd AS ({ODD_LOG})")
    out["hits_written_back"] = _with(
        f"SELECT rule_name, 2 * log_count AS hits, CAST(priority AS BIGINT) AS priority FROM ({_USAGE})", flows, _RULE_TABLE)
    out["observed_rejects"] = _with(
        f"SELECT count(*) AS rows, count_if(ip IS NULL) AS missing, count_if(ip IS NOT NULL AND NOT {_is_ipv4('ip')}) AS not_ipv4 FROM sides",
        dirty, _SIDES)
    counts = "count(DISTINCT src_ip) AS src_ip, count(DISTINCT dst_ip) AS dst_ip, count(DISTINCT dst_port) AS dst_port"
    out["merged_distinct_counts"] = _with(f"SELECT rule_name, count(*) AS rows, {counts} FROM flows GROUP BY rule_name", dirty)
    out["sketched_counts"] = _with("SELECT rule_name, count(*) AS rows, TRUE AS sources_within, TRUE AS destinations_within, "
                                   "TRUE AS ports_within FROM flows GROUP BY rule_name", wide)
    out["log_sections"] = _with(_sections(), dirty, "timed AS (SELECT *, hour(ts) AS hour, dayofweek(ts) + 1 AS day_of_week FROM flows)")
    out["list_parts"] = _with("SELECT k AS side, row_number() OVER (PARTITION BY k ORDER BY first NULLS LAST, cidr) - 1 AS pos, "
                              "cidr AS value FROM nets", wide, _SIDES, *_NETS_BY_SIDE, recursive=True)
    out["bucketed_networks"] = _with(net_rows, wide, *by_source, recursive=True)
    out["bucketed_labels"] = _with("SELECT ip, cidr FROM labels", wide, *by_source, _labels(), recursive=True)
    given_rows = "SELECT k AS side, ip, cidr, given FROM given_labels"
    by_length = "{'a': -plen, 'b': lo}"
    for suffix, log in (("", flows), ("_wide", wide), ("_dirty", dirty)):
        out["ip_to_given_networks" + suffix] = _with(given_rows, log, _SIDES, *_given("{'a': lo, 'b': plen}"))
        out["ip_to_longest_network" + suffix] = _with(given_rows, log, _SIDES, *_given(by_length))
        out["given_pair_rules" + suffix] = _with(
            "SELECT rule_name, source_address, destination_address, service, log_count FROM named_rules", log,
            "sides AS (SELECT 'source' AS k, src_ip AS ip FROM flows WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL "
            "UNION ALL SELECT 'destination', dst_ip FROM flows WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL)",
            *_given("{'a': ordinal, 'b': plen, 'c': lo}", "n.side = t.k"), "labels AS (SELECT * FROM given_labels)", *_PAIRS[-3:])
    out["rule_networks_listed"] = _with(
        "SELECT rule_name, 'source' AS side, CAST(0 AS BIGINT) AS pos, source_address AS cidr FROM rules "
        "UNION ALL SELECT rule_name, 'destination', 0, destination_address FROM rules", _RULE_TABLE)
    labels = "SELECT DISTINCT rule_name, side, ip || '/32' AS cidr FROM s"
    of_rules = ("s AS (SELECT rule_name, 'source' AS side, src_ip AS ip FROM flows UNION ALL "
                "SELECT rule_name, 'destination', dst_ip FROM flows)")
    host = _log(HOST_FLOWS)
    by_rule = "SELECT split_part(k, '|', 1) AS rule_name, split_part(k, '|', 2) AS side, cidr FROM nets"
    # a key without IPv4 has its texts as labels, any other its networks
    has_ipv4 = f"EXISTS (SELECT 1 FROM s t WHERE t.rule_name = s.rule_name AND t.side = s.side AND {_is_ipv4('t.ip')})"
    out["networks_without_ipv4"] = _with(
        f"{labels} WHERE ip IS NOT NULL AND NOT {has_ipv4} UNION ALL {by_rule} WHERE lo IS NOT NULL",
        host, _SIDES, of_rules, *_RULE_TEXTS[:-4], recursive=True)
    # one text that is no address at all, neither IPv4 nor IPv6, turns its key into labels
    broken = (f"EXISTS (SELECT 1 FROM s t WHERE t.rule_name = s.rule_name AND t.side = s.side AND t.ip IS NOT NULL "
              f"AND NOT {_is_ipv4('t.ip')} AND t.ip NOT LIKE '%:%')")
    out["networks_all_host"] = _with(
        f"{labels} WHERE ip IS NOT NULL AND rule_name IS NOT NULL AND {broken} UNION ALL {by_rule} s WHERE NOT EXISTS ("
        f"SELECT 1 FROM s t WHERE t.rule_name = split_part(k, '|', 1) AND t.side = split_part(k, '|', 2) AND t.ip IS NOT NULL "
        f"AND NOT {_is_ipv4('t.ip')} AND t.ip NOT LIKE '%:%')", _log(DIRTY_FLOWS), _SIDES, of_rules, *_RULE_TEXTS[:-4], recursive=True)
    return out
