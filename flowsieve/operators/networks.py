"""Folding address sets into CIDR networks.

Distinct addresses are spread by (keys, /16 block): a block holds at most 65,536 of them,
however many log rows share one source. Windows run inside a block, or over one summary row
per block (at most 131,072 rows per key), so no task ever sees a whole address set.

A run is a sequence of addresses with steps of at most `MAX_STEP`. A run inside one /16
becomes its smallest enclosing network. A run that crosses /16 borders is halved by address
count until no piece crosses one. The halving is pure arithmetic on ranks: a piece is split
only while it contains a border, so the cut ranks near a border follow from the border's own
rank and the run's length, without looking at other rows and without recursion over tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from flowsieve.functions.ip import address_block, clear_low_bits, differing_bits, ip_to_long, is_ipv4, is_ipv6, long_to_ip
from flowsieve.operators.counts import grouped_counts, row_count
from flowsieve.schema import FLOW_COUNT, key_list
from flowsieve.sources.scratch import materialise

SOURCE, DESTINATION = "source", "destination"
# Fixed value: the largest step between neighbours of one run.
MAX_STEP = 256
# A run of 2^32 addresses is halved at most 32 times before only single addresses are left.
MAX_HALVINGS = 33

# SQL: the text of an address as it was read.
ADDRESS_TEXT = f"coalesce(loose, {long_to_ip('addr')})"

_NO_RANKS = "CAST(array() AS ARRAY<BIGINT>)"
_SO_FAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
# whole-partition frames keep the order of their neighbours, so that one window operator serves all
_WHOLE = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _quoted(keys: Sequence[str]) -> list[str]:
    return [f"`{k}`" for k in keys]


def _window(keys: Sequence[str], order: str, frame: str = "") -> str:
    partition = f"PARTITION BY {', '.join(keys)}" if keys else ""
    return f"OVER ({partition} ORDER BY {order} {frame})"


def distinct_addresses(ips: DataFrame, keys: Sequence[str] = (), ip: str = "ip") -> DataFrame:
    """Distinct addresses by key: (keys, addr, loose, block); null keys and addresses drop out.

    An IPv4 address is only its number, any other text is in `loose`, see ADDRESS_TEXT. Callers
    that join this with a summary of itself read the same four columns on both sides, so that
    Spark reuses both shuffles.
    """
    found = ips.select(*key_list(keys), F.col(ip).alias("ip"))
    for name in found.columns:
        found = found.where(F.col(name).isNotNull())
    found = found.distinct()
    keys = _quoted(key_list(keys))
    numbered = found.selectExpr(*keys, "ip", f"{ip_to_long('ip')} AS addr")
    return numbered.selectExpr(
        *keys, "addr", "CASE WHEN addr IS NULL THEN ip END AS loose", f"{address_block('ip', 'addr')} AS block")


def _runs_in_block(addresses: DataFrame, keys: list[str]) -> DataFrame:
    """Rank of each address in its block, and the number of its run in the block."""
    block = [*_quoted(keys), "block"]
    in_order = _window(block, "addr")
    return addresses.selectExpr(
        "*",
        f"coalesce(addr - lag(addr) {in_order} > {MAX_STEP}, false) AS opens",
        f"CAST(row_number() {in_order} AS BIGINT) - 1 AS rank",
    ).selectExpr("*", f"sum(CAST(opens AS BIGINT)) {_window(block, 'addr', _SO_FAR)} AS run")


def _cut_ranks(border: str, length: str) -> str:
    """SQL: ranks at which halving a run of `length` addresses cuts on its way to `border`."""
    mid = "s.low + (s.high - s.low) DIV 2"
    inside = f"{border} > s.low AND {border} < s.high"
    return f"""CASE WHEN {border} > 0 AND {border} < {length} THEN aggregate(
      sequence(1, {MAX_HALVINGS}),
      named_struct('low', 0L, 'high', {length}, 'cuts', {_NO_RANKS}),
      (s, step) -> named_struct(
        'low', CASE WHEN {inside} AND {border} >= {mid} THEN {mid} ELSE s.low END,
        'high', CASE WHEN {inside} AND {border} < {mid} THEN {mid} ELSE s.high END,
        'cuts', CASE WHEN {inside} THEN concat(s.cuts, array({mid})) ELSE s.cuts END),
      s -> s.cuts) ELSE {_NO_RANKS} END"""


def _cuts_in_piece(base: str, size: str, length: str, first_rank: str) -> str:
    """SQL: block-local ranks at which the piece [base, base + size) of a run is cut."""
    cuts = f"array_union({_cut_ranks(base, length)}, {_cut_ranks(f'({base} + {size})', length)})"
    return (f"transform(filter({cuts}, c -> c > {base} AND c < {base} + {size}), "
            f"c -> c - {base} + {first_rank})")


def _block_summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (keys, block): how its runs join the neighbouring blocks, and where they are cut."""
    names = _quoted(keys)
    blocks = runs.groupBy(*keys, "block").agg(
        F.expr("min(addr) AS low"),
        F.expr("max(addr) AS high"),
        F.expr("count(*) AS size"),
        F.expr("max(run) + 1 AS runs"),
        F.expr("count_if(run = 0) AS head_size"),
        F.expr("coalesce(max(CASE WHEN opens THEN rank END), 0L) AS tail_rank"),
        F.expr("max(loose IS NULL) AS any_ipv4"),
        F.expr(f"max(loose IS NOT NULL AND NOT {is_ipv6('loose')}) AS any_broken"),
    )
    # joins: the first run continues the last run of the previous block
    linked = blocks.selectExpr(
        "*",
        f"coalesce(low - lag(high) {_window(names, 'block')} <= {MAX_STEP}, false) AS joins",
        "size - tail_rank AS tail_size",
        f"max(any_ipv4) {_window(names, 'block', _WHOLE)} AS has_ipv4",
        f"max(any_broken) {_window(names, 'block', _WHOLE)} AS has_broken",
    )
    # origin: the block in which the last run of this block begins
    chained = linked.selectExpr(
        "*",
        f"max(CASE WHEN NOT joins OR runs > 1 THEN block END) {_window(names, 'block', _SO_FAR)} AS origin",
        f"lead(CASE WHEN joins AND runs > 1 THEN head_size ELSE 0 END, 1, 0L) {_window(names, 'block')} AS next_head",
        f"coalesce(sum(runs - CAST(joins AS BIGINT)) {_window(names, 'block', _BEFORE)}, 0L) AS runs_before",
    )
    of_run = [*names, "origin"]
    ranked = chained.selectExpr(
        "*",
        f"coalesce(sum(tail_size) {_window(of_run, 'block', _BEFORE)}, 0L) AS tail_base",
        f"sum(tail_size + next_head) {_window(of_run, 'block', _WHOLE)} AS tail_run",
    )
    headed = ranked.selectExpr(
        "*",
        f"lag(tail_base + tail_size) {_window(names, 'block')} AS head_base",
        f"lag(tail_run) {_window(names, 'block')} AS head_run",
    )
    head_cuts = _cuts_in_piece("head_base", "head_size", "head_run", "0L")
    tail_cuts = _cuts_in_piece("tail_base", "tail_size", "tail_run", "tail_rank")
    cuts = f"""concat(CASE WHEN joins AND runs > 1 THEN {head_cuts} ELSE {_NO_RANKS} END,
                      CASE WHEN tail_run > tail_size THEN {tail_cuts} ELSE {_NO_RANKS} END)"""
    # a block with no cuts, the usual case, gets null
    any_cuts = "(joins AND runs > 1) OR tail_run > tail_size"
    return headed.selectExpr(
        *names, "block", "joins", "runs_before", "has_ipv4", "has_broken", f"CASE WHEN {any_cuts} THEN {cuts} END AS cuts")


def ip_blocks(ips: DataFrame, keys: Sequence[str] = (), ip: str = "ip") -> DataFrame:
    """Every distinct IPv4 address with the 0-based number of its run within the keys."""
    keys = key_list(keys)
    valid = distinct_addresses(ips, keys, ip).where("addr IS NOT NULL")
    runs = _runs_in_block(valid, keys)
    placed = runs.join(_block_summary(runs, keys), [*keys, "block"])
    return placed.selectExpr(*_quoted(keys), f"{long_to_ip('addr')} AS ip", "addr", "runs_before + run - CAST(joins AS BIGINT) AS run_no")


def ip_networks(
    ips: DataFrame, keys: Sequence[str] = (), ip: str = "ip", on_invalid: str = "skip"
) -> DataFrame:
    """Fold addresses into networks, separately for each value of `keys`.

    Returns keys, cidr, net, plen, lo, hi, first_addr. The order of networks is the order of
    `first_addr`, their lowest member. Texts that are no IPv4 address are skipped; a key without
    any IPv4 address gets one 'text/32' label per text (net to first_addr are null there). With
    on_invalid='all_host' one text that is no address at all turns its key into such labels.
    """
    return networks_in_blocks(ips, keys, ip, on_invalid).drop("block")


def observe_rejects(ips: DataFrame, observation: Observation, ip: str = "ip") -> DataFrame:
    """`ips` unchanged; whatever job reads it counts on its way what folding skips.

    `observation` then has `rows`, `missing` and `not_ipv4`, in log rows also for a summary.
    """
    weight = F.col(FLOW_COUNT) if FLOW_COUNT in ips.columns else F.lit(1).cast("bigint")

    def rows(where: str) -> Column:
        return F.coalesce(F.sum(F.when(F.expr(where), weight)), F.lit(0).cast("bigint"))

    return ips.observe(
        observation, rows("true").alias("rows"), rows(f"`{ip}` IS NULL").alias("missing"),
        rows(f"`{ip}` IS NOT NULL AND NOT {is_ipv4(f'`{ip}`')}").alias("not_ipv4"))


def networks_in_blocks(
    ips: DataFrame, keys: Sequence[str] = (), ip: str = "ip", on_invalid: str = "skip"
) -> DataFrame:
    """`ip_networks` with the /16 block of each network, by which its rows are already partitioned."""
    keys = key_list(keys)
    return _folded(distinct_addresses(ips, keys, ip), keys, on_invalid)


def _folded(addresses: DataFrame, keys: list[str], on_invalid: str) -> DataFrame:
    if on_invalid not in ("skip", "all_host"):
        raise ValueError(f"on_invalid must be 'skip' or 'all_host', not {on_invalid!r}")
    runs = _runs_in_block(addresses, keys)
    placed = runs.join(_block_summary(runs, keys), [*keys, "block"])
    all_host = "has_broken" if on_invalid == "all_host" else "false"
    pieces = (
        placed.where(f"loose IS NULL OR NOT has_ipv4 OR {all_host}")
        .selectExpr(
            *_quoted(keys), "block", "run", "addr",
            f"CASE WHEN {all_host} THEN {ADDRESS_TEXT} ELSE loose END AS host",
            "CASE WHEN cuts IS NULL THEN 0 ELSE size(filter(cuts, c -> c <= rank)) END AS piece",
        )
        .groupBy(*keys, "block", "run", "piece", "host")
        .agg(F.expr("min(addr) AS first_addr"), F.expr("max(addr) AS last_addr"))
    )
    sized = pieces.selectExpr(
        *_quoted(keys), "block", "host", "CASE WHEN host IS NULL THEN first_addr END AS first_addr",
        f"CASE WHEN host IS NULL THEN {differing_bits('first_addr', 'last_addr')} END AS bits")
    network = sized.selectExpr("*", f"{clear_low_bits('first_addr', 'bits')} AS net")
    return network.selectExpr(
        *_quoted(keys),
        "block",
        f"coalesce(host || '/32', {long_to_ip('net')} || '/' || (32 - bits)) AS cidr",
        "net",
        "32 - bits AS plen",
        "net AS lo",
        "net + (1L << bits) - 1 AS hi",
        "first_addr",
    )


def placed_addresses(table: DataFrame, ip: str = "src_ip", block: str = "src_block") -> DataFrame:
    """`distinct_addresses` of a log table that `write_log_table` has bucketed by block: no shuffle."""
    found = table.select(F.col(ip).alias("ip"), F.col(block).alias("block")).where("ip IS NOT NULL").distinct()
    numbered = found.selectExpr("ip", "block", f"{ip_to_long('ip')} AS addr")
    return numbered.selectExpr("addr", "CASE WHEN addr IS NULL THEN ip END AS loose", "block")


def folded_sources(table: DataFrame, on_invalid: str = "skip") -> DataFrame:
    """`ip_networks` of the sources of a bucketed log table; only one row per block is shuffled."""
    return _folded(placed_addresses(table), [], on_invalid)


def both_sides(flows: DataFrame, *carry: str) -> DataFrame:
    """Two rows per flow: (side, ip) for its source and its destination, in one scan."""
    carry = [*carry, *(c for c in (FLOW_COUNT,) if c in flows.columns)]
    sides = F.stack(F.lit(2), F.lit(SOURCE), F.col("src_ip"), F.lit(DESTINATION), F.col("dst_ip"))
    return flows.select(*carry, sides.alias("side", "ip"))


def count_sides_and_ports(flows: DataFrame, *carry: str) -> tuple[DataFrame, DataFrame]:
    """(carry, side, ip, flow_count) and (carry, dst_port, flow_count) of a log.

    A log is read once and only its distinct addresses and ports are written; a summary is used as it
    is. Runs a job that reads a log.
    """
    if FLOW_COUNT in flows.columns:
        return both_sides(flows, *carry), flows.select(*carry, "dst_port", FLOW_COUNT)
    sets = {SOURCE: [*carry, "src_ip"], DESTINATION: [*carry, "dst_ip"], "port": [*carry, "dst_port"]}
    counted = materialise(grouped_counts(flows, sets), "sides_and_ports")
    sides = counted.where(F.col("section").isin(SOURCE, DESTINATION)).select(
        *carry, F.col("section").alias("side"), F.coalesce("src_ip", "dst_ip").alias("ip"), FLOW_COUNT)
    return sides, counted.where("section = 'port'").select(*carry, "dst_port", FLOW_COUNT)


def invalid_ips(flows: DataFrame) -> DataFrame:
    """Addresses that folding skips, with side, reason and number of rows."""
    seen = both_sides(flows).groupBy("side", "ip").agg(row_count(flows).alias("rows"))
    rejected = seen.where(f"ip IS NULL OR NOT {is_ipv4('ip')}")
    return rejected.selectExpr(
        "side", "ip", "CASE WHEN ip IS NULL THEN 'missing' ELSE 'not_ipv4' END AS reason", "rows")
