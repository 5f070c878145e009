"""IPv4 and CIDR expressions as Spark SQL text. Addresses are BIGINT in 0 .. 2^32 - 1.

Every function takes the SQL text of its operands, mostly a column name, and returns SQL text
for F.expr or selectExpr.
"""

from __future__ import annotations

# One decimal octet without leading zero; a whole dotted quad.
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"(?:{OCTET}[.]){{3}}{OCTET}"

_HEX = "[0-9a-fA-F]{1,4}"
# Texts that are no IPv4 address are spread over this many blocks of their own.
LOOSE_BLOCKS = 65536


def _ipv6_pattern() -> str:
    """Eight groups, or k groups, '::' and at most 7 - k groups; then an optional scope."""
    forms = [f"({_HEX}:){{7}}{_HEX}"]
    for left in range(8):
        head = f"{_HEX}(:{_HEX}){{{left - 1}}}" if left else ""
        room = 7 - left
        tail = f"({_HEX}(:{_HEX}){{0,{room - 1}}})?" if room else ""
        forms.append(f"{head}::{tail}")
    return f"({'|'.join(forms)})(%[^%]+)?"


IPV6 = _ipv6_pattern()


def is_ipv4(ip: str) -> str:
    return rf"({ip} RLIKE r'^{IPV4}\z')"


def is_ipv6(ip: str) -> str:
    # a dotted quad at the end stands for the last two groups
    grouped = rf"regexp_replace({ip}, r':{IPV4}(?=%|\z)', ':0:0')"
    return rf"({grouped} RLIKE r'^{IPV6}\z')"


def ip_to_long(ip: str) -> str:
    """Numeric address, null for anything but a strict dotted quad."""
    octets = [f"try_cast(get(split({ip}, r'\\.'), {i}) AS INT) * {256 ** (3 - i)}L" for i in range(4)]
    # the check is a term of its own because Spark splits the text only once outside a CASE
    return f"({' + '.join(octets)} + CASE WHEN {is_ipv4(ip)} THEN 0L END)"


def long_to_ip(addr: str) -> str:
    return "concat_ws('.', " + ", ".join(f"({addr} >> {s}) & 255" for s in (24, 16, 8, 0)) + ")"


def loose_block(text: str) -> str:
    """A negative block number for a text that is no IPv4 address."""
    return f"-1 - pmod(xxhash64({text}), {LOOSE_BLOCKS})"


def address_block(ip: str, addr: str) -> str:
    """The address's /16 (0 .. 65535), or a negative block for other texts; never null.

    The last literal tells the optimizer so. Without it, a join on the block would push a null
    check with the whole parsing below the distinct, on one side only, and the two sides of that
    join would no longer share one scan and shuffle of the log.
    """
    return f"coalesce({addr} >> 16, {loose_block(ip)}, -1L)"


def differing_bits(low: str, high: str) -> str:
    """Number of trailing bits in which two addresses differ; 0 when equal."""
    return f"CASE WHEN {low} = {high} THEN 0 ELSE length(bin({low} ^ {high})) END"


def clear_low_bits(addr: str, bits: str) -> str:
    return f"(({addr} >> {bits}) << {bits})"


def cidr_low(cidr: str) -> str:
    """First address of 'a.b.c.d/n', null when the text is no IPv4 CIDR."""
    return clear_low_bits(ip_to_long(_base(cidr)), _host_bits(cidr))


def cidr_high(cidr: str) -> str:
    return f"({cidr_low(cidr)} + (1L << {_host_bits(cidr)}) - 1)"


def _base(cidr: str) -> str:
    return f"substring_index({cidr}, '/', 1)"


def _host_bits(cidr: str) -> str:
    plen = rf"CASE WHEN {cidr} RLIKE r'^[^/]+/(3[0-2]|[12]?[0-9])\z' THEN try_cast(substring_index({cidr}, '/', -1) AS INT) END"
    return f"(32 - ({plen}))"
