"""Small single-machine models that the Spark results are compared with."""

from __future__ import annotations

import ipaddress


def fold(texts: list[str]) -> list[str]:
    """Networks of a set of IPv4 texts, in order."""
    numbers = sorted({int(ipaddress.IPv4Address(t)) for t in texts})
    runs: list[list[int]] = []
    for n in numbers:
        if runs and n - runs[-1][-1] <= 256:
            runs[-1].append(n)
        else:
            runs.append([n])
    return [net for run in runs for net in enclose(run)]


def enclose(run: list[int]) -> list[str]:
    bits = (run[0] ^ run[-1]).bit_length()
    if bits <= 16:
        return [str(ipaddress.ip_network((run[0], 32 - bits), strict=False))]
    half = len(run) // 2
    return enclose(run[:half]) + enclose(run[half:])


def label(texts: list[str]) -> dict[str, str]:
    networks = [ipaddress.ip_network(n) for n in fold(texts)]
    return {t: str(next(n for n in networks if ipaddress.ip_address(t) in n)) for t in texts}
