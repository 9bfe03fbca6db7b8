"""Predicates on identifiers and addresses."""

from __future__ import annotations

import functools
import ipaddress
import operator
import re
import socket

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.functions.types import BOOLEAN

# IPv4 ranges that are not routed on the internet.
SPECIAL4 = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3")


def is_node_id(x: Column) -> Column:
    """B6"""
    return F.coalesce(F.octet_length(x) == 20, F.lit(False))


def ip4_number(ip: Column) -> Column:
    """A dotted quad of up to three digits each as a number, else null; leading zeros are allowed."""
    parts = F.transform(F.split(ip, r"\."), lambda p: F.try_to_number(p, F.lit("999")).cast("long"))
    good = ip.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & (F.array_max(parts) <= 255)
    return F.when(good, F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p))


def is_global_ip4(number: Column) -> Column:
    """B7"""
    inside = F.lit(False)
    for net in map(ipaddress.ip_network, SPECIAL4):
        inside = inside | number.between(int(net.network_address), int(net.broadcast_address))
    return ~inside


#: IPv6 global unicast, and the ranges in it that are not routed on the internet.
GLOBAL6 = "2000::/3"
SPECIAL6 = ("2001::/23", "2001:db8::/32", "2002::/16")
#: Ranges in the first of those that are routed after all.
ROUTED6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")


def _ranges(*nets: str) -> list[tuple[int, int]]:
    return [(int(n.network_address), int(n.broadcast_address)) for n in map(ipaddress.ip_network, nets)]


@F.pandas_udf(BOOLEAN)
def is_global_ip6(ips: pd.Series) -> pd.Series:
    """Inside the global range, and in none of its special ranges but the routed parts of these. Anything that is no address
    is not global."""

    def number(ip: str | None) -> int:
        try:
            return int.from_bytes(socket.inet_pton(socket.AF_INET6, ip or ""))
        except (OSError, ValueError):
            return 0

    known = ips.map(number)
    within = lambda nets: functools.reduce(operator.or_, (known.map(lambda x, a=a, b=b: a <= x <= b) for a, b in _ranges(*nets)))
    return (within([GLOBAL6]) & (~within(SPECIAL6) | within(ROUTED6))).astype(bool)


def is_routable_ip4(ip: Column, port: Column) -> Column:
    """B9 for IPv4, in built-in functions."""
    return F.coalesce(port.between(1, 65535) & is_global_ip4(ip4_number(ip)), F.lit(False))


def is_routable(ip: Column, port: Column) -> Column:
    """B9 for both families."""
    return F.when(is_ip6(ip), port.between(1, 65535) & is_global_ip6(ip)).otherwise(is_routable_ip4(ip, port))


def is_ip6(ip: Column) -> Column:
    """B22"""
    return F.contains(ip, F.lit(":"))


def is_foreign(node_id: Column, ip: Column, port: Column, own_suffixes: list[bytes], ip6: bool = False) -> Column:
    """A valid id that isn't ours, at a routable address of an enabled family."""
    ours = F.substring(node_id, 16, 5).isin([F.lit(s) for s in own_suffixes]) if own_suffixes else F.lit(False)
    return is_node_id(node_id) & ~ours & (is_routable(ip, port) if ip6 else ~is_ip6(ip) & is_routable_ip4(ip, port))


def announced_port(implied: Column, source: Column, port: Column) -> Column:
    """The source's port if implied, else the one announced if valid, else null."""
    return F.when(F.coalesce(implied, F.lit(0)) != 0, source).when(port.between(1, 65535), port)


# Sortable columns, and the bounds of a request.
SORTS = ("name", "size", "file_count", "seen_count", "announce_count", "last_seen")


def parse_search(params: dict[str, str]) -> dict[str, object]:
    """Query, limit, sort and order of a search request."""
    try:
        limit = int(params.get("limit", 20))
    except ValueError:
        limit = 20
    sort = params.get("sort") if params.get("sort") in SORTS else None
    order = params.get("order") if params.get("order") in ("asc", "desc") else ("asc" if sort == "name" else "desc")
    return {"query": params.get("q", "").strip()[:200], "limit": max(1, min(200, limit)), "sort": sort, "order": order}


def parse_hash(text: str) -> str | None:
    """40 hexadecimal digits in lower case, or None."""
    return text.lower() if re.fullmatch("[0-9a-fA-F]{40}", text) else None
