"""Columns over IPv4, IPv6 and MAC addresses given as text or numbers."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Registered IPv4 ranges and the class names given to them.
V4_CLASSES = (
    ("0.0.0.0/8", "reserved"), ("10.0.0.0/8", "private"), ("127.0.0.0/8", "loopback"), ("169.254.0.0/16", "link-local"),
    ("172.16.0.0/12", "private"), ("192.168.0.0/16", "private"), ("224.0.0.0/24", "multicast-local"),
    ("224.0.1.0/24", "multicast-internet"), ("232.0.0.0/8", "multicast-ssm"), ("233.0.0.0/8", "multicast-glop"),
    ("239.0.0.0/8", "multicast-admin"), ("224.0.0.0/4", "multicast-reserved"), ("255.255.255.255/32", "broadcast"), ("240.0.0.0/4", "reserved"),
)
#: Prefixes of IPv6 text forms and their class names.
V6_CLASSES = (("^::1$", "loopback"), ("^fe[89ab]", "link-local"), ("^f[cd]", "private"), ("^ff.1:", "multicast-local"), ("^ff", "multicast"), ("^2001:0?db8:", "documentation"))


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def span(cidr: str) -> tuple[int, int]:
    """First and last address of a range 'a.b.c.d/len' as numbers."""
    net = ipaddress.ip_network(cidr, strict=False)
    return int(net.network_address), int(net.broadcast_address)


def v4_number(text: str | Column) -> Column:
    """Number of a dotted IPv4 address; null for anything else."""
    t = _c(text)
    part = [F.try_to_number(F.regexp_extract(t, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i + 1), F.lit("999")).cast("bigint") for i in range(4)]
    value = part[0] * 16777216 + part[1] * 65536 + part[2] * 256 + part[3]
    return F.when(F.greatest(*part) <= 255, value)


def v4_text(number: str | Column) -> Column:
    n = _c(number)
    octet = lambda s: F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string")
    return F.when(n.isNotNull(), F.concat_ws(".", *(octet(s) for s in (24, 16, 8, 0))))


def v4_net(number: str | Column, length: int) -> Column:
    """Number with all but the leading ``length`` bits cleared."""
    return _c(number).bitwiseAND(F.lit((0xFFFFFFFF << (32 - length)) & 0xFFFFFFFF))


def net_text(number: str | Column, text: str | Column, length: int) -> Column:
    """'a.b.c.d/len' of an IPv4 address; other addresses stay whole."""
    return F.coalesce(F.concat(v4_text(v4_net(number, length)), F.lit(f"/{length}")), _c(text))


def v4_class(number: str | Column) -> Column:
    out = F.when(_c(number).isNotNull(), F.lit("unicast"))
    for cidr, name in reversed(V4_CLASSES):
        lo, hi = span(cidr)
        out = F.when(_c(number).between(lo, hi), F.lit(name)).otherwise(out)
    return out


def v6_class(text: str | Column) -> Column:
    t = _c(text)
    out = F.when(t.contains(":"), F.lit("unicast"))
    for pattern, name in reversed(V6_CLASSES):
        out = F.when(t.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def address_class(number: str | Column, text: str | Column) -> Column:
    return F.coalesce(v4_class(number), v6_class(text))


def range_to_cidrs(lo: int, hi: int) -> list[tuple[int, int]]:
    """The fewest (first address, prefix length) that cover lo..hi exactly."""
    return [(int(n.network_address), n.prefixlen) for n in ipaddress.summarize_address_range(ipaddress.IPv4Address(lo), ipaddress.IPv4Address(hi))]


def oui(mac: str | Column) -> Column:
    return F.lower(F.substring(_c(mac), 1, 8))


def mac_class(mac: str | Column) -> Column:
    """'bcast', 'mcast', 'local' (locally administered) or 'univ' from the first octet."""
    first = F.conv(F.substring(_c(mac), 1, 2), 16, 10).cast("int")
    bit = lambda b: first.bitwiseAND(F.lit(b)) == b
    return F.when(F.lower(_c(mac)) == "ff:ff:ff:ff:ff:ff", "bcast").when(bit(1), "mcast").when(bit(2), "local").when(first.isNotNull(), "univ")
