"""Access lists: ordered permit and deny lines, the first that fits decides, and the end denies."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as X


#: Words of an access list for flags of the TCP header, with their bits.
FLAGS = {"fin": 0x01, "syn": 0x02, "rst": 0x04, "psh": 0x08, "ack": 0x10, "urg": 0x20}
#: Words that change nothing about what is permitted.
PASSED_OVER = {"log", "log-input"}


@dataclass(frozen=True)
class Line:
    number: int
    permit: bool
    proto: int | None
    source: tuple[int, int] | None
    source_port: tuple[str, int, int] | None
    target: tuple[int, int] | None
    target_port: tuple[str, int, int] | None
    established: bool
    text: str
    flags: tuple[str, ...] = ()


def parse_policy(text: str) -> list[Line]:
    """Lines such as 'permit tcp 10.0.0.0 0.255.255.255 any eq 443 established'; masks are wildcards, 'host a' one address.

    After the ports may follow 'established' or flags of the TCP header (fin syn rst psh ack urg); a line with any other
    word is an error.
    """
    out = []
    for raw in text.splitlines():
        words = raw.split("!")[0].split()
        if words[:1] == ["access-list"]:
            words = words[2:]
        if not words or words[0] not in ("permit", "deny"):
            continue
        permit, proto, at = words[0] == "permit", words[1], 2

        def address() -> tuple[int, int] | None:
            nonlocal at
            if words[at] == "any":
                at += 1
                return None
            if words[at] == "host":
                at += 2
                return int(ipaddress.IPv4Address(words[at - 1])), 0xFFFFFFFF
            if "/" in words[at]:
                net = ipaddress.IPv4Network(words[at], strict=False)
                at += 1
                return int(net.network_address), int(net.netmask)
            value, wild = (int(ipaddress.IPv4Address(w)) for w in words[at : at + 2])
            at += 2
            return value & ~wild & 0xFFFFFFFF, ~wild & 0xFFFFFFFF

        def port() -> tuple[str, int, int] | None:
            nonlocal at
            if at >= len(words) or words[at] not in ("eq", "neq", "lt", "gt", "range"):
                return None
            op, first = words[at], words[at + 1]
            number = lambda w: int(w) if w.isdigit() else X.SERVICES[w]
            at += 3 if op == "range" else 2
            return op, number(first), number(words[at - 1])

        src = address()
        sport = port()
        dst = address()
        dport = port()
        rest = words[at:]
        unknown = set(rest) - {"established"} - set(FLAGS) - PASSED_OVER
        if unknown or (proto != "tcp" and set(rest) - PASSED_OVER):
            raise ValueError(f"cannot read {' '.join(sorted(unknown or rest))!r} in {raw.strip()!r}")
        number = None if proto == "ip" else int(proto) if re.fullmatch(r"\d+", proto) else X.PROTOCOLS[proto]
        out.append(Line(len(out) + 1, permit, number, src, sport, dst, dport, "established" in rest, " ".join(words), tuple(w for w in rest if w in FLAGS)))
    return out


def _flag(word: str, columns: set[str]) -> Column:
    """Whether a flow shows the flag: from the flags seen (stcpf) where a view has them, else from the status bits."""
    if "stcpf" in columns:
        return F.col("stcpf").bitwiseAND(F.lit(FLAGS[word])) != 0
    bits = {"syn": X.SYN, "ack": X.SYN_ACK | X.EST, "fin": X.FIN | X.FIN_ACK, "rst": X.RESET[0] | X.RESET[1]}
    if word not in bits:
        raise ValueError(f"{word!r} needs the column stcpf, which the records lack")
    return F.col("status").bitwiseAND(F.lit(bits[word])) != 0


def _fits(line: Line, columns: set[str]) -> Column:
    cond = F.lit(True)
    if line.proto is not None:
        cond &= F.col("proto") == line.proto
    for net, c in ((line.source, "saddr_i"), (line.target, "daddr_i")):
        if net:
            cond &= F.col(c).bitwiseAND(F.lit(net[1])) == net[0]
    for p, c in ((line.source_port, "sport"), (line.target_port, "dport")):
        if p:
            op, a, b = p
            cond &= {"eq": F.col(c) == a, "neq": F.col(c) != a, "lt": F.col(c) < a, "gt": F.col(c) > a, "range": F.col(c).between(a, b)}[op]
    if line.established:
        cond &= (F.col("proto") == 6) & (F.col("status").bitwiseAND(F.lit(X.EST | X.SYN_ACK)) != 0)
    for word in line.flags:
        cond &= _flag(word, columns)
    return F.coalesce(cond, F.lit(False))


def evaluate(df: DataFrame, lines: list[Line]) -> DataFrame:
    """Adds permitted (boolean) and acl_line: the number of the line that decided, 0 for the implicit deny at the end."""
    which, verdict = F.lit(0), F.lit(False)
    for line in reversed(lines):
        fits = _fits(line, set(df.columns))
        which, verdict = F.when(fits, line.number).otherwise(which), F.when(fits, F.lit(line.permit)).otherwise(verdict)
    return df.withColumns({"permitted": verdict, "acl_line": which})
