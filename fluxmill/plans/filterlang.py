"""Filter language over flow records, compiled to one Column.

    tcp and dst port 443 and bytes gt 1000
    not host 10.0.0.1 and 10.0.0.2           the second address repeats "host"; "not" belongs to the first only
    src net 10.0.0.0/8 or udp port domain    "and" and "or" have equal precedence and group from the left

Logic is two-valued: a test on a missing value is false, and "lt", "lte" and "neq" are the negations of "gte", "gt" and
"eq", so they hold on missing values. Negation is driven inward to the tests, and only negated tests are wrapped against
null, so that all others reach the Parquet reader as they are. Without "src" or "dst" a test may hold for either side.
"""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as X

_TOKEN = re.compile(r"\s*(?:(\()|(\))|(<<|>>|!=|<=|>=|==|=|<|>|!(?=[\s(\w]))|(&&|\|\|)|\"([^\"]*)\"|([^\s()<>=!]+))")

#: Fixed values, down to RECORD_TYPES: the words of the language.
RELATIONS = {"eq": "=", "equal": "=", "=": "=", "==": "=", "neq": "!=", "notequal": "!=", "!=": "!=", "lt": "<", "less": "<", "<": "<", "lte": "<=", "<=": "<=", "gt": ">", "greater": ">", ">": ">", "gte": ">=", ">=": ">="}
LINKS = ("ether", "link", "arp", "rarp", "ip", "ipv4", "ipv6", "vlan", "mpls", "vxlan", "gre", "geneve", "isis", "rtp", "rtcp", "udt", "fddi", "ppp", "slip")
#: Word -> (source field, destination field) of tests on a number; one name where direction does not matter.
NUMBERS: dict[str, tuple[str, ...]] = {
    "port": ("sport", "dport"), "ttl": ("sttl", "dttl"), "tos": ("stos", "dtos"), "loc": ("sloc", "dloc"), "as": ("sas", "das"), "asn": ("sas", "das"), "loss": ("sloss", "dloss"),
    "pkt": ("spkts", "dpkts"), "pkts": ("spkts", "dpkts"), "byte": ("sbytes", "dbytes"), "bytes": ("sbytes", "dbytes"), "data": ("sappbytes", "dappbytes"), "appbyte": ("sappbytes", "dappbytes"),
    "appbytes": ("sappbytes", "dappbytes"), "rate": ("srate", "drate"), "load": ("sload", "dload"), "ploss": ("sploss", "dploss"), "dur": ("dur",), "avgdur": ("avgdur",), "trans": ("trans",),
    "count": ("trans",), "seq": ("seq",), "pcr": ("pcr",), "pcratio": ("pcr",), "abr": ("abr",), "abratio": ("abr",), "dsb": ("sdsb", "ddsb"), "dsbyte": ("sdsb", "ddsb"), "vid": ("svid", "dvid"),
    "vpri": ("svpri", "dvpri"), "mid": ("smpls", "dmpls"), "ipid": ("sipid", "dipid"), "masklen": ("smask", "dmask"), "mlen": ("smask", "dmask"), "gap": ("sgap", "dgap"), "maxseg": ("smaxsz", "dmaxsz"),
    "nstroke": ("snstroke", "dnstroke"), "nstrokes": ("snstroke", "dnstroke"), "tcpb": ("stcpb", "dtcpb"), "base": ("stcpb", "dtcpb"), "tcprtt": ("tcprtt",), "intflow": ("intflow",),
    "intflowsdev": ("intflowsdev",), "inter": ("sintpkt", "dintpkt"), "intpkt": ("sintpkt", "dintpkt"), "intpktact": ("sintpktact", "dintpktact"), "intpktidle": ("sintpktidl", "dintpktidl"),
    "jit": ("sjit", "djit"), "jitter": ("sjit", "djit"), "jitact": ("sjitact", "djitact"), "jitidle": ("sjitidl", "djitidl"), "deldur": ("dldur",), "delltime": ("dlltime",), "delstime": ("dlstime",),
    "lat": ("slat", "dlat"), "lon": ("slon", "dlon"), "spi": ("spi",), "len": ("bytes",), "length": ("bytes",), "hops": ("shops", "dhops"), "dup": ("sdup", "ddup"),
}
FLOATS = {"rate", "load", "ploss", "dur", "avgdur", "pcr", "pcratio", "abr", "abratio", "lat", "lon", "jit", "jitter", "inter", "intpkt", "intflow", "intflowsdev", "deldur", "delltime", "delstime", "tcprtt"}
PRECISION = 6
#: Word -> (source field, destination field) of tests on a text.
TEXTS = {"co": ("sco", "dco"), "cocode": ("sco", "dco"), "srcid": ("sid",), "sid": ("sid",), "inf": ("inf",), "inode": ("inode",), "node": ("node",), "encaps": ("senc", "denc"), "class": ("smacclass", "dmacclass"), "macclass": ("smacclass", "dmacclass")}
#: State word -> (bits for either side, source bits, destination bits) of the TCP status.
TCP_STATES = {
    "syn": X.SYN, "synack": X.SYN_ACK, "est": X.EST, "con": X.EST, "avail": X.EST, "fin": X.FIN, "finack": X.FIN_ACK, "normal": X.NORMAL_CLOSE, "wait": X.CLOSE_WAIT, "reuse": X.REUSE,
    "rst": X.RESET, "reset": X.RESET, "retrans": X.RETRANS, "drop": X.RETRANS, "winshut": X.WINSHUT, "ecn": X.ECN, "outoforder": X.OUT_OF_ORDER, "ooo": X.OUT_OF_ORDER,
}
#: Bits of the TCP header's flags, which a view may have seen per direction in the columns stcpf and dtcpf.
TCP_FLAGS = {"push": 0x08, "ack": 0x10, "urg": 0x20, "ece": 0x40, "cwr": 0x80}
#: Word -> (ICMP types, ICMP code or None); needs the columns icmp_type and icmp_code.
ICMP_TYPES = {
    "echo": ((0, 8), None), "unreach": ((3,), None), "unr": ((3,), None), "redirect": ((5,), None), "timexed": ((11,), None),
    "unrnet": ((3,), 0), "unrhost": ((3,), 1), "unrproto": ((3,), 2), "unrport": ((3,), 3), "unrfrag": ((3,), 4), "unrsrcfail": ((3,), 5), "unrnetunk": ((3,), 6), "unrhostunk": ((3,), 7),
    "unriso": ((3,), 8), "unrnetpro": ((3,), 9), "unrhostpro": ((3,), 10), "unrnettos": ((3,), 11), "unrhosttos": ((3,), 12), "unrfilter": ((3,), 13), "unrhostpre": ((3,), 14), "unrnetpre": ((3,), 15),
}
#: Words for tests on sections that a view may have as a true/false column of that name; without it they are an error.
SWITCHES = "anon auth recurs req rsp frag fragonly multipath mpath timeout cor corolated icmpmap rtr mbr lvg hello lsp csnp psnp tcpopt mss wscale selackok selack tcpecho tcpechoreply tcptimestamp tcpcc tcpccnew tcpccecho secn decn index baseline match svc".split()
RECORD_TYPES = {"man": "man", "mar": "man", "far": "far", "event": "event", "start": "start", "init": "start", "stop": "stop", "shut": "shutdown", "error": "error", "status": "status"}


class FilterError(ValueError):
    """A text that the language does not allow."""


@dataclass(frozen=True)
class Qualifiers:
    proto: str | None = None
    side: str | None = None
    kind: str | None = None


@dataclass(frozen=True)
class Test:
    """SQL of one test; null counts as false."""

    sql: str


@dataclass(frozen=True)
class Not:
    a: object


@dataclass(frozen=True)
class Join:
    op: str
    parts: tuple


def any_of(*parts: object) -> object:
    return parts[0] if len(parts) == 1 else Join("OR", parts)


def all_of(*parts: object) -> object:
    return parts[0] if len(parts) == 1 else Join("AND", parts)


def render(node: object, negated: bool = False) -> str:
    if isinstance(node, Not):
        return render(node.a, not negated)
    if isinstance(node, Join):
        op = {"AND": "OR", "OR": "AND"}[node.op] if negated else node.op
        return "(" + f" {op} ".join(render(p, negated) for p in node.parts) + ")"
    return f"NOT coalesce({node.sql}, false)" if negated else f"({node.sql})"


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FilterError(f"cannot read {text[at:]!r}")
        word = next(g for g in m.groups() if g is not None)
        out.append({"&&": "and", "||": "or", "!": "not"}.get(word, word))
        at = m.end()
    return out


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(word: str) -> float | int | None:
    m = re.fullmatch(r"(-?(?:0x[0-9a-fA-F]+|\d+(?:\.\d*)?(?:[eE][-+]?\d+)?|\.\d+))([kKmMgGbBuU]?)", word)
    if not m:
        return None
    value = int(m[1], 16) if "0x" in m[1] else float(m[1]) if re.search(r"[.eE]", m[1]) else int(m[1])
    return value * {"": 1, "k": 1000, "m": 10**6, "g": 10**9, "b": 10**9, "u": 1e-6}[m[2].lower()]


def _v6(column: str, net: ipaddress.IPv6Network) -> str:
    """Test on the text of an address in any spelling: its 16-bit groups, as far as the prefix reaches, are compared as numbers."""
    left = f"filter(split(split_part({column}, '::', 1), ':'), x -> x <> '')"
    right = f"CASE WHEN contains({column}, '::') THEN filter(split(split_part({column}, '::', 2), ':'), x -> x <> '') ELSE array() END"
    groups = f"transform(concat({left}, array_repeat('0', 8 - size({left}) - size({right})), {right}), x -> cast(conv(x, 16, 10) AS INT))"
    wanted, length = [int(g, 16) for g in net.network_address.exploded.split(":")], net.prefixlen
    tests = [f"contains({column}, ':')"]
    if length:
        whole = wanted[: length // 16]
        if whole:
            tests.append(f"slice({groups}, 1, {len(whole)}) = array({', '.join(map(str, whole))})")
        if length % 16:
            mask = 0xFFFF << (16 - length % 16) & 0xFFFF
            tests.append(f"get({groups}, {length // 16}) & {mask} = {wanted[length // 16] & mask}")
    return " AND ".join(tests)


class Parser:
    def __init__(self, text: str, columns: set[str] | None = None) -> None:
        self.words, self.at, self.columns, self.last = _tokens(text), 0, columns, Qualifiers()
        self.last_relation = "="

    def peek(self, ahead: int = 0) -> str:
        return self.words[self.at + ahead].lower() if self.at + ahead < len(self.words) else ""

    def next(self) -> str:
        if self.at >= len(self.words):
            raise FilterError("the filter ends too early")
        self.at += 1
        return self.words[self.at - 1]

    def parse(self) -> object:
        node = self.expression()
        if self.at < len(self.words):
            raise FilterError(f"unexpected {self.words[self.at]!r}; tests are joined by 'and' or 'or'")
        return node

    def expression(self) -> object:
        node = self.term()
        while self.peek() in ("and", "or"):
            op = self.next().upper()
            node = Join(op, (node, self.term()))
        return node

    def term(self) -> object:
        if self.peek() == "not":
            self.next()
            return Not(self.term())
        if self.peek() == "(":
            self.next()
            node = self.expression()
            if self.next() != ")":
                raise FilterError("a parenthesis is not closed")
            return node
        return self.primitive()

    # --- one test

    def primitive(self) -> object:
        word = self.peek()
        if self.is_arithmetic():
            return self.arithmetic()
        q, given = Qualifiers(), False
        if word in X.PROTOCOLS or word in LINKS:
            q, given = replace(q, proto=self.next().lower()), True
            if self.peek() in ("multicast", "broadcast"):
                return self.cast(self.next().lower(), q)
        if self.peek() in ("src", "dst", "lcl", "rem", "rmt"):
            q, given = replace(q, side=self.side()), True
        word = self.peek()
        if word in TCP_STATES:
            return self.state(self.next().lower(), q)
        if word in TCP_FLAGS:
            return self.flag(self.next().lower(), q)
        if word in ("host", "addr", "net", "proto", "gateway") or word in NUMBERS or word in TEXTS:
            q, given = replace(q, kind=self.next().lower()), True
        elif not given:
            if word in ("multicast", "broadcast", "local", "remote", "inbound", "outbound") or word in SWITCHES or word in RECORD_TYPES or word in ICMP_TYPES:
                return self.special(self.next().lower())
            if word in ("lat", "lon"):
                raise FilterError(word)
        if q.kind is None and given and (self.at >= len(self.words) or self.peek() in ("and", "or", ")", "")):
            if q.side:
                raise FilterError("a side needs a test")
            return self.protocol(q.proto)
        if not given:
            q = self.last
        elif q.proto in LINKS and q.kind is None and q.side is None and self.peek() in X.PROTOCOLS:
            return all_of(self.protocol(q.proto), self.protocol(self.next().lower()))
        return self.value(q)

    def side(self) -> str:
        names = {"src": "src", "dst": "dst", "lcl": "lcl", "rem": "rmt", "rmt": "rmt"}
        first = names[self.next().lower()]
        if self.peek() in ("or", "and") and self.peek(1) in names and names[self.peek(1)] != first:
            op = self.next().lower()
            self.next()
            return op if first in ("src", "dst") else "l" + op
        return first

    def value(self, q: Qualifiers) -> object:
        relation = None
        if self.peek() in RELATIONS:
            relation = RELATIONS[self.next().lower()]
        word = self.next()
        self.last = q
        kind = q.kind
        if kind is None and relation is None and _number(word) is not None and not re.fullmatch(r"\d+\.\d+\.\d+\.\d+", word):
            raise FilterError(f"number {word} without a field")
        if kind in NUMBERS:
            node = self.compare(q, relation or "=", word)
        elif kind in TEXTS:
            node = self.sides(q, TEXTS[kind], lambda c: f"{X.sql(c, self.columns)} {'=' if relation in (None, '=') else relation} {_quote(word)}")
        elif kind == "proto":
            n = _number(word)
            node = Test(f"proto = {int(n) if n is not None else self.protocol_number(word.lower())}")
        elif kind == "gateway":
            mac = _quote(word.lower())
            return all_of(any_of(Test(f"lower(smac) = {mac}"), Test(f"lower(dmac) = {mac}")))
        else:
            node = self.address(q, word)
        return all_of(self.protocol(q.proto), node) if q.proto and kind != "port" else node

    def protocol_number(self, name: str) -> int:
        if name not in X.PROTOCOLS:
            raise FilterError(f"no protocol {name!r}")
        return X.PROTOCOLS[name]

    def protocol(self, name: str | None) -> object:
        if name in ("ip", None):
            return Test("saddr_i IS NOT NULL OR saddr LIKE '%:%'")
        if name == "ipv4":
            return Test("saddr_i IS NOT NULL OR daddr_i IS NOT NULL")
        if name == "ipv6":
            return Test("saddr LIKE '%:%' OR daddr LIKE '%:%'")
        if name == "icmp":
            return Test("proto IN (1, 58)")
        if name in ("ether", "link"):
            return Test("true") if name == "link" else Test("smac IS NOT NULL OR dmac IS NOT NULL")
        if name in X.PROTOCOLS:
            return Test(f"proto = {X.PROTOCOLS[name]}")
        return Test(f"{X.sql('etype', self.columns)} = '{name}'")

    def sides(self, q: Qualifiers, names: tuple[str, ...], test) -> object:
        made = [Test(test(n)) if isinstance(test(n), str) else test(n) for n in names]
        if len(made) == 1 or q.side == "src":
            return made[0]
        if q.side == "dst":
            return made[1]
        if q.side in ("lcl", "rmt"):
            local = Test("coalesce(sloc, 0) >= coalesce(dloc, 0)")
            first, second = made if q.side == "lcl" else reversed(made)
            return any_of(all_of(local, first), all_of(Not(local), second))
        return all_of(*made) if q.side in ("and", "land") else any_of(*made)

    def compare(self, q: Qualifiers, relation: str, word: str) -> object:
        names = NUMBERS[q.kind]
        if q.kind == "port":
            return self.port(q, relation, word)
        value = _number(word)
        if value is None:
            raise FilterError(f"{q.kind} needs a number, not {word!r}")
        spi = q.kind == "spi"

        def test(name: str) -> object:
            c = "cast(NULL AS BIGINT)" if spi and not (self.columns and name in self.columns) else X.sql(name, self.columns)
            if q.kind in FLOATS:
                c, v = f"round({c}, {PRECISION})", f"{round(float(value), PRECISION)!r}D"
            else:
                v = repr(int(value) if float(value).is_integer() else float(value))
            base, negate = {"<": (">=", True), "<=": (">", True), "!=": ("=", True)}.get(relation, (relation, False))
            t: object = Test(f"{c} {base} {v}")
            if q.kind in ("ttl", "tos"):
                t = Not(t) if negate else t
                return all_of(self.protocol("ipv4"), t)
            return Not(t) if negate else t

        return self.sides(q, names, test)

    def port(self, q: Qualifiers, relation: str, word: str) -> object:
        m = re.fullmatch(r"(\d+)-(\d+)", word)
        n = _number(word)
        if m:
            low, high = int(m[1]), int(m[2])
        elif n is not None:
            low = high = int(n)
        elif word.lower() in X.SERVICES:
            low = high = X.SERVICES[word.lower()]
        else:
            raise FilterError(f"no service {word!r}")
        protos = {None: "6, 17", "ip": "6, 17", "ipv4": "6, 17", "ipv6": "6, 17"}.get(q.proto) or str(self.protocol_number(q.proto))
        base, negate = {"<": (">=", True), "<=": (">", True), "!=": ("=", True)}.get(relation, (relation, False))

        def test(name: str) -> object:
            t: object = Test(f"{name} BETWEEN {low} AND {high}" if base == "=" else f"{name} {base} {low}")
            return all_of(Test(f"proto IN ({protos})"), Not(t) if negate else t)

        node = self.sides(q, ("sport", "dport"), test)
        return all_of(self.protocol(q.proto), node) if q.proto in ("ipv4", "ipv6") else node

    def address(self, q: Qualifiers, word: str) -> object:
        if self.peek() == "mask":
            self.next()
            word = f"{word}/{self.next()}"
        if re.fullmatch(r"[0-9a-fA-F]{1,2}([:-][0-9a-fA-F]{1,2}){5}", word):
            mac = _quote(":".join(x.zfill(2) for x in re.split("[:-]", word.lower())))
            return self.sides(q, ("smac", "dmac"), lambda c: f"lower({c}) = {mac}")
        if re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", word):
            return Test(f"sid = {_quote(word)}")
        if q.proto is None and q.side is None and q.kind is None and word.lower() in X.PROTOCOLS:
            return self.protocol(word.lower())
        try:
            net = ipaddress.ip_network(word, strict=False)
        except ValueError:
            raise FilterError(f"no address {word!r}") from None
        if net.version == 6:
            return self.sides(q, ("saddr", "daddr"), lambda c: _v6(c, net))
        lo, hi = int(net.network_address), int(net.broadcast_address)
        return self.sides(q, ("saddr_i", "daddr_i"), lambda c: f"{c} = {lo}" if lo == hi else f"{c} BETWEEN {lo} AND {hi}")

    def state(self, word: str, q: Qualifiers) -> object:
        bits = TCP_STATES[word]
        tcp = Test("proto = 6")
        if isinstance(bits, int):
            return all_of(tcp, Test(f"(status & {bits}) = {bits}"))
        return all_of(tcp, self.sides(q, bits, lambda b: f"(status & {b}) = {b}"))

    def need(self, word: str, *columns: str) -> None:
        if not set(columns) <= (self.columns or set()):
            raise FilterError(f"{word!r} needs {' and '.join(columns)}, which the records lack")

    def flag(self, word: str, q: Qualifiers) -> object:
        self.need(word, "stcpf", "dtcpf")
        return all_of(Test("proto = 6"), self.sides(q, ("stcpf", "dtcpf"), lambda c: f"({c} & {TCP_FLAGS[word]}) <> 0"))

    def cast(self, word: str, q: Qualifiers) -> object:
        if q.proto in ("ether", "link"):
            pattern = "ff:ff:ff:ff:ff:ff" if word == "broadcast" else "33:33:%"
            return any_of(*(Test(f"lower({c}) LIKE '{pattern}'") for c in ("smac", "dmac")))
        low, high = (0xFFFFFFFF, 0xFFFFFFFF) if word == "broadcast" else (0xE0000000, 0xEFFFFFFF)
        return any_of(*(Test(f"{c} BETWEEN {low} AND {high}") for c in ("saddr_i", "daddr_i")))

    def special(self, word: str) -> object:
        if word in ("multicast", "broadcast"):
            return self.cast(word, Qualifiers("ip"))
        if word in ("local", "remote"):
            op = ">=" if word == "local" else "<"
            return all_of(Test(f"sloc {op} 3"), Test(f"dloc {op} 3"))
        if word in ("inbound", "outbound"):
            far, near = ("sloc", "dloc") if word == "inbound" else ("dloc", "sloc")
            return all_of(Test(f"{far} < 3"), Test(f"{near} >= 3"))
        if word in ICMP_TYPES:
            types, code = ICMP_TYPES[word]
            self.need(word, *(("icmp_type",) if code is None else ("icmp_type", "icmp_code")))
            return all_of(Test("proto = 1"), Test(f"icmp_type IN ({', '.join(map(str, types))})"), *([Test(f"icmp_code = {code}")] if code is not None else []))
        if word in RECORD_TYPES:
            return Test(f"{X.sql('type', self.columns)} = '{RECORD_TYPES[word]}'" if word not in ("start", "init", "stop", "status", "shut", "error") else f"{X.sql('cause', self.columns)} = '{RECORD_TYPES[word]}'")
        if word not in (self.columns or ()):
            raise FilterError(f"{word!r} needs a column of that name, which the records lack")
        return Test(word)

    # --- arithmetic over named fields: "sbytes + dbytes > 100 * spkts"

    def is_arithmetic(self) -> bool:
        return self.peek() in X.NAMES and self.peek() not in NUMBERS and self.peek() not in TEXTS and self.peek() not in TCP_STATES and self.peek(1) in ("+", "-", "*", "/", "&", "|", "<<", ">>", *RELATIONS)

    def sum_of(self) -> str:
        out = []
        while self.at < len(self.words) and self.peek() not in ("and", "or", ")") and self.peek() not in RELATIONS:
            word = self.next()
            if word in ("+", "-", "*", "/", "&", "|", "<<", ">>"):
                out.append(word)
            elif _number(word) is not None:
                out.append(repr(_number(word)))
            elif word.lower() in X.NAMES:
                out.append(X.sql(word.lower(), self.columns))
            else:
                raise FilterError(f"no field {word!r}; offsets into raw bytes are not offered")
        if not out:
            raise FilterError("an expression is empty")
        return "(" + " ".join(out) + ")"

    def arithmetic(self) -> object:
        left = self.sum_of()
        if self.peek() not in RELATIONS:
            raise FilterError("an expression needs a comparison")
        relation = RELATIONS[self.next().lower()]
        right = self.sum_of()
        base, negate = {"<": (">=", True), "<=": (">", True), "!=": ("=", True)}.get(relation, (relation, False))
        t: object = Test(f"{left} {base} {right}")
        return Not(t) if negate else t


def compile_filter(text: str, columns: set[str] | None = None) -> Column:
    """Column of a filter text; the empty text lets everything pass. ``columns``: columns of the view beyond the usual."""
    return F.expr(compile_sql(text, columns))


def compile_sql(text: str, columns: set[str] | None = None) -> str:
    return render(Parser(text, columns).parse()) if text.strip() else "true"


def where(df: DataFrame, text: str) -> DataFrame:
    return df.where(compile_filter(text, set(df.columns)))
