"""Catalogue of printable and computable fields: name -> SQL text over the flow view.

Stored fields stand for themselves. A field that the flow view does not store and that cannot be derived from it is a
typed null, as an absent section of a record is; a wider view that has the column serves it without further change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the TCP status.
SYN, SYN_ACK, EST, FIN, FIN_ACK, NORMAL_CLOSE, CLOSE_WAIT, REUSE = 1, 2, 4, 8, 16, 32, 64, 128
RETRANS, WINSHUT, RESET, ECN, OUT_OF_ORDER, DUPLICATES = (0x100, 0x200), (0x400, 0x800), (0x1000, 0x2000), (0x4000, 0x8000), (0x10000, 0x20000), (0x40000, 0x80000)

#: Names of IP protocols by number.
PROTOCOLS = {"icmp": 1, "igmp": 2, "tcp": 6, "udp": 17, "ipv6": 41, "rsvp": 46, "gre": 47, "esp": 50, "ah": 51, "ipv6-icmp": 58, "ospf": 89, "pim": 103, "sctp": 132, "udplite": 136}
#: Names of well-known services by port.
SERVICES = {"ftp-data": 20, "ftp": 21, "ssh": 22, "telnet": 23, "smtp": 25, "domain": 53, "http": 80, "pop3": 110, "ntp": 123, "imap": 143, "snmp": 161, "https": 443, "syslog": 514, "imaps": 993, "mdns": 5353}

STORED = (
    "autoid sid inf seq stime ltime stime_us ltime_us rtime dur proto saddr daddr saddr_i daddr_i sport dport trans spkts dpkts sbytes dbytes "
    "sappbytes dappbytes sloss dloss sttl dttl stos dtos status smac dmac inode sco dco sas das sloc dloc suser duser label"
).split()


def has(bits: int) -> str:
    return f"(status & {bits}) <> 0"


def _both(s: str, d: str) -> str:
    return f"(coalesce({s}, 0) + coalesce({d}, 0))"


def _per_second(x: str) -> str:
    return f"CASE WHEN dur > 0 THEN {x} / dur ELSE 0D END"


def _percent(part: str, whole: str) -> str:
    return f"100D * {part} / nullif({whole} + {part}, 0)"


def _hops(ttl: str) -> str:
    return f"CASE WHEN {ttl} <= 32 THEN 32 - {ttl} WHEN {ttl} <= 64 THEN 64 - {ttl} WHEN {ttl} <= 128 THEN 128 - {ttl} ELSE 255 - {ttl} END"


def _net(n: str, t: str, bits: int = 24) -> str:
    return f"CASE WHEN {n} IS NOT NULL THEN concat_ws('.', shiftright({n}, 24) & 255, shiftright({n}, 16) & 255, shiftright({n}, 8) & 255, '0/{bits}') ELSE {t} END"


def state_sql() -> str:
    """Principal state of a transaction, from the status bits for TCP and from the answers for the others."""
    return (
        f"CASE WHEN proto = 6 THEN CASE WHEN {has(RESET[0] | RESET[1])} THEN 'RST' WHEN {has(FIN_ACK)} OR {has(NORMAL_CLOSE)} THEN 'CLO' WHEN {has(FIN)} THEN 'FIN' "
        f"WHEN {has(EST)} THEN 'EST' WHEN {has(SYN_ACK)} THEN 'ACC' WHEN {has(SYN)} THEN 'REQ' ELSE 'CON' END "
        "WHEN coalesce(dpkts, 0) = 0 THEN 'INT' WHEN spkts = 1 AND dpkts = 1 THEN 'ACC' ELSE 'CON' END"
    )


def direction_sql() -> str:
    """Arrow of the transaction; the middle sign tells how it went."""
    middle = f"CASE WHEN proto <> 6 THEN '-' WHEN {has(RESET[0] | RESET[1])} THEN '|' WHEN {has(SYN | SYN_ACK | EST | FIN)} THEN '-' ELSE '?' END"
    return f"concat(CASE WHEN coalesce(dpkts, 0) > 0 AND (proto <> 6 OR NOT {has(SYN | SYN_ACK)}) THEN '<' ELSE ' ' END, {middle}, CASE WHEN coalesce(spkts, 0) > 0 OR coalesce(dpkts, 0) = 0 THEN '>' ELSE ' ' END)"


def _pair(bits: tuple[int, int], both: str, src: str, dst: str) -> str:
    return f"CASE WHEN proto <> 6 THEN ' ' WHEN {has(bits[0])} AND {has(bits[1])} THEN '{both}' WHEN {has(bits[0])} THEN '{src}' WHEN {has(bits[1])} THEN '{dst}' ELSE ' ' END"


def flags_sql() -> str:
    """Twelve columns of flags; those of sections that the view lacks are blank."""
    loss = _pair(RETRANS, "*", "s", "d")
    return f"concat(' e  ', CASE WHEN proto = 6 AND {has(REUSE)} THEN 'R' ELSE {loss} END, {_pair(OUT_OF_ORDER, '&', 'i', 'r')}, {_pair(WINSHUT, '@', 'S', 'D')}, {_pair(ECN, 'E', 'x', 't')}, '    ')"


DERIVED = {
    "bytes": _both("sbytes", "dbytes"), "pkts": _both("spkts", "dpkts"), "appbytes": _both("sappbytes", "dappbytes"), "loss": _both("sloss", "dloss"),
    "load": _per_second(_both("sbytes", "dbytes") + " * 8D"), "sload": _per_second("coalesce(sbytes, 0) * 8D"), "dload": _per_second("coalesce(dbytes, 0) * 8D"),
    "rate": _per_second(_both("spkts", "dpkts")), "srate": _per_second("coalesce(spkts, 0)"), "drate": _per_second("coalesce(dpkts, 0)"),
    "ploss": _percent(_both("sloss", "dloss"), _both("spkts", "dpkts")), "sploss": _percent("sloss", "spkts"), "dploss": _percent("dloss", "dpkts"),
    "pcr": f"(coalesce(sappbytes, 0) - coalesce(dappbytes, 0)) / cast(nullif({_both('sappbytes', 'dappbytes')}, 0) AS DOUBLE)",
    "smeansz": "sbytes / cast(nullif(spkts, 0) AS DOUBLE)", "dmeansz": "dbytes / cast(nullif(dpkts, 0) AS DOUBLE)",
    "shops": _hops("sttl"), "dhops": _hops("dttl"), "srcid": "sid", "loc": "greatest(sloc, dloc)",
    "soui": "lower(substring(smac, 1, 8))", "doui": "lower(substring(dmac, 1, 8))", "smacoui": "lower(substring(smac, 1, 8))", "dmacoui": "lower(substring(dmac, 1, 8))",
    "laddr": "CASE WHEN sloc >= dloc OR dloc IS NULL THEN saddr ELSE daddr END", "raddr": "CASE WHEN sloc >= dloc OR dloc IS NULL THEN daddr ELSE saddr END",
    "snet": _net("saddr_i", "saddr"), "dnet": _net("daddr_i", "daddr"), "state": state_sql(), "dir": direction_sql(), "flgs": flags_sql(), "type": "'far'",
    "sdsb": "cast(shiftright(stos, 2) AS STRING)", "ddsb": "cast(shiftright(dtos, 2) AS STRING)", "offset": "autoid", "runtime": "dur", "sum": "dur", "mean": "dur", "min": "dur", "max": "dur",
    "avgdur": "dur / nullif(trans, 0)", "stddev": "0D", "rank": "autoid - 1", "binnum": "cast(NULL AS BIGINT)", "hash": "xxhash64(saddr, daddr, proto, sport, dport)",
    "ind": "pmod(xxhash64(saddr, daddr, proto, sport, dport), 4096)", "etype": "CASE WHEN saddr_i IS NOT NULL THEN 'ipv4' WHEN saddr LIKE '%:%' THEN 'ipv6' END",
    "retrans": _both("sloss", "dloss"), "sretrans": "sloss", "dretrans": "dloss", "sstime": "stime", "sltime": "ltime", "sdur": "dur", "cause": "'status'",
}
DERIVED |= {"abr": DERIVED["pcr"], "svc": "get_json_object(label, '$.svc')", "mindur": "dur", "maxdur": "dur", "psretrans": DERIVED["sploss"], "pdretrans": DERIVED["dploss"]}
DERIVED["lnet"] = f"CASE WHEN sloc >= dloc OR dloc IS NULL THEN {DERIVED['snet']} ELSE {DERIVED['dnet']} END"
DERIVED["rnet"] = f"CASE WHEN sloc >= dloc OR dloc IS NULL THEN {DERIVED['dnet']} ELSE {DERIVED['snet']} END"
DERIVED["pretrans"], DERIVED["spretrans"], DERIVED["dpretrans"] = DERIVED["ploss"], DERIVED["sploss"], DERIVED["dploss"]


#: Fields of the catalogue that need sections the flow view does not have, by type.
ABSENT_FIELDS = {
    "DOUBLE": """
        sintpkt dintpkt sintpktact dintpktact sintpktidl dintpktidl sintpktmax sintpktmin dintpktmax dintpktmin
        sintpktactmax sintpktactmin dintpktactmax dintpktactmin sintpktidlmax sintpktidlmin dintpktidlmax dintpktidlmin
        sjit djit sjitact djitact sjitidl djitidl dldur dlstime dlltime pdspkts pddpkts pdsbytes pddbytes jdelay ldelay
        tcprtt ddur stcpmax dtcpmax synack ackdat pnacks spnacks dpnacks psolo spsolo dpsolo pfirst spfirst dpfirst
        idle tf stf dtf slat slon dlat dlon ilat ilon idlemean idlemin idlemax idlestddev intflow actintflow idleintflow
        intflowmax intflowmin intflowsdev actintflowmax actintflowmin actintflowsdev idleintflowmax idleintflowmin idleintflowsdev""",
    "STRING": """
        xxx tcpext senc denc bssid ssid tcpopt resp cor ico node sgrp dgrp sname dname smacclass dmacclass sgreaddr
        dgreaddr greproto sgenaddr dgenaddr genproto sencbuf dencbuf""",
    "INT": """
        dlspkt dldpkt dspkts ddpkts dsbytes ddbytes svlan dvlan svid dvid svpri dvpri sipid dipid smaxsz sminsz dmaxsz
        dminsz icmpid nacks snacks dnacks solo ssolo dsolo first sfirst dfirst sgap dgap svnid dvnid""",
    "SMALLINT": "swin dwin score smss dmss",
    "BIGINT": "bins smpls dmpls srng erng stcpb dtcpb ias nstroke snstroke dnstroke",
    "TIMESTAMP": "dstime dltime",
    "ARRAY<INT>": "spktsz dpktsz sintdist dintdist sintdistact dintdistact sintdistidl dintdistidl",
    "ARRAY<STRING>": "dsrs",
}
#: Names that are only metrics or only sort keys, of sections the view does not have either.
ABSENT_METRICS = {"DOUBLE": "psnacks pdnacks pssolo pdsolo psfirst pdfirst idlmean idlmin idlmax", "INT": "ipid sdup ddup smask dmask compare", "BIGINT": "tranref"}

ABSENT = {name: kind for kind, names in ABSENT_FIELDS.items() for name in names.split()}
OTHERS = {name: kind for kind, names in ABSENT_METRICS.items() for name in names.split()}
NAMES = (*STORED, *DERIVED, *ABSENT)


def sql(name: str, columns: set[str] | None = None) -> str:
    """SQL text of a field. ``columns``: those of the view at hand; one that is there serves as it is."""
    if columns and name in columns or name in STORED:
        return f"`{name}`"
    if name in DERIVED:
        return DERIVED[name]
    if name in ABSENT or name in OTHERS:
        return f"cast(NULL AS {ABSENT.get(name) or OTHERS[name]})"
    raise KeyError(f"no field {name!r}")


def field(name: str) -> Column:
    return F.expr(sql(name)).alias(name)


#: Letters of the TCP state and of the eight flags of the TCP header, lowest bit first.
STATE_LETTERS = (("s", SYN), ("S", SYN_ACK), ("E", EST), ("f", FIN), ("F", FIN_ACK), ("R", RESET[0] | RESET[1]))
FLAG_LETTERS = "FSRPAU78"


def state_letters(status: str | Column = "status") -> Column:
    """TCP state as the letters of its bits, 'sSEfF' for a connection that was opened and closed; null status has none."""
    c = F.coalesce(F.col(status) if isinstance(status, str) else status, F.lit(0))
    return F.concat(*(F.when(c.bitwiseAND(F.lit(bits)) != 0, letter).otherwise("") for letter, bits in STATE_LETTERS))


def flag_letters(flags: str | Column) -> Column:
    """Flags of the TCP header as letters; null flags have none."""
    c = F.coalesce(F.col(flags) if isinstance(flags, str) else flags, F.lit(0))
    return F.concat(*(F.when(c.bitwiseAND(F.lit(1 << i)) != 0, letter).otherwise("") for i, letter in enumerate(FLAG_LETTERS)))


def abbreviated(number: str | Column, precision: int = 2) -> Column:
    """A number in units of a thousand: '12.35M'; whole numbers below 1,000 stay as they are. Null stays null."""
    c = F.col(number) if isinstance(number, str) else number
    out = c.cast("string")
    for power, unit in enumerate("KMGTP", 1):
        out = F.when(F.abs(c) >= 1000**power, F.concat(F.call_function("format_number", c / 1000**power, F.lit(f"0.{'0' * precision}" if precision else "0")), F.lit(unit))).otherwise(out)
    return out


def payload(data: str | Column, form: str) -> Column:
    """Payload bytes as text: 'ascii' ('.' for what cannot be printed), 'obfuscate' (the same, what follows a password word
    as 'x'), 'hex', 'encode32' or 'encode64'."""
    c = F.col(data) if isinstance(data, str) else data
    plain = F.regexp_replace(F.decode(c, "ISO-8859-1"), r"[^\x20-\x7e]", ".")
    if form == "ascii":
        return plain
    if form == "obfuscate":
        return F.regexp_replace(plain, r"(?i)((?:pass(?:word|wd)?|login|auth)[ =:]+)[^ .]+", "$1xxxxx")
    if form == "encode32":
        # five bits a letter: the bytes' bits in groups of five, filled up with zeros, eight letters a group
        n = F.length(c)
        bits = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.lpad(F.bin(F.conv(F.hex(F.substring(c, i, F.lit(1))), 16, 10).cast("bigint")), 8, "0")), "")
        bits = F.rpad(bits, (F.ceil(n * 8 / 5) * 5).cast("int"), F.lit("0"))
        letters = F.array_join(F.transform(F.sequence(F.lit(1), F.ceil(n * 8 / 5).cast("int")), lambda i: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.conv(F.substring(bits, (i - 1) * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))), "")
        return F.when(n == 0, "").otherwise(F.rpad(letters, (F.ceil(n / 5) * 8).cast("int"), F.lit("=")))
    return {"hex": F.hex, "encode64": F.base64}[form](c)


def select_fields(df: DataFrame, spec: str) -> DataFrame:
    """Projection by a list as in 'stime saddr:10 +bytes -dur': a name sets, '+' adds, '-' removes, '+#n' inserts at n.

    A width cuts the text and marks the cut with '*'. The list starts from the default fields if its first entry has a
    sign and from nothing otherwise.
    """
    items = spec.split()
    chosen: list[tuple[str, int]] = [(n, 0) for n in "stime proto saddr sport dir daddr dport pkts bytes state".split()] if items and items[0][0] in "+-" else []
    for item in items:
        sign = item[0] if item[0] in "+-" else ""
        body = item[len(sign) :]
        at = len(chosen)
        if body.startswith("#"):
            digits = "".join(c for c in body[1:3] if c.isdigit())
            at, body = int(digits), body[1 + len(digits) :]
        name, _, width = body.partition(":")
        if sign == "-":
            chosen = [c for c in chosen if c[0] != name]
        else:
            chosen.insert(at, (name, int(width.partition(":")[0] or 0)))
    columns = set(df.columns)
    out = []
    for name, width in chosen:
        c = F.expr(sql(name, columns))
        if width:
            text = c.cast("string")
            c = F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("*"))).otherwise(text)
        out.append(c.alias(name))
    return df.select(*out)
