"""Queries over the flow view, one or more for each operator, with SQL that gives the same rows."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import addresses, fields, timerange
from ..operators import anonymize, bins, cluster, histogram, inventory, labels, lookups, policy, sorting
from ..sources import sinks
from ..sources.flows import both_ways, flows, normalised, one_way, reverse, strip
from ..sources.tables import table
from .filterlang import where
from .registry import core

VIEW = """f AS (SELECT * REPLACE (lower(trim(saddr)) AS saddr, lower(trim(daddr)) AS daddr, CASE WHEN spkts <> -1 THEN spkts END AS spkts,
  CASE WHEN dpkts <> -1 THEN dpkts END AS dpkts, CASE WHEN sbytes <> -1 THEN sbytes END AS sbytes, CASE WHEN dbytes <> -1 THEN dbytes END AS dbytes) FROM argus)"""
SUMS = cluster.SUMS
MERGED = "cast(sum(coalesce(trans, 1)) AS BIGINT) AS trans, min(stime_us) AS stime_us, max(ltime_us) AS ltime_us, (max(ltime_us) - min(stime_us)) / 1e6 AS dur, " + ", ".join(f"cast(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in SUMS) + ", bit_or(status) AS status"
TOTALS = "count(*) AS records, cast(coalesce(sum(spkts), 0) + coalesce(sum(dpkts), 0) AS BIGINT) AS pkts, cast(coalesce(sum(spkts), 0) AS BIGINT) AS spkts, cast(coalesce(sum(dpkts), 0) AS BIGINT) AS dpkts, cast(coalesce(sum(sbytes), 0) + coalesce(sum(dbytes), 0) AS BIGINT) AS bytes, cast(coalesce(sum(sbytes), 0) AS BIGINT) AS sbytes, cast(coalesce(sum(dbytes), 0) AS BIGINT) AS dbytes"
V4 = "(saddr_i IS NOT NULL OR daddr_i IS NOT NULL)"
IP = "(saddr_i IS NOT NULL OR saddr LIKE '%:%')"


def sql(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join((VIEW, *ctes)) + "\n" + select


def add(name: str, text: str | None, make) -> None:
    core(name, text)(make)


def on_flows(name: str, text: str | None, make) -> None:
    add(name, text, lambda spark, d: make(flows(spark, d)))


# --- flagship: filter, aggregate, sort, limit
on_flows(
    "flagship",
    sql(f"""SELECT saddr, daddr, proto, bytes, pkts, trans FROM (SELECT saddr, daddr, proto, cast(sum(coalesce(sbytes, 0) + coalesce(dbytes, 0)) AS BIGINT) AS bytes,
  cast(sum(coalesce(spkts, 0) + coalesce(dpkts, 0)) AS BIGINT) AS pkts, cast(sum(trans) AS BIGINT) AS trans FROM f WHERE proto = 6 AND dport = 443 AND (sbytes > 1000 OR dbytes > 1000) GROUP BY ALL)
  ORDER BY bytes DESC, saddr, daddr LIMIT 10"""),
    lambda f: cluster.cluster(where(f, "tcp and dst port 443 and bytes gt 1000"), "saddr daddr proto").select("saddr", "daddr", "proto", (F.col("sbytes") + F.col("dbytes")).alias("bytes"), (F.col("spkts") + F.col("dpkts")).alias("pkts"), "trans").orderBy(F.desc("bytes"), "saddr", "daddr").limit(10),
)

# --- filters: name, filter text, the same condition in SQL
FILTERS = {
    "f1_keywords": ("tcp and dst port 443 and bytes gt 1000", "proto = 6 AND dport = 443 AND (sbytes > 1000 OR dbytes > 1000)"),
    "f2_precedence": ("udp or tcp and dst port 80", "(proto = 17 OR proto = 6) AND (dport = 80 AND proto IN (6, 17))"),
    "f2_not": ("not udp and not port 80 or icmp", "(proto IS DISTINCT FROM 17 AND NOT coalesce(proto IN (6, 17) AND (coalesce(sport = 80, false) OR coalesce(dport = 80, false)), false)) OR proto IN (1, 58)"),
    "f3_inheritance": ("tcp dst port ftp or domain or 8080 or 443", "proto = 6 AND dport IN (21, 53, 8080, 443)"),
    "f4_direction_or": ("src or dst net 10.0.0.0/16", "saddr_i BETWEEN 167772160 AND 167837695 OR daddr_i BETWEEN 167772160 AND 167837695"),
    "f4_direction_and": ("src and dst bytes gt 5000", "sbytes > 5000 AND dbytes > 5000"),
    "f5_missing": ("src ttl lt 60 and dst pkts neq 0", f"{V4} AND NOT coalesce(sttl >= 60, false) AND NOT coalesce(dpkts = 0, false)"),
    "f5_float": ("dur gte 1.5 and rate lt 10", "round(dur, 6) >= 1.5 AND (NOT coalesce(round(CASE WHEN dur > 0 THEN coalesce(spkts, 0) / dur ELSE 0 END, 6) >= 10, false) OR NOT coalesce(round(CASE WHEN dur > 0 THEN coalesce(dpkts, 0) / dur ELSE 0 END, 6) >= 10, false))"),
    "f6_host": ("host 10.250.0.7 and not dst net 198.18.0.0/16", "(saddr_i = 184156167 OR daddr_i = 184156167) AND NOT coalesce(daddr_i BETWEEN 3323068416 AND 3323133951, false)"),
    "f6_ipv6": ("src net 2001:db8:fa::/48 or dst host 2001:db8:fb::443", "saddr LIKE '2001:db8:fa:%' OR daddr = '2001:db8:fb::443'"),
    "f7_ports": ("udp and port 100-200 or dst port ssh", "(proto = 17 AND (sport BETWEEN 100 AND 200 OR dport BETWEEN 100 AND 200)) OR (proto IN (6, 17) AND dport = 22)"),
    "f8_metrics": ("src load gt 100000 and dst appbytes gt 100 and src loss lte 3 and pcr gt 0.5", "round(CASE WHEN dur > 0 THEN coalesce(sbytes, 0) * 8 / dur ELSE 0 END, 6) > 100000 AND dappbytes > 100 AND NOT coalesce(sloss > 3, false) AND round((coalesce(sappbytes, 0) - coalesce(dappbytes, 0)) / nullif(coalesce(sappbytes, 0) + coalesce(dappbytes, 0), 0), 6) > 0.5"),
    "f8_ploss": ("src ploss gt 5", "round(100.0 * sloss / nullif(spkts + sloss, 0), 6) > 5"),
    "f9_attributes": ("src co XA and dst loc gte 3 or dst asn 64600", "(sco = 'XA' AND dloc >= 3) OR das = 64600"),
    "f10_states": ("est and not finack or dst reset", "((proto = 6 AND status & 4 = 4) AND NOT (coalesce(proto = 6, false) AND coalesce(status & 16 = 16, false))) OR (proto = 6 AND status & 8192 = 8192)"),
    "f11_locality": ("local or remote or ip multicast", "(sloc >= 3 AND dloc >= 3) OR (sloc < 3 AND dloc < 3) OR saddr_i BETWEEN 3758096384 AND 4026531839 OR daddr_i BETWEEN 3758096384 AND 4026531839"),
    "f16_shifts": ("sbytes >> 10 > spkts << 1 or sport & 255 << 2 = 80", "(sbytes >> 10) > (spkts << 1) OR sport & (255 << 2) = 80"),
    "f11_inbound": ("inbound or not outbound and tcp", "((sloc < 3 AND dloc >= 3) OR NOT coalesce(dloc < 3 AND sloc >= 3, false)) AND proto = 6"),
    "f16_arithmetic": ("sbytes + dbytes > 1000 * spkts and tcp", "sbytes + dbytes > 1000 * spkts AND proto = 6"),
}
for _name, (_text, _cond) in FILTERS.items():
    on_flows(_name, sql(f"SELECT autoid, saddr, daddr, proto FROM f WHERE {_cond}"), lambda f, t=_text: where(f, t).select("autoid", "saddr", "daddr", "proto"))

_HEX = "list_transform(list_concat(l, list_transform(range(8 - len(l) - len(r)), lambda i: '0'), r), lambda x: ('0x' || x)::INT)"
_SIX = f"g AS (SELECT *, CASE WHEN a LIKE '%:%' THEN {_HEX} END AS w FROM (SELECT DISTINCT a, list_filter(string_split(split_part(a, '::', 1), ':'), lambda x: x <> '') AS l, CASE WHEN a LIKE '%::%' THEN list_filter(string_split(split_part(a, '::', 2), ':'), lambda x: x <> '') ELSE [] END AS r FROM (SELECT saddr AS a FROM f UNION SELECT daddr FROM f)))"
_NETS = "src net 2001:0::/32 or dst net 2001:db8:fa::/47 or src net ::/0 and net 2001:db8:a00::1000:0/100 and not dst host 2001:DB8:fb:0::443"
on_flows(
    "f6_ipv6_prefixes",
    sql(
        """SELECT autoid, saddr, daddr FROM f LEFT JOIN g s ON s.a = saddr LEFT JOIN g d ON d.a = daddr WHERE (coalesce(s.w[1] = 8193 AND s.w[2] = 0, false) OR coalesce(d.w[1] = 8193 AND d.w[2] = 3512 AND d.w[3] & 65534 = 250, false) OR coalesce(saddr LIKE '%:%', false))
  AND (coalesce(s.w[1] = 8193 AND s.w[2] = 3512 AND s.w[3] = 2560 AND s.w[4] + s.w[5] + s.w[6] = 0 AND s.w[7] & 61440 = 4096, false) OR coalesce(d.w[1] = 8193 AND d.w[2] = 3512 AND d.w[3] = 2560 AND d.w[4] + d.w[5] + d.w[6] = 0 AND d.w[7] & 61440 = 4096, false)) AND NOT coalesce(daddr = '2001:db8:fb::443', false)""",
        _SIX,
    ),
    lambda f: where(f, _NETS).select("autoid", "saddr", "daddr"),
)
def _wide(f):
    """A wider view: flags of the TCP header and ICMP types made up from what is stored."""
    tcp = F.col("proto") == 6
    icmp = F.col("proto") == 1
    return f.withColumns({
        "stcpf": F.when(tcp, F.col("seq").bitwiseAND(F.lit(255))), "dtcpf": F.when(tcp, F.col("autoid").bitwiseAND(F.lit(255))),
        "icmp_type": F.when(icmp, F.element_at(F.array(*map(F.lit, (0, 3, 5, 8, 11))), (F.col("seq") % 5 + 1).cast("int"))), "icmp_code": F.when(icmp, F.col("autoid") % 16),
    })


_WIDE_SQL = "v AS (SELECT *, CASE WHEN proto = 6 THEN seq & 255 END AS stcpf, CASE WHEN proto = 6 THEN autoid & 255 END AS dtcpf, CASE WHEN proto = 1 THEN [0, 3, 5, 8, 11][seq % 5 + 1] END AS it, CASE WHEN proto = 1 THEN autoid % 16 END AS ic FROM f)"
on_flows("f10_flags", sql("SELECT autoid FROM v WHERE (coalesce((stcpf & 16) <> 0 OR (dtcpf & 16) <> 0, false) AND NOT coalesce((stcpf & 8) <> 0, false)) OR coalesce((dtcpf & 32) <> 0, false)", _WIDE_SQL), lambda f: where(_wide(f), "ack and not src push or dst urg").select("autoid"))
on_flows("f10_unreachable", sql("SELECT autoid FROM v WHERE it IN (0, 8) OR it = 11 OR (it = 3 AND (ic = 3 OR ic = 13))", _WIDE_SQL), lambda f: where(_wide(f), "echo or timexed or unrport or unrfilter").select("autoid"))

NOW = datetime(2013, 10, 1, 12, 0, 0, tzinfo=UTC)


def _us(*t: int) -> int:
    return int(datetime(*t, tzinfo=UTC).timestamp() * 1_000_000)


RANGES = {
    "f15_touches": ("2013/09/10-2013/09/12", f"stime_us < {_us(2013, 9, 13)} AND coalesce(ltime_us, stime_us) >= {_us(2013, 9, 10)}"),
    "f15_contained": ("c2013/09/10.14:00-2013/09/10.18:00", f"stime_us >= {_us(2013, 9, 10, 14)} AND coalesce(ltime_us, stime_us) < {_us(2013, 9, 10, 18)}"),
    "f15_spans": ("n2013/10/09.14:30:00-2013/10/09.14:30:05", f"stime_us <= {_us(2013, 10, 9, 14, 30)} AND coalesce(ltime_us, stime_us) >= {_us(2013, 10, 9, 14, 30) + 5_000_000}"),
    "f15_inverted": ("x2013/09", f"NOT coalesce(stime_us < {_us(2013, 10, 1)} AND coalesce(ltime_us, stime_us) >= {_us(2013, 9, 1)}, false)"),
    "f15_wildcard": ("****/**/**.14", "hour(make_timestamp(stime_us)) = 14"),
    "f15_relative": ("-2d+6h", f"stime_us < {_us(2013, 9, 29, 6)} AND coalesce(ltime_us, stime_us) >= {_us(2013, 9, 29)}"),
}
for _name, (_text, _cond) in RANGES.items():
    on_flows(_name, sql(f"SELECT autoid, stime_us FROM f WHERE {_cond}"), lambda f, t=_text: timerange.within(f, t, NOW).select("autoid", "stime_us"))

on_flows("f12_payload", sql("SELECT autoid FROM f WHERE regexp_matches(cast(suser AS VARCHAR), '^HELLO-1', 'i') OR regexp_matches(cast(duser AS VARCHAR), '(?i)-0[0-4]$') OR regexp_matches(cast(suser AS VARCHAR), '(?i)ssh') OR regexp_matches(cast(duser AS VARCHAR), '(?i)ssh')"),
         lambda f: labels.grep(f, ["s:^HELLO-1", "d:-0[0-4]$", "ssh"], ignore_case=True).select("autoid"))
on_flows("f12_counts", sql("SELECT sid, count(*) AS n FROM f WHERE NOT coalesce(cast(suser AS VARCHAR) LIKE 'hello%', false) GROUP BY sid"), lambda f: labels.grep(f, ["s:^hello"], invert=True).groupBy("sid").agg(F.count(F.lit(1)).alias("n")))
on_flows("f12_payload_hex", sql("SELECT autoid FROM f WHERE coalesce(hex(suser) LIKE '3C00%', false)"), lambda f: labels.grep(f, [r"s:^<\x00"]).select("autoid"))
on_flows("f14_label", sql("SELECT autoid, label FROM f WHERE regexp_matches(label, '\"svc\":\"(dns|web)\"')"), lambda f: f.where(F.col("label").rlike('"svc":"(dns|web)"')).select("autoid", "label"))
on_flows("f17_service_available", sql("SELECT autoid, CASE WHEN proto = 6 AND dport = 443 THEN coalesce(status & 4, 0) <> 0 AND coalesce(dpkts, 0) > 0 END AS available FROM f"),
         lambda f: f.select("autoid", labels.available(6, 443).alias("available")))

POLICY = """access-list 101 permit tcp 10.0.0.0 0.255.255.255 any eq https
access-list 101 deny udp any range 1000 2000 any
access-list 101 permit tcp any any gt 1023 established
access-list 101 permit icmp any 198.18.0.0/16
access-list 101 deny ip host 10.250.0.7 any"""
on_flows(
    "f13_policy",
    sql("""SELECT autoid, acl_line, acl_line IN (1, 3, 4) AS permitted FROM (SELECT autoid, CASE WHEN proto = 6 AND saddr_i & 4278190080 = 167772160 AND dport = 443 THEN 1
  WHEN proto = 17 AND sport BETWEEN 1000 AND 2000 THEN 2 WHEN proto = 6 AND dport > 1023 AND status & 6 <> 0 THEN 3 WHEN proto = 1 AND daddr_i & 4294901760 = 3323068416 THEN 4 WHEN saddr_i = 184156167 THEN 5 ELSE 0 END AS acl_line FROM f)"""),
    lambda f: policy.evaluate(f, policy.parse_policy(POLICY)).select("autoid", "acl_line", "permitted"),
)

FLAG_POLICY = """permit tcp any any eq 443 syn ack
deny tcp any any rst
permit tcp any any fin log
permit ip any any"""
on_flows("f13_flags", sql("SELECT autoid, acl_line, acl_line IN (1, 3, 4) AS permitted FROM (SELECT autoid, CASE WHEN proto = 6 AND dport = 443 AND status & 1 <> 0 AND status & 6 <> 0 THEN 1 WHEN proto = 6 AND status & 12288 <> 0 THEN 2 WHEN proto = 6 AND status & 24 <> 0 THEN 3 ELSE 4 END AS acl_line FROM f)"),
         lambda f: policy.evaluate(f, policy.parse_policy(FLAG_POLICY)).select("autoid", "acl_line", "permitted"))

# --- projections
BYTES, PKTS = "(coalesce(sbytes, 0) + coalesce(dbytes, 0))", "(coalesce(spkts, 0) + coalesce(dpkts, 0))"
STATE_SQL = f"""CASE WHEN proto = 6 THEN CASE WHEN status & 12288 <> 0 THEN 'RST' WHEN status & 48 <> 0 THEN 'CLO' WHEN status & 8 <> 0 THEN 'FIN' WHEN status & 4 <> 0 THEN 'EST' WHEN status & 2 <> 0 THEN 'ACC'
  WHEN status & 1 <> 0 THEN 'REQ' ELSE 'CON' END WHEN coalesce(dpkts, 0) = 0 THEN 'INT' WHEN spkts = 1 AND dpkts = 1 THEN 'ACC' ELSE 'CON' END"""
on_flows("p_select", sql("SELECT autoid, stime_us, CASE WHEN length(saddr) > 10 THEN left(saddr, 9) || '*' ELSE saddr END AS saddr, dport, " + f"{BYTES} AS bytes, {STATE_SQL} AS state FROM f"),
         lambda f: fields.select_fields(f, "autoid stime_us saddr:10 dport bytes state"))
on_flows(
    "p_fields",
    sql(f"""SELECT autoid, {BYTES} AS bytes, {PKTS} AS pkts, coalesce(sappbytes, 0) + coalesce(dappbytes, 0) AS appbytes, coalesce(sloss, 0) + coalesce(dloss, 0) AS loss,
  CASE WHEN dur > 0 THEN {BYTES} * 8 / dur ELSE 0 END AS load, CASE WHEN dur > 0 THEN {PKTS} / dur ELSE 0 END AS rate, round(100.0 * sloss / nullif(spkts + sloss, 0), 3) AS sploss,
  round((coalesce(sappbytes, 0) - coalesce(dappbytes, 0)) / nullif(coalesce(sappbytes, 0) + coalesce(dappbytes, 0), 0), 6) AS pcr, round(sbytes / nullif(spkts, 0), 3) AS smeansz,
  CASE WHEN sttl <= 32 THEN 32 - sttl WHEN sttl <= 64 THEN 64 - sttl WHEN sttl <= 128 THEN 128 - sttl ELSE 255 - sttl END AS shops, lower(substring(smac, 1, 8)) AS soui,
  CASE WHEN sloc >= dloc OR dloc IS NULL THEN saddr ELSE daddr END AS laddr FROM f"""),
    lambda f: f.select("autoid", *(fields.field(n) for n in "bytes pkts appbytes loss".split()), *(F.round(F.expr(fields.sql(n)), k).alias(n) for n, k in (("sploss", 3), ("pcr", 6), ("smeansz", 3))), *(fields.field(n) for n in ("load", "rate", "shops", "soui", "laddr"))),
)
#: Derived fields and the same in SQL; numbers are compared to six decimals.
_PER = "CASE WHEN dur > 0 THEN {} / dur ELSE 0 END"
_LOSS = "100.0 * {p} / nullif({w} + {p}, 0)"
_LOCAL = "(sloc >= dloc OR dloc IS NULL)"
_CNET = "coalesce({a}_i >> 24 & 255 || '.' || ({a}_i >> 16 & 255) || '.' || ({a}_i >> 8 & 255) || '.0/24', {a})"
_BOTH_LOSS = "(coalesce(sloss, 0) + coalesce(dloss, 0))"
FIELD_SQL = {
    "sload": _PER.format("coalesce(sbytes, 0) * 8"), "dload": _PER.format("coalesce(dbytes, 0) * 8"), "srate": _PER.format("coalesce(spkts, 0)"), "drate": _PER.format("coalesce(dpkts, 0)"), "load": _PER.format(BYTES + " * 8"), "rate": _PER.format(PKTS),
    "ploss": _LOSS.format(p=_BOTH_LOSS, w=PKTS), "sploss": _LOSS.format(p="sloss", w="spkts"), "dploss": _LOSS.format(p="dloss", w="dpkts"), "pretrans": _LOSS.format(p=_BOTH_LOSS, w=PKTS), "spretrans": _LOSS.format(p="sloss", w="spkts"), "dpretrans": _LOSS.format(p="dloss", w="dpkts"),
    "psretrans": _LOSS.format(p="sloss", w="spkts"), "pdretrans": _LOSS.format(p="dloss", w="dpkts"), "retrans": _BOTH_LOSS, "sretrans": "sloss", "dretrans": "dloss", "loss": _BOTH_LOSS, "bytes": BYTES, "pkts": PKTS, "appbytes": "coalesce(sappbytes, 0) + coalesce(dappbytes, 0)",
    "pcr": "(coalesce(sappbytes, 0) - coalesce(dappbytes, 0)) / nullif(coalesce(sappbytes, 0) + coalesce(dappbytes, 0), 0)", "abr": "(coalesce(sappbytes, 0) - coalesce(dappbytes, 0)) / nullif(coalesce(sappbytes, 0) + coalesce(dappbytes, 0), 0)", "smeansz": "sbytes / nullif(spkts, 0)", "dmeansz": "dbytes / nullif(dpkts, 0)",
    "shops": "list_min(list_filter([32, 64, 128, 255], lambda x: x >= sttl)) - sttl", "dhops": "list_min(list_filter([32, 64, 128, 255], lambda x: x >= dttl)) - dttl", "srcid": "sid", "loc": "greatest(sloc, dloc)", "soui": "lower(smac[:8])", "doui": "lower(dmac[:8])", "smacoui": "lower(smac[:8])", "dmacoui": "lower(dmac[:8])",
    "laddr": f"CASE WHEN {_LOCAL} THEN saddr ELSE daddr END", "raddr": f"CASE WHEN {_LOCAL} THEN daddr ELSE saddr END", "snet": _CNET.format(a="saddr"), "dnet": _CNET.format(a="daddr"), "lnet": f"CASE WHEN {_LOCAL} THEN {_CNET.format(a='saddr')} ELSE {_CNET.format(a='daddr')} END",
    "rnet": f"CASE WHEN {_LOCAL} THEN {_CNET.format(a='daddr')} ELSE {_CNET.format(a='saddr')} END", "state": STATE_SQL, "type": "'far'", "cause": "'status'", "sdsb": "(stos >> 2)::VARCHAR", "ddsb": "(dtos >> 2)::VARCHAR", "offset": "autoid", "rank": "autoid - 1", "runtime": "dur", "sum": "dur", "mean": "dur", "min": "dur", "max": "dur",
    "mindur": "dur", "maxdur": "dur", "sdur": "dur", "avgdur": "dur / nullif(trans, 0)", "stddev": "0.0", "binnum": "NULL::BIGINT", "etype": "CASE WHEN saddr_i IS NOT NULL THEN 'ipv4' WHEN saddr LIKE '%:%' THEN 'ipv6' END", "svc": "CASE WHEN json_valid(label) THEN json_extract_string(label, '$.svc') END",
    "sjit": "NULL::DOUBLE", "dvlan": "NULL::INT", "tcpopt": "NULL::VARCHAR", "dmpls": "NULL::BIGINT", "tranref": "NULL::BIGINT",
}


def _computed(f):
    kinds = dict(f.select(*(F.expr(fields.sql(n)).alias(n) for n in FIELD_SQL)).dtypes)
    return f.select("autoid", *(F.round(F.expr(fields.sql(n)), 6).alias(n) if kinds[n].startswith(("double", "decimal")) else F.expr(fields.sql(n)).alias(n) for n in FIELD_SQL))


_FRACTIONS = set("sload dload srate drate load rate ploss sploss dploss pretrans spretrans dpretrans psretrans pdretrans pcr abr smeansz dmeansz runtime sum mean min max mindur maxdur sdur avgdur stddev sjit".split())
on_flows("x2_derived", sql("SELECT autoid, " + ", ".join(f"round(({e})::DOUBLE, 6) AS {n}" if n in _FRACTIONS else f"{e} AS {n}" for n, e in FIELD_SQL.items()) + " FROM f"), _computed)
on_flows("x1_metrics", sql(f"SELECT proto, round(avg({BYTES}), 3) AS bytes, round(avg(CASE WHEN dur > 0 THEN {BYTES} * 8 / dur ELSE 0 END), 1) AS load, max(greatest(sloc, dloc)) AS loc, round(avg(dbytes / nullif(dpkts, 0)), 3) AS dmeansz FROM f GROUP BY proto"),
         lambda f: f.groupBy("proto").agg(F.round(F.avg(F.expr(fields.sql("bytes"))), 3).alias("bytes"), F.round(F.avg(F.expr(fields.sql("load"))), 1).alias("load"), F.max(F.expr(fields.sql("loc"))).alias("loc"), F.round(F.avg(F.expr(fields.sql("dmeansz"))), 3).alias("dmeansz")))
on_flows("x2_catalogue", None, lambda f: f.select("autoid", *(fields.field(n) for n in fields.NAMES if n != "autoid")))
on_flows("x11_state", sql(f"SELECT proto, state, count(*) AS n FROM (SELECT proto, {STATE_SQL} AS state FROM f) GROUP BY ALL"), lambda f: f.groupBy("proto", fields.field("state")).agg(F.count(F.lit(1)).alias("n")))
_SEEN = lambda a, b, both, s, d: f"CASE WHEN proto <> 6 THEN ' ' WHEN status & {a} <> 0 AND status & {b} <> 0 THEN '{both}' WHEN status & {a} <> 0 THEN '{s}' WHEN status & {b} <> 0 THEN '{d}' ELSE ' ' END"
on_flows("x11_flags", sql("SELECT autoid, ' e  ' || CASE WHEN proto = 6 AND status & 128 <> 0 THEN 'R' ELSE " + _SEEN(256, 512, "*", "s", "d") + " END || " + " || ".join(_SEEN(*x) for x in ((65536, 131072, "&", "i", "r"), (1024, 2048, "@", "S", "D"), (16384, 32768, "E", "x", "t"))) + " || '    ' AS flags FROM f"),
         lambda f: f.select("autoid", F.expr(fields.flags_sql()).alias("flags")))
on_flows("x11_direction", sql("SELECT proto, dir, count(*) AS n FROM (SELECT proto, CASE WHEN coalesce(dpkts, 0) > 0 AND (proto <> 6 OR NOT status & 3 <> 0) THEN '<' ELSE ' ' END || CASE WHEN proto <> 6 THEN '-' WHEN status & 12288 <> 0 THEN '|' WHEN status & 15 <> 0 THEN '-' ELSE '?' END || CASE WHEN coalesce(spkts, 0) > 0 OR coalesce(dpkts, 0) = 0 THEN '>' ELSE ' ' END AS dir FROM f) GROUP BY ALL"),
         lambda f: f.groupBy("proto", fields.field("dir")).agg(F.count(F.lit(1)).alias("n")))
LETTERS = (("s", 1), ("S", 2), ("E", 4), ("f", 8), ("F", 16), ("R", 12288))
on_flows("p11_state_letters", sql("SELECT autoid, " + " || ".join(f"CASE WHEN coalesce(status, 0) & {b} <> 0 THEN '{c}' ELSE '' END" for c, b in LETTERS) + " AS letters, " + " || ".join(f"CASE WHEN coalesce(seq, 0) & {1 << i} <> 0 THEN '{c}' ELSE '' END" for i, c in enumerate("FSRPAU78")) + " AS flags FROM f WHERE proto = 6"),
         lambda f: f.where("proto = 6").select("autoid", fields.state_letters().alias("letters"), fields.flag_letters("seq").alias("flags")))
_ASCII = "list_aggregate(list_transform(range(octet_length(suser)), lambda i: CASE WHEN ('0x' || substring(hex(suser), 2 * i + 1, 2))::INT BETWEEN 32 AND 126 THEN chr(('0x' || substring(hex(suser), 2 * i + 1, 2))::INT) ELSE '.' END), 'string_agg', '')"
on_flows("p12_payload_hex", sql(f"SELECT autoid, hex(suser) AS hex, base64(suser) AS encoded, coalesce({_ASCII}, '') AS ascii, ceil(octet_length(suser) / 5)::INT * 8 AS size32 FROM f WHERE suser IS NOT NULL"),
         lambda f: f.where("suser is not null").select("autoid", *(fields.payload("suser", form).alias(name) for form, name in (("hex", "hex"), ("encode64", "encoded"), ("ascii", "ascii"))), F.length(fields.payload("suser", "encode32")).alias("size32")))
on_flows("p3_strip", sql("SELECT autoid, saddr, CAST(NULL AS SMALLINT) AS sttl, CAST(NULL AS VARCHAR) AS smac, spkts FROM f"), lambda f: strip(f, "ipattr", "mac").select("autoid", "saddr", "sttl", "smac", "spkts"))
on_flows("p4_reverse", sql("SELECT autoid, daddr AS saddr, saddr AS daddr, dport AS sport, sport AS dport, dbytes AS sbytes, sbytes AS dbytes FROM f"), lambda f: reverse(f).select("autoid", "saddr", "daddr", "sport", "dport", "sbytes", "dbytes"))
on_flows("p5_both_ways", sql("SELECT addr AS saddr, count(*) AS n, cast(sum(b) AS BIGINT) AS sbytes FROM (SELECT saddr AS addr, sbytes AS b FROM f UNION ALL SELECT daddr, dbytes FROM f) GROUP BY addr"),
         lambda f: both_ways(f).groupBy("saddr").agg(F.count(F.lit(1)).alias("n"), F.sum("sbytes").alias("sbytes")))
on_flows("p6_one_way", sql("SELECT autoid, saddr, daddr, spkts, 0::BIGINT AS dpkts FROM f WHERE spkts > 0 UNION ALL SELECT autoid, daddr, saddr, dpkts, 0 FROM f WHERE dpkts > 0"), lambda f: one_way(f).select("autoid", "saddr", "daddr", "spkts", "dpkts"))
SWAP = "coalesce(CASE WHEN saddr_i IS NOT NULL AND daddr_i IS NOT NULL THEN saddr_i > daddr_i ELSE saddr > daddr END, false)"
on_flows("p7_matrix", sql(f"SELECT autoid, CASE WHEN {SWAP} THEN daddr ELSE saddr END AS saddr, CASE WHEN {SWAP} THEN saddr ELSE daddr END AS daddr FROM f"), lambda f: normalised(f).select("autoid", "saddr", "daddr"))
NET = "(({a} >> 24) & 255) || '.' || (({a} >> 16) & 255) || '.' || (({a} >> 8) & 255) || '.0/24'"
on_flows("p8_masks", sql(f"SELECT net, count(*) AS n FROM (SELECT coalesce({NET.format(a='saddr_i')}, saddr) AS net FROM f) GROUP BY net"), lambda f: f.groupBy(addresses.net_text("saddr_i", "saddr", 24).alias("net")).agg(F.count(F.lit(1)).alias("n")))
on_flows("p9_percent", sql("SELECT proto, trans, sbytes, round(100.0 * trans / sum(trans) OVER (), 6) AS pct_trans, round(100.0 * sbytes / sum(sbytes) OVER (), 6) AS pct_sbytes FROM (SELECT proto, cast(sum(trans) AS BIGINT) AS trans, cast(coalesce(sum(sbytes), 0) AS BIGINT) AS sbytes FROM f GROUP BY proto)"),
         lambda f: cluster.percent(cluster.cluster(f, "proto").select("proto", "trans", "sbytes"), ["trans", "sbytes"]).select("proto", "trans", "sbytes", F.round("pct_trans", 6).alias("pct_trans"), F.round("pct_sbytes", 6).alias("pct_sbytes")))
on_flows("p10_formats", sql("SELECT autoid, strftime(make_timestamp(stime_us), '%H:%M:%S') AS clock, stime_us // 1000000 AS unix, CASE WHEN sbytes >= 1000000000 THEN printf('%.2fG', sbytes / 1e9) WHEN sbytes >= 1000000 THEN printf('%.2fM', sbytes / 1e6) WHEN sbytes >= 1000 THEN printf('%.2fK', sbytes / 1e3) ELSE sbytes::VARCHAR END AS size FROM f WHERE stime_us IS NOT NULL"),
         lambda f: f.where("stime_us is not null").select("autoid", F.date_format(F.timestamp_micros("stime_us"), "HH:mm:ss").alias("clock"), F.expr("stime_us div 1000000").alias("unix"), fields.abbreviated("sbytes").alias("size")))

# --- aggregation
on_flows("a1_cluster", sql(f"SELECT saddr, daddr, proto, {MERGED} FROM f GROUP BY ALL"), lambda f: cluster.cluster(f, "saddr daddr proto"))
on_flows("a3_masks", sql(f"SELECT coalesce({NET.format(a='saddr_i')}, saddr) AS saddr, proto, dport, {MERGED} FROM f GROUP BY 1, 2, 3"), lambda f: cluster.cluster(f, "saddr/24 dport"))
on_flows("a3_matrix", sql(f"SELECT * FROM (SELECT CASE WHEN {SWAP} THEN daddr ELSE saddr END AS saddr, CASE WHEN {SWAP} THEN saddr ELSE daddr END AS daddr, cast(sum(trans) AS BIGINT) AS trans, cast(coalesce(sum(CASE WHEN {SWAP} THEN dbytes ELSE sbytes END), 0) AS BIGINT) AS sbytes FROM f GROUP BY 1, 2)"),
         lambda f: cluster.cluster(f, "matrix").select("saddr", "daddr", "trans", "sbytes"))
on_flows(
    "a2_direction",
    sql(
        f"SELECT saddr, sport, daddr, dport, proto, {MERGED} FROM o GROUP BY saddr, sport, daddr, dport, proto",
        "c AS (SELECT *, coalesce(saddr, '') < coalesce(daddr, '') OR (coalesce(saddr, '') = coalesce(daddr, '') AND coalesce(sport, -1) <= coalesce(dport, -1)) AS fwd FROM f)",
        "k AS (SELECT *, CASE WHEN fwd THEN coalesce(saddr, '') ELSE coalesce(daddr, '') END AS la, CASE WHEN fwd THEN coalesce(sport, -1) ELSE coalesce(dport, -1) END AS lp, CASE WHEN fwd THEN coalesce(daddr, '') ELSE coalesce(saddr, '') END AS ha, CASE WHEN fwd THEN coalesce(dport, -1) ELSE coalesce(sport, -1) END AS hp, proto = 6 AND coalesce(status & 1, 0) = 1 AS syn FROM c)",
        "t AS (SELECT proto, la, lp, ha, hp, bool_or(fwd AND syn) AS sf, bool_or(NOT fwd AND syn) AS sr, coalesce(min(CASE WHEN fwd THEN stime_us END), 1::BIGINT << 62) AS tf, coalesce(min(CASE WHEN NOT fwd THEN stime_us END), 1::BIGINT << 62) AS tr FROM k GROUP BY ALL)",
        "w AS (SELECT k.*, CASE WHEN (sf AND sr) OR coalesce(k.proto = 50, false) THEN fwd WHEN sf THEN true WHEN sr THEN false ELSE tf <= tr END AS forward FROM k JOIN t ON k.proto IS NOT DISTINCT FROM t.proto AND k.la = t.la AND k.lp = t.lp AND k.ha = t.ha AND k.hp = t.hp)",
        "o AS (SELECT proto, trans, stime_us, ltime_us, status, " + ", ".join(f"CASE WHEN fwd = forward THEN {a} ELSE {b} END AS {a}, CASE WHEN fwd = forward THEN {b} ELSE {a} END AS {b}" for a, b in (("saddr", "daddr"), ("sport", "dport"), ("spkts", "dpkts"), ("sbytes", "dbytes"), ("sappbytes", "dappbytes"), ("sloss", "dloss"))) + " FROM w)",
    ),
    cluster.cluster,
)
on_flows("a6_statistics", sql(f"SELECT proto, count(dur) AS n, round(avg(dur), 6) AS mean, min(dur) AS min, max(dur) AS max, round(sum(dur), 4) AS sum, round(stddev_pop(dur), 5) AS stddev FROM f GROUP BY proto"),
         lambda f: cluster.cluster(f, "proto", "dur").select("proto", "n", F.round("mean", 6).alias("mean"), "min", "max", F.round("sum", 4).alias("sum"), F.round("stddev", 5).alias("stddev")))
on_flows("a7_all", sql(f"SELECT {MERGED} FROM f"), lambda f: cluster.cluster(f, "all"))
on_flows("a7_none", sql("SELECT autoid, saddr, spkts FROM f"), lambda f: cluster.cluster(f, "none").select("autoid", "saddr", "spkts"))
add("a7_per_file", "SELECT count(*) AS n, 1::BIGINT AS files FROM argus", lambda spark, d: table(spark, d, "argus").groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("k")).agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("files")))
RULES = """# web, then names with hand-on, then the rest
filter="tcp and dst port 443" model="saddr daddr" label="web"
filter="udp and port domain" model="saddr" label="names" cont
filter="udp" model="proto dport" label="udp"
filter="icmp" model="all" label="icmp"
"""
on_flows(
    "a4_rules",
    sql(
        "SELECT rule, label, count(*) AS groups, cast(sum(trans) AS BIGINT) AS trans FROM (SELECT rule, label, k, sum(trans) AS trans FROM m GROUP BY ALL) GROUP BY ALL",
        "t AS (SELECT *, coalesce(proto = 6 AND dport = 443, false) AS r0, coalesce(proto = 17, false) AND (coalesce(sport = 53, false) OR coalesce(dport = 53, false)) AS r1, coalesce(proto = 17, false) AS r2, coalesce(proto IN (1, 58), false) AS r3 FROM f)",
        """m AS (SELECT 'rule0' AS rule, 'web' AS label, {'a': saddr, 'b': daddr}::VARCHAR AS k, trans FROM t WHERE r0 UNION ALL SELECT 'rule1', 'names', {'a': saddr}::VARCHAR, trans FROM t WHERE r1
  UNION ALL SELECT 'rule2', 'udp', {'a': proto, 'b': dport}::VARCHAR, trans FROM t WHERE r2 UNION ALL SELECT 'rule3', 'icmp', '', trans FROM t WHERE r3
  UNION ALL SELECT 'rest', '', {'a': saddr, 'b': daddr, 'c': proto, 'd': sport, 'e': dport}::VARCHAR, trans FROM t WHERE NOT (r0 OR r2 OR r3))""",
    ),
    lambda f: cluster.cluster_by_rules(f, cluster.parse_rules(RULES)).groupBy("rule", "label").agg(F.count(F.lit(1)).alias("groups"), F.sum("trans").alias("trans")),
)
TIMED_RULES = """filter="tcp" model="saddr daddr" idle=60 label="tcp"
filter="udp" model="saddr" status=300 idle=600
"""
_RULE_TIMES = (
    "q AS (SELECT *, CASE WHEN proto = 6 THEN 'rule0' ELSE 'rule1' END AS rule, CASE WHEN proto = 6 THEN coalesce(saddr, '~') || '|' || coalesce(daddr, '~') ELSE coalesce(saddr, '~') END AS key, coalesce(ltime_us, stime_us) AS e FROM f WHERE proto IN (6, 17) AND stime_us IS NOT NULL)",
    "b AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY stime_us, ltime_us, autoid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM q WHERE rule = 'rule0')",
    "p AS (SELECT *, sum(CASE WHEN stime_us - b < 60000000 THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY stime_us, ltime_us, autoid ROWS UNBOUNDED PRECEDING) AS no FROM b)",
    "r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY stime_us, autoid) AS k FROM q WHERE rule = 'rule1')",
    """w AS (SELECT key, k, stime_us AS s0, e AS e0, 0 AS no FROM r WHERE k = 1 UNION ALL SELECT r.key, r.k, CASE WHEN x THEN r.stime_us ELSE least(s0, r.stime_us) END, CASE WHEN x THEN r.e ELSE greatest(e0, r.e) END, no + x::INT
  FROM (SELECT w.*, r.stime_us, r.e, r.key AS rk, r.k AS rn, e0 - s0 >= 300000000 OR r.stime_us - e0 >= 600000000 AS x FROM w JOIN r ON r.key = w.key AND r.k = w.k + 1) z JOIN r ON r.key = z.rk AND r.k = z.rn)""",
)
on_flows(
    "a4_rule_timers",
    sql("SELECT 'rule0' AS rule, min(stime_us) AS stime_us, max(ltime_us) AS ltime_us, cast(sum(coalesce(trans, 1)) AS BIGINT) AS trans FROM p GROUP BY key, no UNION ALL SELECT 'rule1', min(stime_us), max(ltime_us), cast(sum(coalesce(trans, 1)) AS BIGINT) FROM r JOIN w USING (key, k) GROUP BY key, no", *_RULE_TIMES).replace("WITH ", "WITH RECURSIVE ", 1),
    lambda f: cluster.cluster_by_rules(f, cluster.parse_rules(TIMED_RULES)).where("rule <> 'rest'").select("rule", "stime_us", "ltime_us", "trans"),
)
KEY3 = ["saddr", "daddr", "proto"]
on_flows(
    "a5_idle",
    sql(
        "SELECT saddr, daddr, proto, min(stime_us) AS stime_us, max(ltime_us) AS ltime_us, cast(sum(trans) AS BIGINT) AS trans FROM p GROUP BY saddr, daddr, proto, part",
        "g AS (SELECT *, max(coalesce(ltime_us, stime_us)) OVER (PARTITION BY saddr, daddr, proto ORDER BY stime_us, ltime_us, autoid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM f WHERE stime_us IS NOT NULL)",
        "p AS (SELECT *, sum(CASE WHEN stime_us - b < 60000000 THEN 0 ELSE 1 END) OVER (PARTITION BY saddr, daddr, proto ORDER BY stime_us, ltime_us, autoid ROWS UNBOUNDED PRECEDING) AS part FROM g)",
    ),
    lambda f: cluster.idle_split(f, KEY3, 60).select(*KEY3, "stime_us", "ltime_us", "trans"),
)
_TIMED = """r AS (SELECT *, coalesce(saddr, '~') || '|' || coalesce(daddr, '~') || '|' || coalesce(proto::VARCHAR, '~') AS key, row_number() OVER (PARTITION BY saddr, daddr, proto ORDER BY stime_us, autoid) AS k, coalesce(ltime_us, stime_us) AS e FROM f WHERE stime_us IS NOT NULL),
w AS (SELECT key, k, stime_us AS s0, e AS e0, 0 AS no FROM r WHERE k = 1 UNION ALL
  SELECT r.key, r.k, CASE WHEN e0 - s0 >= 300000000 OR r.stime_us - e0 >= 600000000 THEN r.stime_us ELSE least(s0, r.stime_us) END, CASE WHEN e0 - s0 >= 300000000 OR r.stime_us - e0 >= 600000000 THEN r.e ELSE greatest(e0, r.e) END,
    no + CASE WHEN e0 - s0 >= 300000000 OR r.stime_us - e0 >= 600000000 THEN 1 ELSE 0 END FROM w JOIN r ON r.key = w.key AND r.k = w.k + 1)"""
on_flows("a5_status", f"WITH RECURSIVE {VIEW},\n{_TIMED}\nSELECT saddr, daddr, proto, {MERGED} FROM r JOIN w USING (key, k) GROUP BY saddr, daddr, proto, no", lambda f: cluster.status_split(f, KEY3, 300, 600).drop("part"))
DAY_BIN = "(epoch_us(date_trunc('year', make_timestamp(stime_us))) + floor((stime_us - epoch_us(date_trunc('year', make_timestamp(stime_us)))) / {s})::BIGINT * {s})"
on_flows("a9_nomodify", sql(f"SELECT {DAY_BIN.format(s=3600000000)} AS bin_us, proto, {MERGED} FROM f WHERE stime_us IS NOT NULL GROUP BY 1, 2"), lambda f: bins.time_bins(f, "1h", ["proto"], "nomodify"))
on_flows("a9_months", sql("SELECT epoch_us(date_trunc('month', make_timestamp(stime_us))) AS bin_us, count(*) AS n FROM f WHERE stime_us IS NOT NULL GROUP BY 1"), lambda f: f.where("stime_us is not null").groupBy(bins.bin_start(F.col("stime_us"), "1M").alias("bin_us")).agg(F.count(F.lit(1)).alias("n")))
_SPLIT = (
    "a AS (SELECT *, greatest(coalesce(ltime_us, stime_us), stime_us) AS e, epoch_us(date_trunc('year', make_timestamp(stime_us))) AS o, coalesce(spkts, 0) + coalesce(dpkts, 0) AS k0 FROM f WHERE stime_us IS NOT NULL)",
    "b AS (SELECT *, (stime_us - o) // 600000000 AS b0, CASE WHEN e > stime_us AND k0 > 0 THEN (e - 1 - o) // 600000000 ELSE (stime_us - o) // 600000000 END AS b1, e - stime_us AS len FROM a)",
    "x AS (SELECT *, unnest(generate_series(b0, b1)) AS k FROM b)",
    "y AS (SELECT *, greatest(stime_us, o + k * 600000000) - stime_us AS lo, CASE WHEN k = b1 THEN e ELSE o + (k + 1) * 600000000 END - stime_us AS hi FROM x)",
    "z AS (SELECT *, CASE WHEN b0 = b1 THEN spkts ELSE (spkts::HUGEINT * hi // len - spkts::HUGEINT * lo // len)::BIGINT END AS sp, CASE WHEN b0 = b1 THEN dpkts ELSE (dpkts::HUGEINT * hi // len - dpkts::HUGEINT * lo // len)::BIGINT END AS dp, spkts::HUGEINT * hi // nullif(len, 0) AS s1, spkts::HUGEINT * lo // nullif(len, 0) AS s0 FROM y)",
    "s AS (SELECT *, o + k * 600000000 AS bin_us, CASE WHEN b0 = b1 THEN sbytes WHEN coalesce(spkts, 0) = 0 THEN CASE WHEN k = b1 THEN sbytes ELSE 0 END ELSE (sbytes::HUGEINT * s1 // spkts - sbytes::HUGEINT * s0 // spkts)::BIGINT END AS sb FROM z WHERE b0 = b1 OR coalesce(sp, 0) + coalesce(dp, 0) > 0)",
)
on_flows("a8_split", sql("SELECT bin_us, proto, count(*) AS n, cast(coalesce(sum(sp), 0) AS BIGINT) AS spkts, cast(coalesce(sum(dp), 0) AS BIGINT) AS dpkts, cast(coalesce(sum(sb), 0) AS BIGINT) AS sbytes FROM s GROUP BY ALL", *_SPLIT),
         lambda f: bins.split(f, "10m").groupBy("bin_us", "proto").agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("spkts", "dpkts", "sbytes"))))
on_flows("a9_hard", sql("SELECT bin_us, proto, bin_us AS stime_us, bin_us + 600000000 AS ltime_us, 600.0::DOUBLE AS dur, cast(coalesce(sum(sp), 0) AS BIGINT) AS spkts FROM s GROUP BY ALL", *_SPLIT),
         lambda f: bins.time_bins(f, "10m", ["proto"], "hard").select("bin_us", "proto", "stime_us", "ltime_us", "dur", "spkts"))
on_flows("a9_zero", sql("SELECT c.bin_us, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(bin_us) FROM h), (SELECT max(bin_us) FROM h), 60000000)) AS bin_us) c LEFT JOIN h ON h.bin_us = c.bin_us",
         f"h AS (SELECT {DAY_BIN.format(s=60000000)} AS bin_us, count(*) AS n FROM f WHERE stime_us IS NOT NULL GROUP BY 1)"),
         lambda f: bins.with_empty_bins(f.where("stime_us is not null").groupBy(bins.bin_start(F.col("stime_us"), "1m").alias("bin_us")).agg(F.count(F.lit(1)).alias("n")), "1m", ["n"]))
on_flows("a10_count_bins", sql("SELECT bin, count(*) AS n, min(autoid) AS first_id, max(autoid) AS last_id FROM (SELECT autoid, (row_number() OVER (ORDER BY autoid) - 1) // 1000 AS bin FROM f) GROUP BY bin"),
         lambda f: bins.count_bins(f, 1000).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("autoid").alias("first_id"), F.max("autoid").alias("last_id")))
on_flows("a11_size_bins", sql(f"SELECT bin, count(*) AS n, min(autoid) AS first_id FROM (SELECT autoid, (sum({BYTES}) OVER (ORDER BY autoid) - {BYTES}) // 100000000 AS bin FROM f) GROUP BY bin"),
         lambda f: bins.size_bins(f, 100_000_000).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("autoid").alias("first_id")))
on_flows("a12_rate_bins", sql(f"SELECT bin_us, proto, count(*) AS n, cast(sum({BYTES}) AS BIGINT) AS bytes, sum({BYTES}) * 8 / 1800 AS load FROM (SELECT *, (stime_us // 600000000 - unnest([0, 1, 2])) * 600000000 AS bin_us FROM f WHERE stime_us IS NOT NULL) GROUP BY ALL"),
         lambda f: bins.rate_bins(f, 3, 600, ["proto"]))
on_flows("a13_totals", sql(f"SELECT {TOTALS} FROM f"), inventory.totals)
on_flows("a14_protocols", sql(f"SELECT CASE WHEN saddr_i IS NOT NULL OR daddr_i IS NOT NULL OR coalesce(saddr LIKE '%:%', false) OR coalesce(daddr LIKE '%:%', false) THEN 'ip' ELSE 'other' END AS class, proto, {TOTALS} FROM f GROUP BY 1, 2"), inventory.protocols)
V4_CASE = "CASE " + " ".join(f"WHEN number BETWEEN {lo} AND {hi} THEN '{name}'" for (lo, hi), name in ((addresses.span(c), n) for c, n in addresses.V4_CLASSES)) + " WHEN number IS NOT NULL THEN 'unicast' "
V6_CASE = " ".join(f"WHEN regexp_matches(addr, '{p}') THEN '{n}'" for p, n in addresses.V6_CLASSES) + " WHEN addr LIKE '%:%' THEN 'unicast' END"
on_flows("a15_address_types", sql("SELECT side, version, type, CASE WHEN version = 4 THEN count(DISTINCT addr) ELSE count(*) END AS n FROM t WHERE version IS NOT NULL GROUP BY side, version, type",
         "e AS (SELECT 'src' AS side, saddr AS addr, saddr_i AS number FROM f UNION ALL SELECT 'dst', daddr, daddr_i FROM f)",
         f"t AS (SELECT *, CASE WHEN number IS NOT NULL THEN 4 WHEN addr LIKE '%:%' THEN 6 END AS version, {V4_CASE}{V6_CASE} AS type FROM e)"), inventory.address_types)
on_flows("a16_histogram", sql("SELECT bin, round(CASE WHEN bin > 0 THEN (bin - 1) * 0.5 END, 9) AS low, freq, round(100.0 * freq / sum(freq) OVER (), 6) AS rel, round(100.0 * sum(freq) OVER (ORDER BY bin) / sum(freq) OVER (), 6) AS cum FROM (SELECT CASE WHEN dur < 0 THEN 0 ELSE least(floor(dur / 0.5)::BIGINT + 1, 21) END AS bin, count(*) AS freq FROM f WHERE dur IS NOT NULL GROUP BY 1)"),
         lambda f: histogram.histogram(f, "dur 20:0-10").select("bin", F.round("low", 9).alias("low"), "freq", F.round("rel", 6).alias("rel"), F.round("cum", 6).alias("cum")))
on_flows("a16_log_histogram", sql("SELECT CASE WHEN v < 0 THEN 0 ELSE least(floor(v / 0.5)::BIGINT + 1, 17) END AS bin, count(*) AS freq FROM (SELECT log10(sbytes) AS v FROM f WHERE sbytes > 0) GROUP BY 1"), lambda f: histogram.histogram(f, "sbytes 16L:0-8").select("bin", "freq"))
on_flows("a17_auto_range", sql("SELECT bin, round(CASE WHEN bin > 0 THEN start + (bin - 1) * width END, 6) AS low, freq, round(100.0 * freq / sum(freq) OVER (), 6) AS rel, round(100.0 * sum(freq) OVER (ORDER BY bin) / sum(freq) OVER (), 6) AS cum FROM c",
         "p AS (SELECT least(0, min(dur)) AS start, (max(dur) - least(0, min(dur))) / 10 AS step FROM f WHERE dur IS NOT NULL)",
         "w AS (SELECT start, CASE WHEN step >= 10 THEN ceil(step - 1e-9) ELSE ceil(step * pow(10, ceil(1 - log10(step))) - 1e-9) / pow(10, ceil(1 - log10(step))) END AS width FROM p)",
         "c AS (SELECT CASE WHEN dur < start THEN 0 ELSE least(floor((dur - start) / width)::BIGINT + 1, 11) END AS bin, any_value(start) AS start, any_value(width) AS width, count(*) AS freq FROM f, w WHERE dur IS NOT NULL GROUP BY 1)"),
         lambda f: histogram.histogram(f, "dur 10").select("bin", F.round("low", 6).alias("low"), "freq", F.round("rel", 6).alias("rel"), F.round("cum", 6).alias("cum")))
on_flows("a18_order_statistics", sql("""SELECT proto, count(*) AS n, round(avg(v), 5) AS mean, min(v) AS min, max(v) AS max, median(v) AS median, min(CASE WHEN r > floor(0.95::DOUBLE * n) THEN v END) AS p95 FROM r GROUP BY proto""",
         "r AS (SELECT proto, dur AS v, row_number() OVER (PARTITION BY proto ORDER BY dur) AS r, count(*) OVER (PARTITION BY proto) AS n FROM f WHERE dur IS NOT NULL)"),
         lambda f: histogram.order_statistics(f, "dur", ("proto",)).select("proto", "n", F.round("mean", 5).alias("mean"), "min", "max", "median", "p95"))
on_flows("a18_mode", sql("SELECT proto, min(v) AS mode FROM (SELECT *, max(c) OVER (PARTITION BY proto) AS m FROM (SELECT proto, sbytes::DOUBLE AS v, count(*) AS c FROM f WHERE sbytes <> 0 GROUP BY 1, 2)) WHERE c = m AND c > 2 GROUP BY proto"), lambda f: histogram.order_statistics(f, "sbytes", ("proto",), nozero=True).where("mode is not null").select("proto", "mode"))
_PEERS = ("p AS (SELECT host, peer, bool_or(inside) AS inside FROM (SELECT saddr AS host, daddr AS peer, coalesce(sloc >= 3 AND dloc >= 3, false) AS inside FROM f UNION ALL SELECT daddr, saddr, coalesce(sloc >= 3 AND dloc >= 3, false) FROM f) WHERE host IS NOT NULL AND peer IS NOT NULL GROUP BY ALL)")
on_flows("a19_peers", sql("SELECT host, count(*) AS peers, count(*) FILTER (inside) AS local_peers FROM p GROUP BY host", _PEERS), inventory.peers)
on_flows("a19_peer_lists", sql("SELECT host, parts, list(peer ORDER BY peer) AS peers FROM (SELECT *, ceil(count(*) OVER (PARTITION BY host) / 20)::INT AS parts FROM p) GROUP BY host, parts", _PEERS),
         lambda f: inventory.peer_lists(f, 20).groupBy("host", "parts").agg(F.array_sort(F.flatten(F.collect_list("peers"))).alias("peers")))
on_flows("a19_peer_rows", sql("SELECT * FROM p", _PEERS), inventory.peer_rows)
_STRONG = ("c AS (SELECT daddr AS col, sum(coalesce(sbytes, 0)) AS v FROM f WHERE daddr IS NOT NULL GROUP BY daddr ORDER BY v DESC, col LIMIT 8)", "g AS (SELECT saddr AS row, daddr AS col, sum(coalesce(sbytes, 0)) AS v FROM f WHERE daddr IN (SELECT col FROM c) GROUP BY ALL)", "t AS (SELECT row, sum(v) AS v FROM g GROUP BY row ORDER BY v DESC, row NULLS FIRST LIMIT 8)")


def _long(m):
    cells = F.array(*(F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").alias("sbytes")) for c in m.columns[1:]))
    return m.select(F.col("saddr").alias("row"), F.explode(cells).alias("x")).select("row", "x.col", "x.sbytes")


on_flows("a20_matrix", sql("SELECT t.row, c.col, cast(coalesce(g.v, 0) AS BIGINT) AS sbytes FROM t CROSS JOIN c LEFT JOIN g ON g.row IS NOT DISTINCT FROM t.row AND g.col = c.col", *_STRONG), lambda f: _long(inventory.matrix(f, "saddr", "daddr", "sbytes", 8)))
on_flows("a20_edges", sql("SELECT saddr, daddr, cast(sum(coalesce(sbytes, 0)) AS BIGINT) AS sbytes FROM f WHERE daddr IN (SELECT daddr FROM f WHERE daddr IS NOT NULL GROUP BY daddr ORDER BY sum(coalesce(sbytes, 0)) DESC, daddr LIMIT 8) GROUP BY ALL"),
         lambda f: f.join(f.where("daddr is not null").groupBy("daddr").agg(F.sum(F.coalesce("sbytes", F.lit(0))).alias("v")).orderBy(F.desc("v"), "daddr").limit(8).select("daddr"), "daddr", "left_semi").groupBy("saddr", "daddr").agg(F.sum(F.coalesce("sbytes", F.lit(0))).alias("sbytes")))
on_flows("a21_rollup", sql("SELECT epoch_us(date_trunc('month', make_timestamp(stime_us))) AS period_us, proto, cast(sum(trans) AS BIGINT) AS trans, round(avg(dur), 6) AS mean, round(stddev_pop(dur), 4) AS stddev FROM f WHERE stime_us IS NOT NULL GROUP BY 1, 2"),
         lambda f: cluster.rollup(f, ["proto"], "month")[1].select(F.unix_micros("period").alias("period_us"), "proto", "trans", F.round("mean", 6).alias("mean"), F.round("stddev", 4).alias("stddev")))
on_flows("a22_paths", sql("SELECT saddr, daddr, count(*) AS hops, string_agg(node, ' -> ' ORDER BY sttl) AS path FROM n GROUP BY saddr, daddr",
         "n AS (SELECT saddr, daddr, sttl, CASE WHEN count(DISTINCT inode) > 1 THEN '{' || array_to_string(list_sort(list(DISTINCT inode)), ',') || '}' ELSE min(inode) END AS node FROM f WHERE inode IS NOT NULL AND sttl IS NOT NULL GROUP BY ALL)"),
         lambda f: inventory.paths(f).drop("as_path"))
on_flows("a22_hops", sql("SELECT saddr, daddr, inode, sttl, count(dur) AS n, round(avg(dur), 6) AS mean, round(stddev_pop(dur), 5) AS stddev, max(dur) AS max, min(dur) AS min FROM f WHERE inode IS NOT NULL AND sttl IS NOT NULL GROUP BY ALL"),
         lambda f: inventory.hop_statistics(f).withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 5)}))
on_flows("a23_ports", sql("SELECT addr, proto, cast(sum(n) AS BIGINT) AS ports, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM r GROUP BY addr, proto",
         "d AS (SELECT DISTINCT daddr AS addr, proto, dport FROM f WHERE proto IN (6, 17) AND dport IS NOT NULL AND daddr IS NOT NULL)",
         "r AS (SELECT addr, proto, min(dport) AS a, max(dport) AS b, count(*) AS n FROM (SELECT *, dport - row_number() OVER (PARTITION BY addr, proto ORDER BY dport) AS g FROM d) GROUP BY addr, proto, g)"), inventory.ports)
on_flows("a24_neighbours", sql("SELECT sid, mac, addr, min(s) AS first_us, max(coalesce(l, s)) AS last_us, count(*) AS n, count(*) OVER (PARTITION BY sid, addr) AS macs FROM e WHERE mac IS NOT NULL AND addr IS NOT NULL GROUP BY sid, mac, addr",
         "e AS (SELECT sid, lower(smac) AS mac, saddr AS addr, stime_us AS s, ltime_us AS l FROM f UNION ALL SELECT sid, lower(dmac), daddr, stime_us, ltime_us FROM f)"), inventory.neighbours)
on_flows("a25_payload_heads", sql("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY proto, dport ORDER BY n DESC, head) AS rank FROM (SELECT proto, dport, left(hex(suser), 8) AS head, count(*) AS n FROM f WHERE suser IS NOT NULL AND dport IS NOT NULL GROUP BY 1, 2, 3)) WHERE rank <= 3"), lambda f: inventory.payload_heads(f, 4, 3))
on_flows("a26_time_range", sql("SELECT min(stime_us) AS start_us, max(greatest(ltime_us, stime_us)) AS end_us FROM f"), inventory.time_range)
on_flows("a27_time_of_day", sql("SELECT hour(make_timestamp(stime_us)) AS hour, count(*) AS n FROM f WHERE stime_us IS NOT NULL GROUP BY 1"), lambda f: bins.fold_period(f, "day").groupBy(F.expr("cast(stime_us div 3600000000 as bigint)").alias("hour")).agg(F.count(F.lit(1)).alias("n")))
on_flows(
    "a29_two_probes",
    sql(
        "SELECT fsid, sid, saddr, daddr, proto, sport, dport, round(dldur, 6) AS dldur, dlstime, dlltime, dlspkt, dldpkt FROM (SELECT DISTINCT * EXCLUDE (rf, rv) FROM c WHERE rf = 1 OR rv = 1)",
        "r AS (SELECT sid, seq, saddr, daddr, proto, sport, dport, stime_us, ltime_us, dur, spkts, dpkts, min(autoid) AS a FROM f WHERE stime_us IS NOT NULL AND sid IS NOT NULL AND saddr IS NOT NULL AND daddr IS NOT NULL GROUP BY sid, seq, saddr, daddr, proto, sport, dport, stime_us, ltime_us, dur, spkts, dpkts, CASE WHEN seq IS NULL THEN autoid END)",
        """c AS (SELECT x.a AS fa, y.a AS va, x.sid AS fsid, y.sid AS sid, x.saddr, x.daddr, x.proto, x.sport, x.dport, y.dur - x.dur AS dldur, (y.stime_us - x.stime_us) / 1e6 AS dlstime, (y.ltime_us - x.ltime_us) / 1e6 AS dlltime, y.spkts - x.spkts AS dlspkt, y.dpkts - x.dpkts AS dldpkt,
  row_number() OVER (PARTITION BY x.a, y.sid ORDER BY abs(y.stime_us - x.stime_us), y.stime_us, y.a) AS rf, row_number() OVER (PARTITION BY y.a, x.sid ORDER BY abs(y.stime_us - x.stime_us), x.stime_us, x.a) AS rv
  FROM r x JOIN r y ON x.saddr = y.saddr AND x.daddr = y.daddr AND x.proto IS NOT DISTINCT FROM y.proto AND x.sport IS NOT DISTINCT FROM y.sport AND x.dport IS NOT DISTINCT FROM y.dport AND x.sid < y.sid AND abs(y.stime_us - x.stime_us) <= 60000000)""",
    ),
    lookups.two_probes,
)

# --- sort, limit, ranks
on_flows("o1_sort", sql(f"SELECT autoid, saddr, {BYTES} AS bytes FROM f ORDER BY bytes DESC, stime_us NULLS LAST, autoid"), lambda f: sorting.sort(f, "-bytes stime autoid").select("autoid", "saddr", fields.field("bytes")))
on_flows("o1_masked", sql("SELECT autoid, saddr_i & 4294901760 AS net, dport FROM f"), lambda f: sorting.sort(f, "saddr/16 -dport autoid").select("autoid", addresses.v4_net("saddr_i", 16).alias("net"), "dport"))
on_flows("o2_top", sql("SELECT saddr, count(*) AS n FROM f GROUP BY saddr ORDER BY n DESC, saddr NULLS LAST LIMIT 20"), lambda f: f.groupBy("saddr").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("saddr")).limit(20))
on_flows("o4_top_per_bin", sql(f"SELECT bin_us, saddr, bytes, rank FROM (SELECT *, row_number() OVER (PARTITION BY bin_us ORDER BY bytes DESC, saddr NULLS LAST) - 1 AS rank FROM (SELECT {DAY_BIN.format(s=86400000000)} AS bin_us, saddr, cast(sum({BYTES}) AS BIGINT) AS bytes FROM f WHERE stime_us IS NOT NULL GROUP BY 1, 2)) WHERE rank < 5"),
         lambda f: bins.time_bins(f, "1d", ["saddr"], "nomodify").select("bin_us", "saddr", (F.col("sbytes") + F.col("dbytes")).alias("bytes")).withColumn("rank", F.row_number().over(Window.partitionBy("bin_us").orderBy(F.desc("bytes"), F.asc_nulls_last("saddr"))) - 1).where("rank < 5"))
#: Mean and deviation as whole numbers, away from the halves that two engines round in two ways.
on_flows("w4_gaps", sql("SELECT saddr, daddr, proto, count(g) AS n, sum(us)::BIGINT AS total_us, min(g) AS intflowmin, max(g) AS intflowmax, floor(stddev_pop(g) * 1000 + 0.2503)::BIGINT AS sdev_ms FROM (SELECT *, round(g * 1e6)::BIGINT AS us FROM g) WHERE g IS NOT NULL GROUP BY saddr, daddr, proto",
         "g AS (SELECT *, (stime_us - lag(coalesce(ltime_us, stime_us)) OVER (PARTITION BY saddr, daddr, proto ORDER BY stime_us, autoid)) / 1e6 AS g FROM f WHERE stime_us IS NOT NULL)"),
         lambda f: inventory.gaps_between(f, KEY3).select(*KEY3, "n", F.round(F.col("intflow") * F.col("n") * 1e6).cast("bigint").alias("total_us"), "intflowmin", "intflowmax", F.floor(F.col("intflowsdev") * 1000 + 0.2503).cast("bigint").alias("sdev_ms")))
on_flows("s15_record_range", sql("SELECT autoid FROM (SELECT autoid, row_number() OVER (ORDER BY autoid) AS r FROM f) WHERE r BETWEEN 101 AND 200"), lambda f: bins.count_bins(f.select("autoid", "sbytes", "dbytes"), 100).where("bin = 1").select("autoid"))
on_flows("u_intersect", sql("SELECT saddr FROM f WHERE saddr IS NOT NULL INTERSECT SELECT daddr FROM f"), lambda f: f.where("saddr is not null").select("saddr").intersect(f.select("daddr")))

# --- joins
CIDR_SQL = "c AS (SELECT lo, hi, masklen, min({'label': label, 'locality': locality, 'country': country}) AS v FROM cidr_label GROUP BY ALL)"


def _labelled(spark, d):
    return lookups.longest_prefix(flows(spark, d), "saddr_i", table(spark, d, "cidr_label"), {"label": "src_label", "locality": "src_locality", "country": "src_country"})


add("j1_prefix_label", sql("SELECT f.autoid, b.v.label AS src_label, b.v.locality AS src_locality, b.v.country AS src_country FROM f LEFT JOIN b USING (saddr_i)", CIDR_SQL,
    "u AS (SELECT DISTINCT saddr_i FROM f WHERE saddr_i IS NOT NULL)", "b AS (SELECT saddr_i, arg_max(v, masklen) AS v FROM u JOIN c ON saddr_i BETWEEN lo AND hi GROUP BY saddr_i)"),
    lambda spark, d: _labelled(spark, d).select("autoid", "src_label", "src_locality", "src_country"))
for _mode, _pick in (("super", "arg_min(v, masklen)"), ("exact", "any_value(v) FILTER (masklen = 32)"), ("mask/16", "any_value(v) FILTER (masklen = 16)")):
    add(f"j1_{_mode.replace('/', '_')}", sql("SELECT f.autoid, b.v.label AS net_label FROM f LEFT JOIN b USING (saddr_i)", CIDR_SQL, "u AS (SELECT DISTINCT saddr_i FROM f WHERE saddr_i IS NOT NULL)", f"b AS (SELECT saddr_i, {_pick} AS v FROM u JOIN c ON saddr_i BETWEEN lo AND hi GROUP BY saddr_i)"),
        lambda spark, d, m=_mode: lookups.longest_prefix(flows(spark, d), "saddr_i", table(spark, d, "cidr_label"), {"label": "net_label", "locality": "_l", "country": "_c"}, mode=m).select("autoid", "net_label"))
add("j1_all_prefixes", sql("SELECT f.autoid, coalesce(labels, []) AS labels FROM f LEFT JOIN b USING (daddr_i)", "c AS (SELECT lo, hi, masklen, min(label) AS label FROM cidr_label GROUP BY ALL)",
    "b AS (SELECT daddr_i, list(label ORDER BY masklen) AS labels FROM (SELECT DISTINCT daddr_i FROM f WHERE daddr_i IS NOT NULL) JOIN c ON daddr_i BETWEEN lo AND hi GROUP BY daddr_i)"),
    lambda spark, d: lookups.matching_prefixes(flows(spark, d), "daddr_i", table(spark, d, "cidr_label"), "label").select("autoid", "labels"))
add("j2_listed", sql("SELECT autoid FROM f WHERE EXISTS (SELECT 1 FROM cidr_label WHERE masklen >= 25 AND saddr_i BETWEEN lo AND hi) OR EXISTS (SELECT 1 FROM cidr_label WHERE masklen >= 25 AND daddr_i BETWEEN lo AND hi)"),
    lambda spark, d: lookups.listed(flows(spark, d), table(spark, d, "cidr_label").where("masklen >= 25")).select("autoid"))
add("j2_not_listed", sql("SELECT autoid FROM f WHERE NOT EXISTS (SELECT 1 FROM cidr_label WHERE masklen >= 16 AND saddr_i BETWEEN lo AND hi)"),
    lambda spark, d: lookups.listed(flows(spark, d), table(spark, d, "cidr_label").where("masklen >= 16"), "src", invert=True).select("autoid"))
add("j3_services", sql("SELECT autoid, (SELECT arg_min(label, {'w': hi - lo, 'lo': lo, 'label': label}) FROM port_label p WHERE p.proto = f.proto AND f.dport BETWEEN lo AND hi AND label IS NOT NULL) AS service FROM f"),
    lambda spark, d: lookups.service_labels(flows(spark, d), "dport", table(spark, d, "port_label")).select("autoid", "service"))
TAGS = [("tcp and dst port 443", "tls", True), ("src co XA", "home", True), ("udp", "udp", False), ("bytes gt 100000", "big", True)]
on_flows("j4_flow_labels", sql("SELECT autoid, nullif(concat_ws(':', CASE WHEN proto = 6 AND dport = 443 THEN 'tls' END, CASE WHEN sco = 'XA' THEN 'home' END, CASE WHEN proto = 17 THEN 'udp' WHEN sbytes > 100000 OR dbytes > 100000 THEN 'big' END), '') AS tags FROM f"),
         lambda f: labels.flow_labels(f, TAGS).select("autoid", "tags"))
CUT, MONTH = _us(2013, 10, 3), _us(2013, 9, 20)
KEYS4 = ["saddr", "daddr", "proto", "dport"]
_BASE = "{n} AS (SELECT saddr, daddr, proto, dport, min(stime_us) AS s, max(greatest(ltime_us, stime_us)) - min(stime_us) AS p, bool_or(proto = 6 AND status & 1 = 1) AS syn FROM f WHERE stime_us >= {a} AND stime_us < {b} GROUP BY ALL)"
_TURNED = "LEFT JOIN {n} {n}r ON {n}.s IS NULL AND {n}r.saddr = f.daddr AND {n}r.daddr = f.saddr AND {n}r.proto = f.proto AND {n}r.dport = f.sport AND f.proto <> 50 AND NOT (coalesce(f.proto = 6 AND f.status & 1 = 1, false) AND coalesce({n}r.syn, false))"
on_flows(
    "j5_score",
    sql(
        """SELECT autoid, greatest(CASE WHEN t > s THEN CASE WHEN p > 2419200000000 THEN 4 WHEN p > 604800000000 THEN 3 ELSE 1 END WHEN t = s THEN 1 ELSE 0 END,
  CASE WHEN t > ms THEN CASE WHEN mp > 2419200000000 THEN 4 WHEN mp > 604800000000 THEN 3 ELSE 0 END WHEN t = ms THEN 1 ELSE 0 END, CASE WHEN p = mp THEN 1 ELSE 0 END) AS score FROM k""",
        _BASE.format(n="a", a=0, b=CUT), _BASE.format(n="m", a=MONTH, b=CUT),
        f"""k AS (SELECT f.autoid, f.stime_us AS t, coalesce(a.s, ar.s) AS s, coalesce(a.p, ar.p) AS p, coalesce(m.s, mr.s) AS ms, coalesce(m.p, mr.p) AS mp
  FROM f LEFT JOIN a USING (saddr, daddr, proto, dport) LEFT JOIN m USING (saddr, daddr, proto, dport) {_TURNED.format(n="a")} {_TURNED.format(n="m")} WHERE f.stime_us >= {CUT})""",
    ),
    lambda f: lookups.score(f.where(F.col("stime_us") >= CUT), lookups.baseline(f.where(F.col("stime_us") < CUT), KEYS4), lookups.baseline(f.where((F.col("stime_us") >= MONTH) & (F.col("stime_us") < CUT)), KEYS4), KEYS4).select("autoid", "score"),
)
on_flows("j10_known", sql(f"SELECT autoid, CASE WHEN EXISTS (SELECT 1 FROM f g WHERE g.stime_us < {CUT} AND g.saddr = f.saddr AND g.daddr = f.daddr) THEN 2 ELSE -2 END AS match FROM f WHERE stime_us >= {CUT}"),
         lambda f: lookups.known(f.where(F.col("stime_us") >= CUT), f.where(F.col("stime_us") < CUT), ["saddr", "daddr"]).select("autoid", "match"))
add("j6_events", sql(
    "SELECT autoid, list_sort(list(DISTINCT prog)) AS programs, count(*) AS events FROM l JOIN o ON l.sid = o.sid AND l.proto = o.proto AND l.port = o.port WHERE abs(stime_us - ts_us) <= 1728000000000 GROUP BY autoid",
    "r AS (SELECT DISTINCT sid, ts, prog, payload FROM raevent WHERE payload IS NOT NULL)",
    r"o AS (SELECT sid, epoch_us(ts) AS ts_us, string_split(prog, '/')[-1] AS prog, CASE WHEN x LIKE '%tcp' THEN 6 ELSE 17 END AS proto, split_part(x, '/', 1)::INT AS port FROM (SELECT *, unnest(regexp_extract_all(payload, '(\d{1,5}/(?:tcp|udp))')) AS x FROM r))",
    "l AS (SELECT autoid, sid, proto, stime_us, sport AS port FROM f WHERE stime_us IS NOT NULL AND sport IS NOT NULL UNION SELECT autoid, sid, proto, stime_us, dport FROM f WHERE stime_us IS NOT NULL AND dport IS NOT NULL)"),
    lambda spark, d: lookups.correlate(flows(spark, d), lookups.open_ports(table(spark, d, "raevent")), 20 * 86_400))


def _probe_status(spark, d):
    man = table(spark, d, "man").select("sid", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.lower(F.trim("cause")).alias("cause"), "drift")
    return lookups.as_of(flows(spark, d).select("autoid", "sid", "stime_us"), man, "sid", "stime_us", "ts_us", ["cause", "drift"])


_STATUS = "m AS (SELECT sid, ts_us, arg_max({'cause': cause, 'drift': drift}, (coalesce('1' || cause, '0'), coalesce(drift, -1000000000))) AS v FROM (SELECT sid, epoch_us(ts) AS ts_us, lower(trim(cause)) AS cause, drift FROM man WHERE sid IS NOT NULL AND ts IS NOT NULL) GROUP BY sid, ts_us)"
add("j7_as_of", sql("SELECT autoid, v.cause AS cause, v.drift AS drift FROM f ASOF LEFT JOIN m ON f.sid = m.sid AND f.stime_us >= m.ts_us", _STATUS), lambda spark, d: _probe_status(spark, d).select("autoid", "cause", "drift"))
add("j7_as_of_time", sql("SELECT autoid, m.ts_us AS status_us FROM f ASOF LEFT JOIN m ON f.sid = m.sid AND f.stime_us >= m.ts_us", "m AS (SELECT DISTINCT sid, epoch_us(ts) AS ts_us FROM man WHERE sid IS NOT NULL AND ts IS NOT NULL)"),
    lambda spark, d: lookups.as_of(flows(spark, d).select("autoid", "sid", "stime_us"), table(spark, d, "man").select("sid", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us")).withColumn("status_us", F.col("ts_us")), "sid", "stime_us", "ts_us", ["status_us"]).select("autoid", "status_us"))
add("x17_clock", sql("SELECT autoid, stime_us - coalesce(v.drift, 0) AS corrected_us FROM f ASOF LEFT JOIN m ON f.sid = m.sid AND f.stime_us >= m.ts_us", _STATUS), lambda spark, d: _probe_status(spark, d).select("autoid", (F.col("stime_us") - F.coalesce("drift", F.lit(0))).alias("corrected_us")))
on_flows("j8_scans", sql("SELECT saddr, cast(sum(trans) AS BIGINT) AS trans, count(DISTINCT daddr) AS targets FROM f WHERE saddr IS NOT NULL AND daddr NOT IN (SELECT a FROM (SELECT saddr AS a, sappbytes AS b FROM f UNION ALL SELECT daddr, dappbytes FROM f) WHERE b > 0 AND a IS NOT NULL) GROUP BY saddr HAVING sum(trans) > 2"), lambda f: lookups.dark_scans(f, 2))
on_flows("j9_mutual_peers", sql("SELECT DISTINCT f.saddr AS host, f.daddr AS peer FROM f JOIN (SELECT DISTINCT saddr, daddr FROM f) g ON g.saddr = f.daddr AND g.daddr = f.saddr WHERE f.saddr <> f.daddr"), lookups.mutual_peers)
on_flows("j11_intersect", sql("SELECT saddr, daddr FROM f WHERE proto = 6 INTERSECT SELECT saddr, daddr FROM f WHERE proto = 17"), lambda f: lookups.intersect(f.where("proto = 6"), f.where("proto = 17"), ["saddr", "daddr"]))
on_flows("j12_vendors", sql("SELECT vendor, count(*) AS n FROM f LEFT JOIN (VALUES ('02:00:00', 'local lab'), ('00:00:5e', 'registry')) v(oui, vendor) ON lower(substring(smac, 1, 8)) = oui WHERE smac IS NOT NULL GROUP BY vendor"),
         lambda f: lookups.vendors(f, "smac", f.sparkSession.createDataFrame([("02:00:00", "local lab"), ("00:00:5E", "registry")], "oui string, vendor string")).where("smac is not null").groupBy("vendor").agg(F.count(F.lit(1)).alias("n")))
on_flows("x12_mac_classes", sql("SELECT class, count(*) AS n FROM (SELECT CASE WHEN lower(smac) = 'ff:ff:ff:ff:ff:ff' THEN 'bcast' WHEN ('0x' || left(smac, 2))::INT & 1 = 1 THEN 'mcast' WHEN ('0x' || left(smac, 2))::INT & 2 = 2 THEN 'local' ELSE 'univ' END AS class FROM f WHERE smac IS NOT NULL) GROUP BY class"), lambda f: f.where("smac is not null").groupBy(addresses.mac_class("smac").alias("class")).agg(F.count(F.lit(1)).alias("n")))
on_flows("x4_address_class", sql("SELECT class, count(*) AS n FROM (SELECT " + V4_CASE.replace("number", "daddr_i") + V6_CASE.replace("addr", "daddr") + " AS class FROM f) GROUP BY class"), lambda f: f.groupBy(addresses.address_class("daddr_i", "daddr").alias("class")).agg(F.count(F.lit(1)).alias("n")))
on_flows("x4_numbers", sql("SELECT autoid, saddr_i AS number FROM f"), lambda f: f.select("autoid", addresses.v4_number("saddr").alias("number")))
_PAIRS = (
    "j AS (SELECT autoid, daddr, label, json_valid(label) AND label LIKE '{%' AS ok FROM f WHERE label IS NOT NULL)",
    "k AS (SELECT autoid, daddr, label, unnest(json_keys(CASE WHEN ok THEN label ELSE '{}' END)) AS k FROM j)",
    """e AS (SELECT autoid, daddr, k, unnest(CASE json_type(label, '$."' || k || '"') WHEN 'NULL' THEN [] WHEN 'ARRAY' THEN json_extract_string(json_extract(label, '$."' || k || '"'), '$[*]') ELSE [json_extract_string(label, '$."' || k || '"')] END) AS v FROM k WHERE k <> ''
  UNION ALL SELECT autoid, daddr, split_part(p, '=', 1), split_part(p, '=', 2) FROM (SELECT autoid, daddr, unnest(string_split(label, ':')) AS p FROM j WHERE NOT ltrim(label) LIKE '{%' AND label LIKE '%=%') WHERE split_part(p, '=', 1) <> '')""",
)
_JSON = "'{' || string_agg('\"' || k || '\":[\"' || array_to_string(vs, '\",\"') || '\"]', ',' ORDER BY k) || '}'"
on_flows("x6_labels", sql(f"SELECT j.autoid, label FROM j LEFT JOIN (SELECT autoid, {_JSON} AS label FROM (SELECT autoid, k, list(v) AS vs FROM e GROUP BY ALL) GROUP BY autoid) x USING (autoid)".replace("SELECT j.autoid, label", "SELECT j.autoid, x.label AS label"), *_PAIRS),
         lambda f: f.where("label is not null").select("autoid", labels.text(labels.parsed("label")).alias("label")))
on_flows("x6_label_keys", sql("SELECT json_extract_string(label, '$.svc') AS svc, count(*) AS n FROM f WHERE label LIKE '{%}' AND json_extract_string(label, '$.svc') IS NOT NULL GROUP BY 1"), lambda f: f.where("label like '{%}'").select(labels.parsed("label")["svc"][0].alias("svc")).where("svc is not null").groupBy("svc").agg(F.count(F.lit(1)).alias("n")))
on_flows("x16_label_union", sql(f"SELECT daddr, {_JSON} AS label FROM (SELECT daddr, k, list_sort(list(DISTINCT v)) AS vs FROM e GROUP BY ALL) GROUP BY daddr", *_PAIRS),
         lambda f: labels.merged_labels(f.where("label is not null"), ["daddr"]))
on_flows("x13_sha1", sql("SELECT autoid, sha1(coalesce(saddr, '')) AS digest FROM f"), lambda f: f.select("autoid", F.sha1(F.coalesce("saddr", F.lit(""))).alias("digest")))
on_flows("x15_direction_hint", sql("SELECT CASE WHEN sloc >= 3 AND dloc >= 3 THEN 'inside' WHEN sloc >= 3 THEN 'out' WHEN dloc >= 3 THEN 'in' WHEN sloc IS NULL AND dloc IS NULL THEN 'unknown' ELSE 'outside' END AS way, count(*) AS n FROM f GROUP BY 1"),
         lambda f: f.groupBy(labels.way().alias("way")).agg(F.count(F.lit(1)).alias("n")))
_MAP = (
    "i AS (SELECT *, split_part(inode, '.', 1)::BIGINT * 16777216 + split_part(inode, '.', 2)::BIGINT * 65536 + split_part(inode, '.', 3)::BIGINT * 256 + split_part(inode, '.', 4)::BIGINT AS i FROM f WHERE regexp_full_match(inode, '(\\d+\\.){3}\\d+'))",
    "e AS (SELECT saddr_i AS a, autoid * 4 AS t FROM f UNION ALL SELECT daddr_i, autoid * 4 + 1 FROM f UNION ALL SELECT i, autoid * 4 + 2 FROM i)", "s AS (SELECT a, min(t) AS t, a >= 3758096384 OR a & 255 = 255 AS kept, a & 4294967040 AS net FROM e WHERE a IS NOT NULL GROUP BY a)",
    "n AS (SELECT net, row_number() OVER (ORDER BY min(t)) AS no FROM s WHERE NOT kept GROUP BY net)", "k AS (SELECT s.*, no, row_number() OVER (PARTITION BY s.net, kept ORDER BY t) AS h FROM s LEFT JOIN n USING (net))",
    "m AS (SELECT a AS addr_i, CASE WHEN kept THEN a ELSE (655360 + no - 1) % 14680064 * 256 + h % 255 END AS anon_i FROM k)",
)
_DOTTED = "(({a} >> 24) & 255) || '.' || (({a} >> 16) & 255) || '.' || (({a} >> 8) & 255) || '.' || ({a} & 255)"
_PORT = "CASE WHEN {p} < 1024 THEN {p} WHEN {p} < 49152 THEN 1024 + ({p} - 1024 + 17) % 48128 ELSE 49152 + ({p} - 49152 + 17) % 16384 END"
on_flows("x7_anonymize", sql(
    "SELECT f.autoid, coalesce(" + _DOTTED.format(a="ms.anon_i") + ", 'x:' || left(sha256(saddr), 16)) AS saddr, coalesce(" + _DOTTED.format(a="md.anon_i") + ", 'x:' || left(sha256(daddr), 16)) AS daddr, "
    + _PORT.format(p="sport") + " AS sport, " + _PORT.format(p="dport") + " AS dport, f.stime_us - 86400000000 AS stime_us, f.seq + 1000 AS seq, f.sbytes, coalesce(" + _DOTTED.format(a="mi.anon_i") + ", 'x:' || left(sha256(f.inode), 16)) AS inode, CASE WHEN sas = 0 THEN 0 ELSE xs.n END AS sas, CASE WHEN das = 0 THEN 0 ELSE xd.n END AS das, cs.n AS smac, cd.n AS dmac "
    "FROM f LEFT JOIN m ms ON ms.addr_i = saddr_i LEFT JOIN m md ON md.addr_i = daddr_i LEFT JOIN (SELECT autoid, i FROM i) i USING (autoid) LEFT JOIN m mi ON mi.addr_i = i LEFT JOIN x xs ON xs.v = sas LEFT JOIN x xd ON xd.v = das LEFT JOIN c cs ON cs.v = lower(smac) LEFT JOIN c cd ON cd.v = lower(dmac)", *_MAP,
    "x AS (SELECT v, 4200000000 + row_number() OVER (ORDER BY min(t)) - 1 AS n FROM (SELECT sas AS v, autoid * 4 AS t FROM f UNION ALL SELECT das, autoid * 4 + 1 FROM f) WHERE v <> 0 GROUP BY v)",
    "y AS (SELECT v, min(t) AS t, v = 'ff:ff:ff:ff:ff:ff' OR ('0x' || left(v, 2))::INT & 1 = 1 AS kept FROM (SELECT lower(smac) AS v, autoid * 4 AS t FROM f UNION ALL SELECT lower(dmac), autoid * 4 + 1 FROM f) WHERE v IS NOT NULL GROUP BY v)",
    "c AS (SELECT v, CASE WHEN kept THEN v ELSE left(v, 8) || ':' || regexp_replace(printf('%06x', row_number() OVER (PARTITION BY kept ORDER BY t) - 1), '(..)(..)(..)', '\\1:\\2:\\3') END AS n FROM y)"),
    lambda f: anonymize.anonymize(f, port_offset=17, time_offset_us=-86_400_000_000, seq_offset=1000, keep_vendor=True).select("autoid", "saddr", "daddr", "sport", "dport", "stime_us", "seq", "sbytes", "inode", "sas", "das", "smac", "dmac"))
on_flows("x7_address_map", sql("SELECT addr_i, anon_i FROM m", *_MAP), anonymize.address_map)
SIGNATURES = [labels.Signature("greeting", 6, 443, "src", "68656C6C6F2D"), labels.Signature("control", 17, 53, "src", "3?00??07"), labels.Signature("short", 17, 53, "src", "0?")]
on_flows("x9_signatures", sql("""SELECT autoid, CASE WHEN proto = 6 AND hex(suser) LIKE '68656C6C6F2D%' THEN 'greeting' WHEN proto = 17 AND hex(suser) LIKE '3_00__07%' AND (coalesce(dport = 53, false) OR coalesce(sport = 53, false)) THEN 'control'
  WHEN proto = 17 AND hex(suser) LIKE '0_%' AND (coalesce(dport = 53, false) OR coalesce(sport = 53, false)) THEN 'short' END AS service FROM f"""), lambda f: labels.match_signatures(f, SIGNATURES).select("autoid", "service"))

# --- management and event records
add("s14_management", "SELECT sid, lower(trim(cause)) AS cause, count(*) AS n, max(pktsrcvd) AS pkts FROM (SELECT DISTINCT * FROM man) GROUP BY ALL", lambda spark, d: inventory.management(table(spark, d, "man")))
add("s9_events", r"SELECT sid, string_split(prog, '/')[-1] AS prog, count(*) AS n, round(sum(nullif(regexp_extract(payload, 'load ([0-9.]+)', 1), '')::DOUBLE), 2) AS load FROM (SELECT DISTINCT * FROM raevent) GROUP BY ALL",
    lambda spark, d: inventory.events(table(spark, d, "raevent")).withColumn("load", F.round("load", 2)))
on_flows("k8_seconds", sql("SELECT stime_us // 1000000 AS second, sid, min(autoid) AS first, max(autoid) AS last, count(*) AS n FROM f WHERE stime_us IS NOT NULL GROUP BY ALL"),
         lambda f: sinks.time_index(f).groupBy("second", "sid").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")))
