"""Readers of flow records in files other than the stored tables: text with a title line, JSON, sensor logs, exports."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.addresses import v4_number, v4_text
from ..functions.fields import PROTOCOLS, SERVICES

_DDL = (
    "autoid bigint, sid string, inf string, seq bigint, stime timestamp, ltime timestamp, stime_us bigint, ltime_us bigint, rtime timestamp, dur double, proto smallint, saddr string, daddr string, "
    "saddr_i bigint, daddr_i bigint, sport int, dport int, trans bigint, spkts bigint, dpkts bigint, sbytes bigint, dbytes bigint, sappbytes bigint, dappbytes bigint, sloss int, dloss int, "
    "sttl smallint, dttl smallint, stos smallint, dtos smallint, status bigint, smac string, dmac string, inode string, sco string, sas bigint, sloc smallint, dco string, das bigint, dloc smallint, suser binary, duser binary, label string"
)
_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "smallint": T.ShortType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "timestamp": T.TimestampType()}
FLOW_SCHEMA = T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in _DDL.split(", "))])
#: Titles of printed columns and the fields they stand for.
TITLES = {
    "StartTime": "stime", "LastTime": "ltime", "SrcId": "sid", "Dur": "dur", "Proto": "proto", "SrcAddr": "saddr", "DstAddr": "daddr", "Sport": "sport", "Dport": "dport", "Trans": "trans", "SrcPkts": "spkts",
    "DstPkts": "dpkts", "SrcBytes": "sbytes", "DstBytes": "dbytes", "SAppBytes": "sappbytes", "DAppBytes": "dappbytes", "SrcLoss": "sloss", "DstLoss": "dloss", "sTtl": "sttl", "dTtl": "dttl", "sTos": "stos",
    "dTos": "dtos", "SrcMac": "smac", "DstMac": "dmac", "sCo": "sco", "dCo": "dco", "sAS": "sas", "dAS": "das", "sLoc": "sloc", "dLoc": "dloc", "Label": "label", "Seq": "seq", "Inode": "inode",
}
#: Columns of a network sensor's connection log and the fields they stand for; a '+' adds to the label.
CONN_LOG = {
    "ts": "stime", "uid": "+uid", "id.orig_h": "saddr", "id.orig_p": "sport", "id.resp_h": "daddr", "id.resp_p": "dport", "proto": "proto", "service": "+service", "duration": "dur", "orig_bytes": "sappbytes",
    "resp_bytes": "dappbytes", "conn_state": "+conn_state", "orig_pkts": "spkts", "orig_ip_bytes": "sbytes", "resp_pkts": "dpkts", "resp_ip_bytes": "dbytes", "missed_bytes": "+missed",
}


def _seconds(c: Column) -> Column:
    """Microseconds of a time given as epoch seconds or as a timestamp text; null for what is neither."""
    number = F.when(c.rlike(r"^-?\d+(\.\d+)?$"), c.try_cast("decimal(20,6)") * 1_000_000)
    return F.coalesce(number.cast("bigint"), F.unix_micros(F.try_to_timestamp(F.regexp_replace(c, r"^(\d{4})[/.](\d\d)[/.](\d\d)[. T]", "$1-$2-$3 "))))


def _proto(c: Column) -> Column:
    names = F.create_map(*(x for k, v in PROTOCOLS.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(c.try_cast("smallint"), names[F.lower(F.trim(c))].cast("smallint"))


def _port(c: Column) -> Column:
    names = F.create_map(*(x for k, v in SERVICES.items() for x in (F.lit(k), F.lit(v))))
    hexed = F.when(c.rlike("^0x[0-9a-fA-F]{1,4}$"), F.conv(F.substring(c, 3, 8), 16, 10))
    return F.coalesce(c.try_cast("int"), hexed.cast("int"), names[F.lower(F.trim(c))])


def to_flows(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Any table as flow records: ``mapping`` takes its columns to fields, '+name' adds the value to the JSON label.

    Values that do not parse become null, columns without mapping are left out, fields without column are null. Of
    several columns for one field the first that is not null counts.
    """
    taken: dict[str, Column] = {}
    notes = []
    for c in df.columns:
        target = mapping.get(c)
        text = F.col(f"`{c}`").cast("string")
        if target and target.startswith("+"):
            notes.append((target[1:], text))
        elif target:
            taken[target] = F.coalesce(taken[target], text) if target in taken else text
    out: dict[str, Column] = {}
    for name in ("stime", "ltime", "rtime"):
        if name in taken:
            out[f"{name}_us"] = _seconds(taken[name])
    dur = taken.get("dur", F.lit(None)).try_cast("double")
    if "ltime_us" not in out and "stime_us" in out:
        out["ltime_us"] = out["stime_us"] + F.round(dur * 1e6).cast("bigint")
    if "dur" not in taken and "ltime_us" in out and "stime_us" in out:
        dur = (out["ltime_us"] - out["stime_us"]) / 1e6
    out["dur"] = dur
    for name in ("stime", "ltime", "rtime"):
        if f"{name}_us" in out:
            out[name] = F.timestamp_micros(out[f"{name}_us"])
    for name, column in taken.items():
        if name not in out:
            out[name] = {"proto": _proto, "sport": _port, "dport": _port}.get(name, lambda c: c)(column)
    for s in ("s", "d"):
        if f"{s}addr" in out:
            out[f"{s}addr_i"] = v4_number(F.trim(out[f"{s}addr"]))
    if notes:
        extra = F.to_json(F.struct(*(v.alias(k) for k, v in notes)))
        out["label"] = F.when(extra != "{}", extra)
    out.setdefault("trans", F.lit(1))
    out.setdefault("autoid", F.monotonically_increasing_id())
    return df.select(*((out[f.name].try_cast(f.dataType) if f.name in out and f.dataType != T.BinaryType() else out.get(f.name, F.lit(None)).cast(f.dataType)).alias(f.name) for f in FLOW_SCHEMA))


def _files(reader, paths: list[str] | str, recursive: bool):
    return reader.option("recursiveFileLookup", str(recursive).lower()), ([paths] if isinstance(paths, str) else paths)


def read_flows(spark: SparkSession, paths: list[str] | str, recursive: bool = False) -> DataFrame:
    """Stored flow tables, one or many paths, in one DataFrame; ``recursive`` descends into directories."""
    reader, at = _files(spark.read, paths, recursive)
    return reader.parquet(*at)


def read_text(spark: SparkSession, paths: list[str] | str, separator: str = ",", titles: dict[str, str] | None = None, recursive: bool = False) -> DataFrame:
    """Text with a title line and any separator; compressed files by their extension (gz, bz2, ...)."""
    reader, at = _files(spark.read, paths, recursive)
    df = reader.csv(at, header=True, sep=separator, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return to_flows(df, {**{f.name: f.name for f in FLOW_SCHEMA}, **(titles or TITLES)})


def read_json(spark: SparkSession, paths: list[str] | str, mapping: dict[str, str] | None = None, recursive: bool = False) -> DataFrame:
    """One JSON object a line. Only mapped keys are read, as text, so no pass is spent on finding a schema."""
    names = {f.name: f.name for f in FLOW_SCHEMA}
    mapping = mapping or names | {k: v for k, v in TITLES.items() if k.lower() not in names}
    reader, at = _files(spark.read, paths, recursive)
    schema = T.StructType([T.StructField(k, T.StringType()) for k in mapping])
    return to_flows(reader.schema(schema).json(at), mapping)


def read_conn_log(spark: SparkSession, paths: list[str] | str, recursive: bool = False) -> DataFrame:
    """A sensor's tab-separated connection log: '#fields' names the columns, '-' is missing, lines with '#' are comments."""
    reader, at = _files(spark.read, paths, recursive)
    lines = _files(spark.read, paths, recursive)[0].text(at)
    heads = lines.where(F.col("value").startswith("#fields"))
    layouts = [r[0].split("\t")[1:] for r in heads.select("value").distinct().limit(2).collect()] or [list(CONN_LOG)]
    if len(layouts) == 1:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in layouts[0]])
        return to_flows(reader.schema(schema).csv(at, sep="\t", comment="#", nullValue="-", enforceSchema=True), CONN_LOG)
    # files differ in their columns: every line is read by the title line of its own file
    file = F.col("_metadata.file_path").alias("file")
    titles = heads.select(file, F.slice(F.split("value", "\t"), 2, 10_000).alias("names")).groupBy("file").agg(F.max("names").alias("names"))
    rows = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(file, F.split("value", "\t").alias("parts")).join(titles, "file")
    part = lambda n: F.nullif(F.get("parts", F.array_position("names", n).cast("int") - 1), F.lit("-"))
    return to_flows(rows.select(*(F.when(F.array_contains("names", n), part(n)).alias(n) for n in CONN_LOG)), CONN_LOG)


#: Columns of the text form of flow archives and the fields they stand for.
ARCHIVE_TEXT = {
    "exaddr": "sid", "dpkts": "spkts", "doctets": "sbytes", "srcaddr": "saddr", "dstaddr": "daddr", "srcport": "sport", "dstport": "dport", "prot": "proto", "tos": "stos", "src_as": "sas", "dst_as": "das",
    "_start": "stime", "_length": "dur", "nexthop": "+nexthop", "tcp_flags": "+tcp_flags",
}


def read_archive_text(spark: SparkSession, paths: list[str] | str, recursive: bool = False) -> DataFrame:
    """Flow archives exported as text: a title line '#:unix_secs,unix_nsecs,...', lasting from unix time for last - first ms."""
    reader, at = _files(spark.read, paths, recursive)
    df = reader.csv(at, header=True, inferSchema=False)
    df = df.toDF(*(c.removeprefix("#:").strip().lower() for c in df.columns))
    start = F.concat_ws(".", F.col("unix_secs"), F.lpad(F.floor(F.col("unix_nsecs").try_cast("bigint") / 1000).cast("string"), 6, "0"))
    length = (F.col("last").try_cast("bigint") - F.col("first").try_cast("bigint")) / 1000
    return to_flows(df.withColumns({"_start": start, "_length": length}), ARCHIVE_TEXT)


def read_jdbc(spark: SparkSession, url: str, name: str, predicates: list[str], properties: dict[str, str] | None = None) -> DataFrame:
    """A database table, one partition for each predicate (such as ranges of time), which the database evaluates."""
    return spark.read.jdbc(url, name, predicates=predicates, properties=properties or {})


def read_named_tables(spark: SparkSession, pattern: str, start: datetime, end: datetime, where: str = "true") -> DataFrame:
    """Stored tables named by time, such as 'flows/day_%Y_%m_%d': those of [start, end] that exist, with a condition."""
    step = timedelta(hours=1) if re.search("%[HI]", pattern) else timedelta(days=1)
    names, at = [], start
    while at <= end:
        names.append(at.strftime(pattern))
        at += step
    names.append(end.strftime(pattern))
    jvm = spark._jvm.org.apache.hadoop.fs
    there = [n for n in dict.fromkeys(names) if jvm.Path(n).getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm.Path(n))]
    if not there:
        return spark.createDataFrame([], FLOW_SCHEMA)
    lo, hi = (int(t.timestamp() * 1_000_000) for t in (start, end))
    return spark.read.parquet(*there).where(F.col("stime_us").between(lo, hi)).where(where)


def read_lines(spark: SparkSession, paths: list[str] | str, recursive: bool = False) -> DataFrame:
    """Lines of text files, also of those that Spark has no codec for (xz); such a file is one task, read as a stream."""
    import io
    import lzma

    reader, at = _files(spark.read.format("binaryFile"), paths, recursive)

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                source = lzma.open(io.BytesIO(content), "rt", errors="replace") if path.endswith((".xz", ".lzma")) else io.TextIOWrapper(io.BytesIO(content), errors="replace")
                block = []
                for line in source:
                    block.append(line.rstrip("\r\n"))
                    if len(block) == 10_000:
                        yield pd.DataFrame({"value": block})
                        block = []
                yield pd.DataFrame({"value": block})

    return reader.load(at).select("path", "content").mapInPandas(lines, "value string")


def read_xz_text(spark: SparkSession, paths: list[str] | str, separator: str = ",", titles: dict[str, str] | None = None) -> DataFrame:
    """:func:`read_text` for xz files: every line equal to the first file's title line is one."""
    rows = read_lines(spark, paths)
    head = rows.first()
    if head is None:
        return spark.createDataFrame([], FLOW_SCHEMA)
    schema = T.StructType([T.StructField(n.strip(), T.StringType()) for n in head[0].split(separator)])
    parsed = spark.read.schema(schema).option("sep", separator).csv(rows.where(F.col("value") != head[0]).rdd.map(lambda r: r[0]))
    return to_flows(parsed, {**{f.name: f.name for f in FLOW_SCHEMA}, **(titles or TITLES)})


def scan_range(df: DataFrame, start: int, end: int) -> DataFrame:
    """Stored rows from number ``start`` up to but not including ``end``; the reader skips row groups outside."""
    return df.where((F.col("autoid") >= start) & (F.col("autoid") < end))


# --- binary exports of routers

#: Layouts of export packets in network byte order. Version 1 and 5 headers and records.
V5_HEADER, V5_RECORD = struct.Struct("!HHIIIIBBH"), struct.Struct("!IIIHHIIIIHHBBBBHHBBH")
V1_HEADER, V1_RECORD = struct.Struct("!HHIII"), struct.Struct("!IIIHHIIIIHHHBBBBBBI")
V6_HEADER, V6_RECORD = V5_HEADER, struct.Struct("!IIIHHIIIIHHBBBBHHBBBBI")
V7_HEADER, V7_RECORD = struct.Struct("!HHIIIII"), struct.Struct("!IIIHHIIIIHHBBBBHHBBHI")
V8_HEADER = struct.Struct("!HHIIIIBBBBI")
#: Version 8, by method of aggregation: flows, packets, octets, first and last, then the names of what follows.
V8_RECORDS = {
    1: (struct.Struct("!IIIIIHHHH"), ("sas", "das", None, None)), 2: (struct.Struct("!IIIIIBBHHH"), ("proto", None, None, "sport", "dport")),
    3: (struct.Struct("!IIIIIIBBHHH"), ("src", None, None, "sas", None, None)), 4: (struct.Struct("!IIIIIIBBHHH"), ("dst", None, None, "das", None, None)),
    5: (struct.Struct("!IIIIIIIBBHHHHH"), ("src", "dst", None, None, None, "sas", "das", None, None)),
}
EXPORT = "version int, exporter_seq bigint, stime_us bigint, ltime_us bigint, saddr_i bigint, daddr_i bigint, sport int, dport int, proto smallint, spkts bigint, sbytes bigint, stos smallint, flags int, sas bigint, das bigint"


def decode_export(data: bytes) -> Iterator[tuple]:
    """Flow records of consecutive export packets of version 1, 5, 6, 7 or 8; a cut-off packet or zeros to the end end it.

    Version 8 holds aggregates; what an aggregate does not have is null. Packets do not tell their length, so one of another
    version or with an unknown aggregate is an error: what follows could not be found.
    """
    at = 0
    while at + 16 <= len(data):
        version, count = struct.unpack_from("!HH", data, at)
        layout = {1: (V1_HEADER, V1_RECORD), 5: (V5_HEADER, V5_RECORD), 6: (V6_HEADER, V6_RECORD), 7: (V7_HEADER, V7_RECORD), 8: (V8_HEADER, None)}.get(version)
        if layout is None:
            if not any(data[at:]):
                return
            raise ValueError(f"export packet of version {version} at byte {at}")
        if at + layout[0].size > len(data):
            return
        head = layout[0].unpack_from(data, at)
        names = ()
        if version == 8:
            if head[8] not in V8_RECORDS:
                if at + V8_HEADER.size >= len(data):
                    return
                raise ValueError(f"unknown aggregate {head[8]} at byte {at}")
            layout, names = (V8_HEADER, V8_RECORDS[head[8]][0]), V8_RECORDS[head[8]][1]
        uptime, sec, nsec = head[2:5]
        boot = sec * 1_000_000 + nsec // 1000 - uptime * 1000
        at += layout[0].size
        for _ in range(count):
            if at + layout[1].size > len(data):
                return
            r = layout[1].unpack_from(data, at)
            at += layout[1].size
            if version == 8:
                v = {k: x for k, x in zip(names, r[5:]) if k}
                yield version, head[5], boot + r[3] * 1000, boot + r[4] * 1000, v.get("src"), v.get("dst"), v.get("sport"), v.get("dport"), v.get("proto"), r[1], r[2], None, None, v.get("sas"), v.get("das")
                continue
            src, dst, _, _, _, pkts, octets, first, last, sport, dport = r[:11]
            if version == 1:
                proto, tos, flags, sas, das, seq = r[12], r[13], r[14], None, None, None
            else:
                flags, proto, tos, sas, das, seq = r[12], r[13], r[14], r[15], r[16], head[5]
            yield version, seq, boot + first * 1000, boot + last * 1000, src, dst, sport, dport, proto, pkts, octets, tos, flags, sas, das


def read_export(spark: SparkSession, paths: list[str] | str, recursive: bool = False) -> DataFrame:
    """Files of router export packets as flow records in one direction; one task a file, decoded as a stream of rows."""
    reader, at = _files(spark.read.format("binaryFile"), paths, recursive)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in EXPORT.split(", ")]
        for frame in frames:
            for content in frame["content"]:
                rows = []
                for row in decode_export(bytes(content)):
                    rows.append(row)
                    if len(rows) == 50_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    return _export_flows(reader.load(at).select("content").mapInPandas(decode, EXPORT))


def _export_flows(raw: DataFrame) -> DataFrame:
    """Decoded export rows in the flow schema: one direction, status bits from the TCP flags."""
    bit = lambda b, s: F.when(F.col("flags").bitwiseAND(b) != 0, s).otherwise(0)
    status = F.when(F.col("proto") == 6, bit(2, 1) + bit(16, 4) + bit(1, 8) + bit(4, 4096)).otherwise(0)
    v6 = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    rows = raw.withColumns({
        "saddr": F.coalesce(v4_text("saddr_i"), v6("saddr6")), "daddr": F.coalesce(v4_text("daddr_i"), v6("daddr6")), "seq": F.col("exporter_seq"), "trans": F.lit(1), "status": status,
        "dur": (F.col("ltime_us") - F.col("stime_us")) / 1e6, "stime": F.timestamp_micros("stime_us"), "ltime": F.timestamp_micros("ltime_us"), "autoid": F.monotonically_increasing_id(),
    })
    here = set(rows.columns)
    return rows.select(*((F.col(f.name) if f.name in here else F.lit(None)).cast(f.dataType).alias(f.name) for f in FLOW_SCHEMA))


# --- names in payload


def domain_parts(name: str | Column) -> Column:
    """struct(host, domain, tld) of a DNS name, lower case, without the final dot."""
    n = F.lower(F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"\.$", ""))
    parts = F.split(n, r"\.")
    return F.struct(n.alias("host"), F.when(F.size(parts) >= 2, F.substring_index(n, ".", -2)).alias("domain"), F.element_at(parts, -1).alias("tld"))


DNS = "id int, response boolean, rcode int, qname string, qtype int, answers array<struct<name:string,type:int,ttl:bigint,value:string>>"


def decode_dns(data: bytes | None) -> dict | None:
    """One DNS message; null for what is not one. A, AAAA, CNAME, NS, PTR, MX and SOA answers are spelled out."""
    import ipaddress

    if not data or len(data) < 12:
        return None

    def name(at: int, depth: int = 0) -> tuple[str, int]:
        labels = []
        while at < len(data):
            n = data[at]
            if n == 0:
                return ".".join(labels), at + 1
            if n >= 0xC0:
                if depth > 16 or at + 1 >= len(data):
                    raise ValueError
                return ".".join([*labels, name((n & 0x3F) << 8 | data[at + 1], depth + 1)[0]]), at + 2
            labels.append(data[at + 1 : at + 1 + n].decode("latin-1").lower())
            at += n + 1
        raise ValueError

    try:
        ident, flags, questions, answers = struct.unpack_from("!HHHH", data)
        at, qname, qtype, found = 12, None, None, []
        for _ in range(questions):
            qname, at = name(at)
            qtype, _ = struct.unpack_from("!HH", data, at)
            at += 4
        for _ in range(answers):
            owner, at = name(at)
            kind, _, ttl, length = struct.unpack_from("!HHIH", data, at)
            at += 10
            body = data[at : at + length]
            if kind in (1, 28):
                value = str(ipaddress.ip_address(body))
            elif kind in (2, 5, 12, 6):
                value = name(at)[0]
            elif kind == 15:
                value = name(at + 2)[0]
            else:
                value = body.hex()
            at += length
            found.append({"name": owner, "type": kind, "ttl": ttl, "value": value})
        return {"id": ident, "response": bool(flags & 0x8000), "rcode": flags & 15, "qname": qname, "qtype": qtype, "answers": found}
    except (ValueError, struct.error, IndexError):
        return None


def dns(payload: str | Column) -> Column:
    """Payload bytes as a parsed DNS message (struct), null where it is none."""
    def run(messages: pd.Series) -> pd.DataFrame:
        rows = [decode_dns(None if m is None else bytes(m)) or {} for m in messages]
        return pd.DataFrame({c: [r.get(c) for r in rows] for c in ("id", "response", "rcode", "qname", "qtype", "answers")})

    return F.pandas_udf(run, DNS)(payload)


# --- exports with templates, and packet samples

#: Field types of template exports that become flow fields.
V9_FIELDS = {1: "octets", 2: "pkts", 4: "proto", 5: "tos", 6: "flags", 7: "sport", 8: "src", 11: "dport", 12: "dst", 16: "sas", 17: "das", 21: "last", 22: "first", 27: "src6", 28: "dst6"}


def decode_templates(data: bytes) -> Iterator[dict]:
    """Flow records of consecutive version 9 export packets; templates hold from where they stand to the end of the file.

    A packet's length is not in its header: it ends where its count of records is used up. Data without template and
    option data are passed over.
    """
    import ipaddress

    templates: dict[tuple[int, int], list[tuple[int, int]]] = {}
    at = 0
    while at + 20 <= len(data):
        version, count, uptime, sec, seq, source = struct.unpack_from("!HHIIII", data, at)
        if version != 9:
            if not any(data[at:]):
                return
            raise ValueError(f"export packet of version {version} at byte {at}")
        at += 20
        boot, left = sec * 1_000_000 - uptime * 1000, count
        while left > 0 and at + 4 <= len(data):
            kind, length = struct.unpack_from("!HH", data, at)
            if length < 4 or at + length > len(data):
                return
            body, end = at + 4, at + length
            if kind == 0:
                while body + 4 <= end:
                    number, n = struct.unpack_from("!HH", data, body)
                    if number < 256 or body + 4 + 4 * n > end:
                        break
                    templates[source, number] = [struct.unpack_from("!HH", data, body + 4 + 4 * i) for i in range(n)]
                    body, left = body + 4 + 4 * n, left - 1
            elif kind >= 256 and (source, kind) in templates:
                layout = templates[source, kind]
                size = sum(n for _, n in layout)
                while size and body + size <= end and left > 0:
                    row: dict = {"seq": seq, "boot": boot}
                    for what, n in layout:
                        if what in V9_FIELDS:
                            raw = data[body : body + n]
                            row[V9_FIELDS[what]] = str(ipaddress.ip_address(raw)) if what in (27, 28) and n == 16 else int.from_bytes(raw, "big")
                        body += n
                    left -= 1
                    yield row
            else:
                left -= 1
            at = end


def decode_samples(data: bytes) -> Iterator[dict]:
    """Flow samples of consecutive version 5 sample datagrams, each stored behind its length (four bytes).

    A sample stands for as many packets as its sampling rate; of its records the raw packet header is read (Ethernet,
    optional VLAN tag, IPv4 or IPv6). Counter samples and other records are passed over. Datagrams carry the agent's uptime
    but no time of day, so the records have no times.
    """
    import ipaddress

    at = 0
    while at + 4 <= len(data):
        (length,) = struct.unpack_from("!I", data, at)
        pkt, at = data[at + 4 : at + 4 + length], at + 4 + length
        try:
            version, family = struct.unpack_from("!II", pkt, 0)
            p = 8 + (4 if family == 1 else 16)
            _, seq, uptime, samples = struct.unpack_from("!IIII", pkt, p)
            p += 16
            for _ in range(samples if version == 5 else 0):
                kind, size = struct.unpack_from("!II", pkt, p)
                body, p = p + 8, p + 8 + size
                if kind not in (1, 3):
                    continue
                rate = struct.unpack_from("!I", pkt, body + (8 if kind == 1 else 12))[0]
                head = body + (32 if kind == 1 else 44)
                (records,) = struct.unpack_from("!I", pkt, head - 4)
                for _ in range(records):
                    what, n = struct.unpack_from("!II", pkt, head)
                    record, head = head + 8, head + 8 + n
                    if what != 1:
                        continue
                    protocol, frame, _, held = struct.unpack_from("!IIII", pkt, record)
                    raw = pkt[record + 16 : record + 16 + held]
                    if protocol != 1 or len(raw) < 34:
                        continue
                    etype, ip = struct.unpack_from("!H", raw, 12)[0], 14
                    if etype == 0x8100:
                        etype, ip = struct.unpack_from("!H", raw, 16)[0], 18
                    row = {"seq": seq, "boot": None, "pkts": rate, "octets": rate * frame}
                    if etype == 0x0800:
                        hdr = (raw[ip] & 15) * 4
                        row["src"], row["dst"] = struct.unpack_from("!II", raw, ip + 12)
                        row |= {"proto": raw[ip + 9], "tos": raw[ip + 1]}
                    elif etype == 0x86DD and len(raw) >= ip + 40:
                        hdr = 40
                        row |= {"src6": str(ipaddress.ip_address(raw[ip + 8 : ip + 24])), "dst6": str(ipaddress.ip_address(raw[ip + 24 : ip + 40])), "proto": raw[ip + 6], "tos": struct.unpack_from("!H", raw, ip)[0] >> 4 & 255}
                    else:
                        continue
                    if row["proto"] in (6, 17) and len(raw) >= ip + hdr + 4:
                        row["sport"], row["dport"] = struct.unpack_from("!HH", raw, ip + hdr)
                    if row["proto"] == 6 and len(raw) >= ip + hdr + 14:
                        row["flags"] = raw[ip + hdr + 13]
                    yield row
        except (struct.error, IndexError):
            continue


def read_decoded(spark: SparkSession, paths: list[str] | str, kind: str, recursive: bool = False) -> DataFrame:
    """Files of 'templates' (version 9 exports) or 'samples' (sample datagrams) as flow records; one task a file."""
    decoder = {"templates": decode_templates, "samples": decode_samples}[kind]
    names = [c.split()[0] for c in EXPORT.split(", ")] + ["src6", "dst6"]
    reader, at = _files(spark.read.format("binaryFile"), paths, recursive)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = []
                for r in decoder(bytes(content)):
                    first, last = (None if r.get(k) is None else r["boot"] + r[k] * 1000 for k in ("first", "last"))
                    rows.append((9, r["seq"], first, last, *(r.get(k) for k in ("src", "dst", "sport", "dport", "proto", "pkts", "octets", "tos", "flags", "sas", "das", "src6", "dst6"))))
                    if len(rows) == 50_000:
                        yield pd.DataFrame(rows, columns=names).astype(object)
                        rows = []
                yield pd.DataFrame(rows, columns=names).astype(object)

    raw = reader.load(at).select("content").mapInPandas(decode, EXPORT + ", src6 string, dst6 string")
    return _export_flows(raw.withColumns({"saddr6": F.col("src6"), "daddr6": F.col("dst6")}))
