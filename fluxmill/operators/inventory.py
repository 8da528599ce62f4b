"""Totals, tallies and inventories: protocols, address types, peers, ports, matrices, paths, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addresses import v4_class, v6_class
from ..sources.flows import both_ways
from .ranges import PER_RANGE, split_points, with_range


def _s(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def totals(df: DataFrame, *keys: str) -> DataFrame:
    """Records, packets and bytes, both ways and in all."""
    cols = [F.count(F.lit(1)).alias("records"), (_s("spkts") + _s("dpkts")).alias("pkts"), _s("spkts").alias("spkts"), _s("dpkts").alias("dpkts"), (_s("sbytes") + _s("dbytes")).alias("bytes"), _s("sbytes").alias("sbytes"), _s("dbytes").alias("dbytes")]
    return df.groupBy(*keys).agg(*cols) if keys else df.agg(*cols)


def protocols(df: DataFrame) -> DataFrame:
    """Totals by class and protocol number: 'ip' for IPv4 and IPv6 together, the rest by ethertype.

    A view with the number of the ethertype (column etype) tells 'arp', 'rarp' and others as '0x88cc'; without one, and for
    null, the class is 'other'.
    """
    ip = F.col("saddr_i").isNotNull() | F.col("daddr_i").isNotNull() | F.col("saddr").contains(":") | F.col("daddr").contains(":")
    rest = F.lit("other")
    if "etype" in df.columns:
        kind = F.col("etype").cast("bigint")
        named = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(kind)), 4, "0"))
        rest = F.when(kind.isin(0x0800, 0x86DD), "ip").when(kind == 0x0806, "arp").when(kind == 0x8035, "rarp").when(kind.isNotNull(), named).otherwise("other")
    return totals(df.withColumn("class", F.when(ip, "ip").otherwise(rest)), "class", "proto")


def address_types(df: DataFrame) -> DataFrame:
    """(side, version, type, n): distinct addresses of each type for IPv4, records for IPv6; source and destination apart."""
    sides = F.array(*(F.struct(F.lit(side).alias("side"), F.col(f"{s}addr").alias("addr"), F.col(f"{s}addr_i").alias("number")) for side, s in (("src", "s"), ("dst", "d"))))
    ends = df.select(F.explode(sides).alias("x")).select("x.*")
    counted = ends.groupBy("side", "addr", "number").agg(F.count(F.lit(1)).alias("records"))
    counted = counted.withColumns({"version": F.when(F.col("number").isNotNull(), 4).when(F.col("addr").contains(":"), 6), "type": F.coalesce(v4_class("number"), v6_class("addr"))}).where("version is not null")
    return counted.groupBy("side", "version", "type").agg(F.when(F.col("version") == 4, F.count(F.lit(1))).otherwise(F.sum("records")).alias("n"))


def time_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("stime_us").alias("start_us"), F.max(F.greatest("ltime_us", "stime_us")).alias("end_us"))


def peer_rows(df: DataFrame) -> DataFrame:
    """(host, peer, inside): every pair once in each direction; inside where both localities are 3 or more."""
    pairs = both_ways(df).where("saddr is not null and daddr is not null").groupBy(F.col("saddr").alias("host"), F.col("daddr").alias("peer"))
    return pairs.agg(F.max(F.coalesce((F.col("sloc") >= 3) & (F.col("dloc") >= 3), F.lit(False))).alias("inside"))


def peers(df: DataFrame) -> DataFrame:
    """Per host: number of peers and of those within the site. A busy host costs its peers, not its records."""
    return peer_rows(df).groupBy("host").agg(F.count(F.lit(1)).alias("peers"), F.sum(F.col("inside").cast("bigint")).alias("local_peers"))


def peer_lists(df: DataFrame, about: int = 1000) -> DataFrame:
    """(host, part, parts, peers): the sorted peers of each host, in parts of about so many where it has more."""
    rows = peer_rows(df).select("host", "peer")
    parts = rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / about).cast("int").alias("parts"))
    rows = rows.join(parts, "host").withColumn("part", F.pmod(F.xxhash64("peer"), F.col("parts").cast("bigint")).cast("int"))
    return rows.groupBy("host", "part", "parts").agg(F.array_sort(F.collect_list("peer")).alias("peers"))


def matrix(df: DataFrame, row: str, column: str, metric: str, n: int = 10) -> DataFrame:
    """The ``n`` x ``n`` matrix of a metric between the strongest rows and columns, one column for each."""
    value = F.sum(F.coalesce(metric, F.lit(0)))
    top = [r[0] for r in df.where(F.col(column).isNotNull()).groupBy(column).agg(value.alias("v")).orderBy(F.desc("v"), column).limit(n).collect()]
    cells = df.where(F.col(column).isin(top)).groupBy(row).pivot(column, top).agg(value)
    filled = cells.na.fill(0).withColumn("_all", sum((F.col(f"`{c}`") for c in top), F.lit(0)))
    return filled.orderBy(F.desc("_all"), row).limit(n).drop("_all")


def paths(df: DataFrame) -> DataFrame:
    """Routes from hop reports (records with an inode): per pair the nodes in order of hop, '{a,b}' where a hop has several.

    Result: saddr, daddr, hops, path, as_path (runs of one AS once, -1 where a hop has several).
    """
    hop = df.where("inode is not null and sttl is not null").groupBy("saddr", "daddr", "sttl", "inode").agg(F.max("das").alias("asn"), F.avg("dur").alias("rtt"))
    per = hop.groupBy("saddr", "daddr", "sttl").agg(F.array_sort(F.collect_set("inode")).alias("nodes"), F.collect_set("asn").alias("asns"))
    node = F.when(F.size("nodes") > 1, F.concat(F.lit("{"), F.array_join("nodes", ","), F.lit("}"))).otherwise(F.col("nodes")[0])
    asn = F.when(F.size("asns") > 1, F.lit(-1)).otherwise(F.coalesce(F.get("asns", F.lit(0)), F.lit(0)))
    one = per.groupBy("saddr", "daddr").agg(F.array_sort(F.collect_list(F.struct("sttl", node.alias("node"), asn.alias("asn")))).alias("x"))  # at most 256 hops
    runs = F.filter(F.transform("x", lambda h, i: F.when((i == 0) | (F.get("x", i - 1)["asn"] != h["asn"]), h["asn"])), lambda a: a.isNotNull())
    return one.select("saddr", "daddr", F.size("x").alias("hops"), F.array_join(F.transform("x", lambda h: h["node"]), " -> ").alias("path"), F.array_join(F.transform(runs, lambda a: a.cast("string")), " -> ").alias("as_path"))


def hop_statistics(df: DataFrame) -> DataFrame:
    """Round trip times of each node of a route."""
    return df.where("inode is not null and sttl is not null").groupBy("saddr", "daddr", "inode", "sttl").agg(
        F.count("dur").alias("n"), F.avg("dur").alias("mean"), F.stddev_pop("dur").alias("stddev"), F.max("dur").alias("max"), F.min("dur").alias("min")
    )


def ports(df: DataFrame) -> DataFrame:
    """Per destination address and protocol (tcp, udp): number of ports, and the ports as '80,443,1000-1005'."""
    seen = df.where("proto in (6, 17) and dport is not null and daddr is not null").select(F.col("daddr").alias("addr"), "proto", "dport").distinct()
    w = Window.partitionBy("addr", "proto").orderBy("dport")  # at most 65,536 rows
    runs = seen.withColumn("run", F.col("dport") - F.row_number().over(w)).groupBy("addr", "proto", "run").agg(F.min("dport").alias("a"), F.max("dport").alias("b"), F.count(F.lit(1)).alias("n"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    out = runs.groupBy("addr", "proto").agg(F.sum("n").alias("ports"), F.array_sort(F.collect_list(F.struct("a", text.alias("t")))).alias("x"))
    return out.select("addr", "proto", "ports", F.array_join(F.transform("x", lambda r: r["t"]), ",").alias("ranges"))


def neighbours(df: DataFrame) -> DataFrame:
    """Address table: first and last time each (sid, MAC, address) was seen, and how many MACs the address had there."""
    ends = both_ways(df).where("smac is not null and saddr is not null").select("sid", F.lower("smac").alias("mac"), F.col("saddr").alias("addr"), "stime_us", "ltime_us")
    rows = ends.groupBy("sid", "mac", "addr").agg(F.min("stime_us").alias("first_us"), F.max(F.coalesce("ltime_us", "stime_us")).alias("last_us"), F.count(F.lit(1)).alias("n"))
    return rows.withColumn("macs", F.count(F.lit(1)).over(Window.partitionBy("sid", "addr")))


def payload_heads(df: DataFrame, length: int = 8, most: int = 5) -> DataFrame:
    """Most frequent first bytes of the source payload per protocol and port, as hex: material for signatures."""
    heads = df.where("suser is not null and dport is not null").groupBy("proto", "dport", F.hex(F.substring("suser", 1, length)).alias("head")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("proto", "dport").orderBy(F.desc("n"), "head"))
    return heads.withColumn("rank", rank).where(F.col("rank") <= most)


def gaps_between(df: DataFrame, keys: list[str], per_range: int = PER_RANGE) -> DataFrame:
    """Pauses between the records of a key: number, mean, least, most and deviation of start - previous end, in seconds.

    Taken within ranges of time with bounds from sampled quantiles, which also leave their first start and last end; the
    pauses between ranges come from these. A range holds about ``per_range`` records, so a key that has most of them, or
    has them all within one hour, is shared by many tasks.
    """
    w = Window.partitionBy(*keys, "_slice").orderBy("stime_us", "autoid")
    end = F.coalesce("ltime_us", "stime_us")
    df = df.where("stime_us is not null")
    rows = with_range(df, "stime_us", split_points(df, "stime_us", per_range), "_slice")
    rows = rows.withColumn("gap", (F.col("stime_us") - F.lag(end).over(w)) / 1e6)
    stats = [F.count("gap").alias("n"), F.sum("gap").alias("s"), F.sum(F.col("gap") * F.col("gap")).alias("q"), F.min("gap").alias("lo"), F.max("gap").alias("hi")]
    parts = rows.groupBy(*keys, "_slice").agg(*stats, F.min("stime_us").alias("first"), F.max(F.struct("stime_us", "autoid", end.alias("end"))).alias("last"))
    between = (F.col("first") - F.lag("last.end").over(Window.partitionBy(*keys).orderBy("_slice"))) / 1e6
    parts = parts.withColumn("b", between)
    n, s = F.sum(F.col("n") + F.when(F.col("b").isNotNull(), 1).otherwise(0)), F.sum(F.coalesce("s", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)))
    q = F.sum(F.coalesce("q", F.lit(0.0)) + F.coalesce(F.col("b") * F.col("b"), F.lit(0.0)))
    out = parts.groupBy(*keys).agg(n.alias("n"), s.alias("s"), q.alias("q"), F.min(F.least("lo", "b")).alias("intflowmin"), F.max(F.greatest("hi", "b")).alias("intflowmax")).where("n > 0")
    mean = F.col("s") / F.col("n")
    return out.select(*keys, "n", mean.alias("intflow"), "intflowmin", "intflowmax", F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("intflowsdev"))


def management(man: DataFrame) -> DataFrame:
    """Probe status records per probe and cause (any spelling): number and greatest packet count; repeated rows count once."""
    return man.distinct().groupBy("sid", F.lower(F.trim("cause")).alias("cause")).agg(F.count(F.lit(1)).alias("n"), F.max("pktsrcvd").alias("pkts"))


def events(rows: DataFrame) -> DataFrame:
    """Probe events per probe and program (its last path component): number and total load; repeated rows count once.

    Cut-off and null payloads count, but add no load.
    """
    load = F.nullif(F.regexp_extract("payload", r"load ([0-9.]+)", 1), F.lit("")).cast("double")
    return rows.distinct().groupBy("sid", F.element_at(F.split("prog", "/"), -1).alias("prog")).agg(F.count(F.lit(1)).alias("n"), F.sum(load).alias("load"))
