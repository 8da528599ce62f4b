"""Anonymised copies: addresses by order of first appearance or by keyed hash, ports by class, times by offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addresses import mac_class, oui, v4_net, v4_number, v4_text
from .ranges import running_total, split_points

#: Networks are numbered from 10.0.0.0/24 on, through the unicast space and around.
FIRST_NET, NETS = 10 << 16, 0xE00000
#: Where numbers of autonomous systems for private use begin.
PRIVATE_AS = 4_200_000_000


def _first_seen(df: DataFrame, ends: dict[str, int], value) -> DataFrame:
    """(v, at): distinct values of several columns and where they first appear; the columns' numbers order a row."""
    seen = F.array(*(F.struct(value(c).alias("v"), (F.col("autoid") * 4 + i).alias("at")) for c, i in ends.items()))
    return df.select(F.explode(seen).alias("x")).select("x.*").where("v is not null").groupBy("v").agg(F.min("at").alias("at"))


def _bounds(df: DataFrame) -> list[float]:
    """Cuts of the order of appearance, for all maps of a table."""
    return split_points(df.select((F.col("autoid") * 4).alias("at")), "at")


def address_map(df: DataFrame, bounds: list[float] | None = None) -> DataFrame:
    """(addr_i, anon_i) for all IPv4 addresses, those of routers (inode) included, numbered as they first appear.

    Network (/24) n becomes the n-th after 10.0.0.0, and its h-th host that address plus h, the 255th the address itself, so
    that no host becomes a broadcast address; broadcast and multicast keep their value. The numbering of networks is a
    distributed running count, that of hosts is within a network of at most 256.
    """
    number = lambda c: v4_number(c) if c == "inode" else F.col(c)
    seen = _first_seen(df, {"saddr_i": 0, "daddr_i": 1, "inode": 2}, number).select(F.col("v").alias("addr_i"), "at")
    kept = (F.col("addr_i") >= 0xE0000000) | (F.col("addr_i").bitwiseAND(F.lit(255)) == 255)
    hosts = seen.where(~kept).withColumn("net", v4_net("addr_i", 24))
    nets = running_total(hosts.groupBy("net").agg(F.min("at").alias("at")), ["at"], F.lit(1), _bounds(df) if bounds is None else bounds).select("net", F.pmod(F.col("_upto") - 1 + FIRST_NET, F.lit(NETS)).alias("no"))
    h = F.row_number().over(Window.partitionBy("net").orderBy("at"))
    numbered = hosts.withColumn("h", F.pmod(h, F.lit(255))).join(nets, "net").select("addr_i", (F.col("no") * 256 + F.col("h")).alias("anon_i"))
    return numbered.unionByName(seen.where(kept).select("addr_i", F.col("addr_i").alias("anon_i")))


def as_map(df: DataFrame, bounds: list[float] | None = None) -> DataFrame:
    """(asn, anon_asn): autonomous systems numbered for private use as they first appear; 0 stays 0."""
    seen = _first_seen(df, {"sas": 0, "das": 1}, F.col).where("v <> 0")
    return running_total(seen, ["at"], F.lit(1), _bounds(df) if bounds is None else bounds).select(F.col("v").alias("asn"), (F.lit(PRIVATE_AS) + F.col("_upto") - 1).alias("anon_asn"))


def mac_map(df: DataFrame, keep_vendor: bool = False, bounds: list[float] | None = None) -> DataFrame:
    """(mac, anon_mac): MACs numbered as they first appear, locally administered, or under their vendor's first three octets.

    Broadcast and multicast keep their value.
    """
    seen = _first_seen(df, {"smac": 0, "dmac": 1}, lambda c: F.lower(F.col(c)))
    kept = mac_class("v").isin("bcast", "mcast")
    digits = F.lpad(F.lower(F.hex(F.col("_upto") - 1)), 12, "0")
    octets = F.array(*(F.substring(digits, i, 2) for i in range(1, 12, 2)))
    new = F.concat(F.lit("02:"), F.array_join(F.slice(octets, 2, 5), ":"))
    if keep_vendor:
        new = F.concat(oui("v"), F.lit(":"), F.array_join(F.slice(octets, 4, 3), ":"))
    numbered = running_total(seen.where(~kept), ["at"], F.lit(1), _bounds(df) if bounds is None else bounds).select(F.col("v").alias("mac"), new.alias("anon_mac"))
    return numbered.unionByName(seen.where(kept).select(F.col("v").alias("mac"), F.col("v").alias("anon_mac")))


def anonymize(df: DataFrame, port_offset: int = 0, time_offset_us: int = 0, seq_offset: int = 0, keep_vendor: bool | None = None) -> DataFrame:
    """Records with mapped addresses, registered and private ports shifted within their class, times and numbers shifted.

    Addresses of hosts and routers and autonomous systems are mapped as above; addresses other than IPv4 become a hash;
    payload and labels are dropped, and MACs too unless ``keep_vendor`` says whether their map keeps the vendor.
    """
    bounds = _bounds(df)
    rows, new = df.withColumn("_inode", v4_number("inode")), {}

    def look_up(mapping: DataFrame, key: Column) -> Column:
        nonlocal rows
        old, got = mapping.columns
        name = f"_m{len(new)}"
        rows = rows.join(mapping.select(F.col(old).alias(f"{name}o"), F.col(got).alias(name)), key == F.col(f"{name}o"), "left")
        return F.col(name)

    addresses = address_map(df, bounds)
    for text, number in (("saddr", "saddr_i"), ("daddr", "daddr_i"), ("inode", "_inode")):
        mapped = look_up(addresses, F.col(number))
        hashed = F.when(F.col(text).isNotNull(), F.concat(F.lit("x:"), F.substring(F.sha2(text, 256), 1, 16)))
        new |= {text: F.coalesce(v4_text(mapped), hashed), number: mapped}
    systems = as_map(df, bounds)
    for c in ("sas", "das"):
        new[c] = F.when(F.col(c) == 0, F.col(c)).otherwise(look_up(systems, F.col(c)))
    if keep_vendor is not None:
        macs = mac_map(df, keep_vendor, bounds)
        for c in ("smac", "dmac"):
            new[c] = look_up(macs, F.lower(F.col(c)))
    new |= {c: shifted_port(F.col(c), port_offset) for c in ("sport", "dport")}
    new |= {"stime_us": F.col("stime_us") + time_offset_us, "ltime_us": F.col("ltime_us") + time_offset_us, "seq": F.col("seq") + seq_offset}
    new |= {c: F.timestamp_micros(new[f"{c}_us"]) for c in ("stime", "ltime")}
    gone = {"suser", "duser", "label"} | ({"smac", "dmac"} if keep_vendor is None else set())
    return rows.select(*((F.lit(None).cast(t) if c in gone else new.get(c, F.col(c))).alias(c) for c, t in df.dtypes))


def shifted_port(port: Column, offset: int) -> Column:
    """Well-known ports stay; registered (1024-49151) and private ones rotate within their class."""
    registered, private = 49152 - 1024, 65536 - 49152
    return F.when(port < 1024, port).when(port < 49152, 1024 + F.pmod(port - 1024 + offset, F.lit(registered))).otherwise(49152 + F.pmod(port - 49152 + offset, F.lit(private))).cast("int")


def keyed(text: Column, key: str) -> Column:
    """Stateless pseudonym: the same text and key give the same result in every run."""
    return F.substring(F.sha2(F.concat(F.lit(key), text), 256), 1, 16)
