"""Join-shaped operations: prefix, port and vendor labels, list filters, baselines, events, as-of, scans, mutual peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addresses import v4_net
from ..sources.flows import PAIRS


def longest_prefix(df: DataFrame, number: str, ranges: DataFrame, values: dict[str, str], at_least: int = 0, mode: str = "longest") -> DataFrame:
    """Adds values of the longest range that holds the address: ``values`` maps columns of ``ranges`` to new names.

    Other modes take the widest range that holds it ('super'), only an entry for the address itself ('exact', 'node'), or
    only ranges of one mask length ('mask/24').

    ``ranges`` has lo and masklen. For each mask length in use (33 at most) the masked address is looked up by equality,
    the longest first, so a lookup is a hash join whose side Spark broadcasts or shuffles by its size; no row multiplies.
    A range that is listed twice counts once, with the least of its values. Null addresses and those outside all ranges
    get nulls. ``at_least`` ignores shorter prefixes.
    """
    only = {"exact": "32", "node": "32"}.get(mode) or mode.partition("mask/")[2]
    if mode not in ("longest", "super") and not only.isdigit():
        raise ValueError(f"no lookup mode {mode!r}")
    ranges = ranges.where(f"lo is not null and masklen is not null and masklen >= {at_least}" + (f" and masklen = {only}" if only else ""))
    one = ranges.groupBy("lo", "masklen").agg(F.min(F.struct(*values)).alias("_v"))
    lengths = sorted((r[0] for r in one.select("masklen").distinct().collect()), reverse=mode != "super")
    out, found = df, []
    for n in lengths:
        side = one.where(F.col("masklen") == n).select(F.col("lo").alias(f"_lo{n}"), F.col("_v").alias(f"_v{n}"))
        out = out.join(side, v4_net(number, n) == F.col(f"_lo{n}"), "left")
        found.append(f"_v{n}")
    best = F.coalesce(*found) if found else F.lit(None).cast(one.schema["_v"].dataType)
    out = out.withColumn("_best", best)
    return out.select(*df.columns, *(F.col(f"_best.{c}").alias(name) for c, name in values.items()))


def matching_prefixes(df: DataFrame, number: str, ranges: DataFrame, label: str) -> DataFrame:
    """Adds ``labels``: labels of all ranges that hold the address, the widest first."""
    lengths = sorted(r[0] for r in ranges.where("masklen is not null").select("masklen").distinct().collect())
    out, found = df, []
    for n in lengths:
        side = ranges.where(F.col("masklen") == n).groupBy(F.col("lo").alias(f"_lo{n}")).agg(F.min(label).alias(f"_l{n}"))
        out = out.join(side, v4_net(number, n) == F.col(f"_lo{n}"), "left")
        found.append(f"_l{n}")
    return out.select(*df.columns, F.array_compact(F.array(*found)).alias("labels"))


def listed(df: DataFrame, ranges: DataFrame, sides: str = "either", invert: bool = False) -> DataFrame:
    """Records whose source, destination, either or both addresses are in a list of ranges; ``invert`` keeps the others."""
    rows = df
    if sides in ("src", "either", "both"):
        rows = longest_prefix(rows, "saddr_i", ranges.withColumn("_hit", F.lit(True)), {"_hit": "_s"})
    if sides in ("dst", "either", "both"):
        rows = longest_prefix(rows, "daddr_i", ranges.withColumn("_hit", F.lit(True)), {"_hit": "_d"})
    s, d = F.coalesce(F.col("_s") if sides != "dst" else F.lit(None), F.lit(False)), F.coalesce(F.col("_d") if sides != "src" else F.lit(None), F.lit(False))
    hit = s & d if sides == "both" else s | d
    return rows.where(~hit if invert else hit).select(*df.columns)


def service_labels(df: DataFrame, port: str, services: DataFrame, name: str = "service") -> DataFrame:
    """Adds the label of the narrowest range of (proto, lo..hi) that holds the port.

    Ranges are laid out by port (65,536 a protocol at most) and joined by equality. Null labels are no labels.
    """
    by_port = services.where("label is not null and lo <= hi").select(F.col("proto").cast("smallint").alias("_proto"), F.explode(F.sequence("lo", "hi")).alias("_port"), F.struct((F.col("hi") - F.col("lo")).alias("w"), "lo", "label").alias("_r"))
    by_port = by_port.groupBy("_proto", "_port").agg(F.min("_r").alias("_r"))
    out = df.join(by_port, (F.col("proto") == F.col("_proto")) & (F.col(port) == F.col("_port")), "left")
    return out.select(*df.columns, F.col("_r.label").alias(name))


def vendors(df: DataFrame, mac: str, table: DataFrame, name: str = "vendor") -> DataFrame:
    """Adds the vendor of a MAC's first three octets; ``table`` has oui and vendor."""
    side = table.groupBy(F.lower("oui").alias("_oui")).agg(F.min("vendor").alias(name))
    return df.join(side, F.lower(F.substring(mac, 1, 8)) == F.col("_oui"), "left").drop("_oui")


WEEK_US = 7 * 86400 * 10**6


def baseline(df: DataFrame, keys: list[str]) -> DataFrame:
    """What a later :func:`score` compares with: key, first start and span of its records, whether a TCP SYN was among them."""
    return df.where("stime_us is not null").groupBy(*keys).agg(F.min("stime_us").alias("b_start"), (F.max(F.greatest("ltime_us", "stime_us")) - F.min("stime_us")).alias("b_span"), F.max(_syn()).alias("b_syn"))


def _syn() -> Column:
    return F.coalesce((F.col("proto") == 6) & (F.col("status").bitwiseAND(1) == 1), F.lit(False))


def score(df: DataFrame, annual: DataFrame, monthly: DataFrame, keys: list[str]) -> DataFrame:
    """Adds score 0 to 4: how long a record's key has been known to the annual and the monthly baseline.

    Known before the record's start: 4 for a span above four weeks, 3 above one week, else 1 (annual) or 0 (monthly).
    The same start gives 1, equal spans in both baselines at least 1, no match 0. The greater of both counts.

    A key that a baseline lacks is looked up there once more in the other direction, as the record may have been seen from
    the far side; not so for ESP, and not where record and baseline both carry a SYN: these are conversations of their own.
    """
    rows = df
    other = dict(PAIRS) | {d: s for s, d in PAIRS}
    parts = ("start", "span", "syn")
    for turned in (False, True):
        for name, side in (("a", annual), ("m", monthly)):
            side = side.select(*(F.col(k).alias(f"_{name}{i}") for i, k in enumerate(keys)), *(F.col(f"b_{x}").alias(f"_{name}_{x}{'_r' * turned}") for x in parts))
            cond = F.lit(True)
            for i, k in enumerate(keys):
                cond &= F.col(other.get(k, k) if turned else k) == F.col(f"_{name}{i}")
            if turned:
                cond &= F.col(f"_{name}_start").isNull() & ~F.coalesce(F.col("proto") == 50, F.lit(False)) & ~(_syn() & F.col(f"_{name}_syn_r"))
            rows = rows.join(side, cond, "left").drop(*(f"_{name}{i}" for i in range(len(keys))))
    rows = rows.withColumns({f"_{n}_{x}": F.coalesce(f"_{n}_{x}", f"_{n}_{x}_r") for n in "am" for x in ("start", "span")})

    def one(name: str, least: int) -> Column:
        start, span = F.col(f"_{name}_start"), F.col(f"_{name}_span")
        known = F.when(span > 4 * WEEK_US, 4).when(span > WEEK_US, 3).otherwise(least)
        return F.when(F.col("stime_us") > start, known).when(F.col("stime_us") == start, 1).otherwise(0)

    same = F.when(F.col("_a_span") == F.col("_m_span"), 1).otherwise(0)
    return rows.select(*(F.col(c) for c in df.columns), F.greatest(one("a", 1), one("m", 0), same).alias("score"))


def known(df: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Adds match: 2 where the key is in the baseline, else -2."""
    side = base.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return df.join(side, keys, "left").withColumn("match", F.when(F.col("_hit"), 2).otherwise(-2)).drop("_hit")


def intersect(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur in both, each once."""
    return df.select(*keys).intersect(other.select(*keys))


def open_ports(events: DataFrame) -> DataFrame:
    """(sid, ts_us, prog, proto, port) from probe events whose payload lists 'open 36700/tcp 61900/udp'.

    Cut-off and null payloads give what they still hold; the program is its last path component.
    """
    rows = events.dropDuplicates(["sid", "ts", "prog", "payload"]).where("payload is not null")
    found = F.regexp_extract_all("payload", F.lit(r"(\d{1,5}/(?:tcp|udp))"), 1)
    rows = rows.select("sid", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.element_at(F.split("prog", "/"), -1).alias("prog"), F.explode(found).alias("x"))
    return rows.select("sid", "ts_us", "prog", F.when(F.col("x").endswith("tcp"), 6).otherwise(17).cast("smallint").alias("proto"), F.split("x", "/")[0].cast("int").alias("port"))


def correlate(df: DataFrame, opened: DataFrame, within_s: int) -> DataFrame:
    """Flows with the programs whose open port, at the same probe, is one of theirs up to ``within_s`` seconds away.

    Time is cut into slots of that length and each event is put into its own and both neighbours, so the join is by
    equality on (probe, protocol, port, slot).
    """
    step = within_s * 1_000_000
    ends = F.array_distinct(F.array("sport", "dport"))
    left = df.where("stime_us is not null").select("autoid", "sid", "proto", "stime_us", F.expr(f"stime_us div {step}").alias("slot"), F.explode(ends).alias("port")).where("port is not null")
    right = opened.select(F.col("sid").alias("esid"), F.col("proto").alias("eproto"), F.col("port").alias("eport"), "ts_us", "prog", F.explode(F.array(*(F.expr(f"ts_us div {step} + {i}") for i in (-1, 0, 1)))).alias("eslot"))
    on = (F.col("sid") == F.col("esid")) & (F.col("proto") == F.col("eproto")) & (F.col("port") == F.col("eport")) & (F.col("slot") == F.col("eslot"))
    rows = left.join(right, on).where(F.abs(F.col("stime_us") - F.col("ts_us")) <= step)
    return rows.groupBy("autoid").agg(F.array_sort(F.collect_set("prog")).alias("programs"), F.count(F.lit(1)).alias("events"))


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], slice_us: int = 86_400_000_000) -> DataFrame:
    """Adds to each left row the values of the last right row of its key at or before its time (nulls if there is none).

    Both sides are cut into slices of time; into each slice goes besides its own right rows the last one before it. So a
    heavy key is shared by its slices. Of right rows at one instant the greatest values count. Left rows with a null key
    or time get nulls.
    """
    types = dict(right.dtypes)
    r = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(right_time).alias("_t")).agg(F.max(F.struct(*values)).alias("_v"))
    r = r.withColumn("_s", F.floor(F.col("_t") / slice_us).cast("bigint"))
    lft = left.withColumns({"_k": F.col(key), "_t": F.col(left_time), "_s": F.floor(F.col(left_time) / slice_us).cast("bigint")})
    last = r.groupBy("_k", "_s").agg(F.max(F.struct("_t", "_v")).alias("_last"))
    slots = lft.select("_k", "_s").where("_k is not null and _s is not null").distinct().join(last, ["_k", "_s"], "full")
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    carried = slots.select("_k", "_s", before.alias("_b")).where("_b is not null").select("_k", "_s", F.col("_b._t").alias("_t"), F.col("_b._v").alias("_v"))
    value_type = "struct<" + ",".join(f"{v}:{types[v]}" for v in values) + ">"
    rows = lft.select("_k", "_s", "_t", F.lit(1).alias("_side"), F.lit(None).cast(value_type).alias("_v"), F.struct(*left.columns).alias("_row"))
    none = F.lit(None).cast(rows.schema["_row"].dataType)
    both = rows.unionByName(r.unionByName(carried).select("_k", "_s", "_t", F.lit(0).alias("_side"), "_v", none.alias("_row")))
    w = Window.partitionBy("_k", "_s").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_got", F.when(F.col("_k").isNotNull() & F.col("_t").isNotNull(), F.last("_v", ignorenulls=True).over(w))).where("_side = 1")
    return out.select("_row.*", *(F.col(f"_got.{v}").alias(v) for v in values))


def dark_scans(df: DataFrame, more_than: int) -> DataFrame:
    """Sources with more than so many transactions to addresses that never sent payload: (saddr, trans, targets)."""
    ends = F.array(F.struct(F.col("saddr").alias("a"), F.col("sappbytes").alias("b")), F.struct(F.col("daddr").alias("a"), F.col("dappbytes").alias("b")))
    active = df.select(F.explode(ends).alias("x")).where("x.b > 0 and x.a is not null").select(F.col("x.a").alias("daddr")).distinct()
    pairs = df.where("saddr is not null and daddr is not null").groupBy("saddr", "daddr").agg(F.sum("trans").alias("trans"))
    dark = pairs.join(active, "daddr", "left_anti")
    return dark.groupBy("saddr").agg(F.sum("trans").alias("trans"), F.count(F.lit(1)).alias("targets")).where(F.col("trans") > more_than)


def mutual_peers(df: DataFrame) -> DataFrame:
    """(host, peer): pairs in which each side opened flows to the other, in both directions."""
    pairs = df.where("saddr is not null and daddr is not null and saddr <> daddr").select("saddr", "daddr").distinct()
    both = pairs.groupBy(F.least("saddr", "daddr").alias("a"), F.greatest("saddr", "daddr").alias("b")).agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    ends = F.array(F.struct(F.col("a").alias("host"), F.col("b").alias("peer")), F.struct(F.col("b").alias("host"), F.col("a").alias("peer")))
    return both.select(F.explode(ends).alias("x")).select("x.*")


def two_probes(df: DataFrame, within_s: int = 60) -> DataFrame:
    """Flows that two probes saw: differences of duration, start, end and packets between the lower probe's and the other's.

    Records meet on the five-tuple, null ports included. Each record is paired with the record of each other probe that
    starts nearest to it, at most ``within_s`` seconds away (on a tie the earlier one, then the lower autoid); a pair that
    both sides choose counts once, copies of a record (sid, seq) too. Five-tuples of one probe leave first. The others are
    cut into slots of time, each record goes into its own slot and both neighbours, and the nearest are running extremes
    within (five-tuple, slot, two probes): no two records are joined, so a heavy five-tuple costs no more a record.
    """
    step = within_s * 1_000_000
    keys, values = ["saddr", "daddr", "proto", "sport", "dport"], ["stime_us", "ltime_us", "dur", "spkts", "dpkts"]
    rows = df.where("stime_us is not null and sid is not null and saddr is not null and daddr is not null")
    sides = rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min("sid").alias("_a"), F.max("sid").alias("_b")).where("_a <> _b")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    rows = rows.join(sides, same, "left_semi")
    own = F.when(F.col("seq").isNull(), F.col("autoid")).alias("own")
    rows = rows.groupBy(*keys, "sid", "seq", own, *values).agg(F.min("autoid").alias("autoid"))
    rows = rows.withColumn("home", F.expr(f"stime_us div {step}")).withColumn("slot", F.explode(F.array(*(F.col("home") + i for i in (-1, 0, 1)))))
    probes = F.collect_set("sid").over(Window.partitionBy(*keys, "slot"))
    rows = rows.withColumn("_probes", probes).withColumn("other", F.explode(F.array_except("_probes", F.array("sid"))))
    rows = rows.withColumns({"p": F.least("sid", "other"), "q": F.greatest("sid", "other"), "v": F.struct(*values, "autoid")})
    pair = Window.partitionBy(*keys, "slot", "p", "q")
    until, since = (pair.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("stime_us"), F.desc("stime_us")))

    def nearest(side: str) -> Column:
        of = F.col("sid") == F.col(side)
        before = F.max(F.when(of, F.struct("stime_us", -F.col("autoid"), "v"))).over(until)["v"]
        after = F.min(F.when(of, F.struct("stime_us", "autoid", "v"))).over(since)["v"]
        return F.when(after.isNull() | (F.col("stime_us") - before["stime_us"] <= after["stime_us"] - F.col("stime_us")), before).otherwise(after)

    rows = rows.withColumns({"_p": nearest("p"), "_q": nearest("q")}).where("slot = home")
    first = F.col("sid") == F.col("p")
    rows = rows.select(F.col("p").alias("fsid"), F.col("q").alias("sid"), *keys, F.when(first, F.col("v")).otherwise(F.col("_p")).alias("f"), F.when(first, F.col("_q")).otherwise(F.col("v")).alias("v"))
    rows = rows.where(F.abs(F.col("v.stime_us") - F.col("f.stime_us")) <= step).distinct()
    less = lambda c: F.col(f"v.{c}") - F.col(f"f.{c}")
    return rows.select("fsid", "sid", *keys, F.round(less("dur"), 6).alias("dldur"), (less("stime_us") / 1e6).alias("dlstime"), (less("ltime_us") / 1e6).alias("dlltime"), less("spkts").alias("dlspkt"), less("dpkts").alias("dldpkt"))
