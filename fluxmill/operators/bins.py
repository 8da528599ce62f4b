"""Time, count and size bins of flow records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import SUMS, merged
from .ranges import running_total

#: Microseconds of the units of a bin size.
UNIT_US = {"s": 10**6, "m": 60 * 10**6, "h": 3600 * 10**6, "d": 86400 * 10**6}
TRUNCATED = {"w": "week", "M": "month", "y": "year"}


def parse_size(text: str) -> tuple[int, str]:
    """('5m') -> (5, 'm')."""
    number = text.rstrip("smhdwMy")
    return int(number or 1), text[len(number) :] or "s"


def bin_start(us: Column, size: str) -> Column:
    """Start of the bin: s, m, h and d counted from New Year, w, M and y on the calendar."""
    n, unit = parse_size(size)
    if unit in TRUNCATED:
        if n != 1:
            raise ValueError("weeks, months and years come one at a time")
        return F.unix_micros(F.date_trunc(TRUNCATED[unit], F.timestamp_micros(us)))
    origin = F.unix_micros(F.date_trunc("year", F.timestamp_micros(us)))
    step = F.lit(n * UNIT_US[unit])
    return origin + F.floor((us - origin) / step) * step


def split(df: DataFrame, size: str) -> DataFrame:
    """Splits records at bin edges; counters are shared out in proportion to time and add up exactly.

    Fragment k of a counter m is floor(m * end_k / dur) - floor(m * end_(k-1) / dur). A fragment without packets is
    dropped and its bytes go with the next one that has packets: bytes follow the packets' cumulative count. Records
    without packets stay whole in their first bin, as do those without end or of no length. Adds bin_us; stime_us and
    ltime_us become those of the fragment. Only long records are multiplied, and by their number of bins only.
    """
    n, unit = parse_size(size)
    if unit in TRUNCATED:
        raise ValueError("records are split into bins of fixed size only")
    step = n * UNIT_US[unit]
    rows = df.where("stime_us is not null").withColumn("_end", F.greatest(F.coalesce("ltime_us", "stime_us"), F.col("stime_us")))
    origin = F.unix_micros(F.date_trunc("year", F.timestamp_micros("stime_us")))
    rows = rows.withColumns({"_origin": origin, "_len": F.col("_end") - F.col("stime_us"), "_pkts": F.coalesce("spkts", F.lit(0)) + F.coalesce("dpkts", F.lit(0))})
    first = F.expr(f"(stime_us - _origin) div {step}")
    last = F.when((F.col("_len") > 0) & (F.col("_pkts") > 0), F.expr(f"(_end - 1 - _origin) div {step}")).otherwise(first)
    rows = rows.withColumns({"_b0": first, "_b1": last}).withColumn("_k", F.explode(F.sequence("_b0", "_b1")))
    rows = rows.withColumns({"_lo": F.greatest(F.col("stime_us"), F.col("_origin") + F.col("_k") * step), "_hi": F.when(F.col("_k") == F.col("_b1"), F.col("_end")).otherwise(F.col("_origin") + (F.col("_k") + 1) * step)})
    whole = F.col("_b0") == F.col("_b1")

    def upto(counter: str, edge: str) -> Column:
        part = F.col(counter).cast("decimal(38,0)") * (F.col(edge) - F.col("stime_us")).cast("decimal(20,0)")
        return F.floor(part / F.nullif(F.col("_len"), F.lit(0)).cast("decimal(20,0)")).cast("bigint")

    packets = {c: (upto(c, "_lo"), upto(c, "_hi")) for c in ("spkts", "dpkts")}
    rows = rows.withColumns({f"_{c}{i}": e for c, pair in packets.items() for i, e in enumerate(pair)})

    def follow(counter: str, pkts: str) -> Column:
        at = lambda i: F.floor(F.col(counter).cast("decimal(38,0)") * F.col(f"_{pkts}{i}").cast("decimal(20,0)") / F.nullif(F.col(pkts), F.lit(0)).cast("decimal(20,0)")).cast("bigint")
        alone = F.when(F.col("_k") == F.col("_b1"), F.col(counter)).otherwise(F.lit(0))  # a side without packets keeps the counter together
        return F.when(whole, F.col(counter)).when(F.coalesce(F.col(pkts), F.lit(0)) == 0, alone).otherwise(at(1) - at(0)).cast("bigint")

    new = {c: F.when(whole, F.col(c)).otherwise(F.col(f"_{c}1") - F.col(f"_{c}0")) for c in ("spkts", "dpkts")}
    new |= {c: follow(c, ("spkts" if c[0] == "s" else "dpkts")) for c in SUMS if c not in new}
    rows = rows.withColumns({f"_new_{c}": e for c, e in new.items()})
    kept = whole | (F.coalesce("_new_spkts", F.lit(0)) + F.coalesce("_new_dpkts", F.lit(0)) > 0)
    out = {c: F.col(f"_new_{c}").cast(t) for c, t in df.dtypes if c in new} | {"bin_us": F.col("_origin") + F.col("_k") * step}
    rows = rows.where(kept).withColumns(out).withColumns({"stime_us": F.col("_lo"), "ltime_us": F.when(whole, F.col("ltime_us")).otherwise(F.col("_hi"))})
    return rows.select(*df.columns, "bin_us")


def time_bins(df: DataFrame, size: str, keys: list[str], mode: str = "split") -> DataFrame:
    """Aggregates by bin and key. Modes: 'split' shares records over bins, 'nomodify' counts each in the bin of its start,
    'hard' is split with times set to the edges of the bin."""
    rows = split(df, size) if mode in ("split", "hard") else df.where("stime_us is not null").withColumn("bin_us", bin_start(F.col("stime_us"), size))
    out = rows.groupBy("bin_us", *keys).agg(*merged())
    if mode == "hard":
        n, unit = parse_size(size)
        step = n * UNIT_US[unit]
        out = out.withColumns({"stime_us": F.col("bin_us"), "ltime_us": F.col("bin_us") + step, "dur": F.lit(step / 1e6)})
    return out


def with_empty_bins(binned: DataFrame, size: str, counters: list[str]) -> DataFrame:
    """Adds the bins between the first and the last that nothing fell into, with zeros. For bins without further keys."""
    n, unit = parse_size(size)
    step = n * UNIT_US[unit]
    calendar = binned.agg(F.min("bin_us").alias("a"), F.max("bin_us").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.lit(step))).alias("bin_us"))
    return calendar.join(binned, "bin_us", "left").select("bin_us", *(F.coalesce(c, F.lit(0)).alias(c) for c in counters))


def count_bins(df: DataFrame, n: int, order: list[str] | None = None) -> DataFrame:
    """Adds bin: records in order of arrival, ``n`` to a bin."""
    rows = running_total(df, order or ["autoid"], F.lit(1))
    return rows.withColumn("bin", F.expr(f"(_upto - 1) div {n}")).drop("_upto")


def size_bins(df: DataFrame, n: int, order: list[str] | None = None) -> DataFrame:
    """Adds bin: the running total of bytes before a record, in steps of ``n``."""
    size = F.coalesce("sbytes", F.lit(0)) + F.coalesce("dbytes", F.lit(0))
    rows = running_total(df, order or ["autoid"], size).withColumn("_before", F.col("_upto") - size)
    return rows.withColumn("bin", F.expr(f"_before div {n}")).drop("_upto", "_before")


def rate_bins(df: DataFrame, n: int, size_s: int, keys: list[str]) -> DataFrame:
    """Sliding windows of ``n`` bins of ``size_s`` seconds, one starting with every bin."""
    w = F.window(F.timestamp_micros("stime_us"), f"{n * size_s} seconds", f"{size_s} seconds")
    rows = df.where("stime_us is not null").groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("sbytes", F.lit(0)) + F.coalesce("dbytes", F.lit(0))).alias("bytes"))
    return rows.select(F.unix_micros("w.start").alias("bin_us"), *keys, "n", "bytes", (F.col("bytes") * 8 / (n * size_s)).alias("load"))


def fold_period(df: DataFrame, unit: str) -> DataFrame:
    """Times as offsets from the start of their day, hour, week, ...: 14:30 of every day falls together."""
    start = F.unix_micros(F.date_trunc(unit, F.timestamp_micros("stime_us")))
    return df.where("stime_us is not null").withColumn("_start", start).withColumns({"stime_us": F.col("stime_us") - F.col("_start"), "ltime_us": F.col("ltime_us") - F.col("_start")}).drop("_start")
