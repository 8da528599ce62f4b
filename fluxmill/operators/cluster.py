"""Keyed flow aggregation: keys with masks, direction correction, rule chains, timers and rollups."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields as X
from ..functions.addresses import net_text
from ..sources.flows import normalised, reverse
from .sessions import slot_of

SUMS = ("spkts", "dpkts", "sbytes", "dbytes", "sappbytes", "dappbytes", "sloss", "dloss")
FIVE_TUPLE = "saddr daddr proto sport dport"


def key_columns(spec: str, columns: set[str]) -> list[Column]:
    """Grouping columns of a key list such as 'saddr/24 proto dport'; ports bring proto along, 'all' gives none."""
    names = [] if spec in ("all", "none") else spec.split()
    if any(n in ("sport", "dport") for n in names) and "proto" not in names:
        names.insert(0, "proto")
    out = []
    for n in names:
        name, _, length = n.partition("/")
        if length and name in ("saddr", "daddr"):
            out.append(net_text(f"{name}_i", name, int(length)).alias(name))
        else:
            out.append(F.expr(X.sql(name, columns)).alias(name))
    return out


def merged(metric: str | None = None) -> list[Column]:
    """Aggregates of merging records: counters add up, times span, status bits unite. ``metric``: its statistics too."""
    out = [
        F.sum(F.coalesce("trans", F.lit(1))).alias("trans"), F.min("stime_us").alias("stime_us"), F.max("ltime_us").alias("ltime_us"), ((F.max("ltime_us") - F.min("stime_us")) / 1e6).alias("dur"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS), F.bit_or("status").alias("status"),
    ]
    if metric:
        m = F.expr(X.sql(metric)).cast("double")
        out += [F.avg(m).alias("mean"), F.min(m).alias("min"), F.max(m).alias("max"), F.sum(m).alias("sum"), F.stddev_pop(m).alias("stddev"), F.count(m).alias("n")]
    return out


def cluster(df: DataFrame, keys: str = FIVE_TUPLE, metric: str | None = None, correct: bool | None = None) -> DataFrame:
    """One record for each key. ``correct``: direction correction, by default for the full five-tuple only.

    'matrix' and 'matrix/len' group by the unordered pair of addresses, 'none' passes the records through as they are. Null
    keys are keys; null counters count as 0; an empty table gives no rows (for 'all' one row of nulls and zeros).
    """
    if keys == "none":
        return df
    if keys.split("/")[0] == "matrix":
        df, keys = normalised(df), " ".join(k + keys[6:] for k in ("saddr", "daddr"))
    elif correct or (correct is None and set(keys.split()) == set(FIVE_TUPLE.split())):
        return corrected(df, metric)
    return df.groupBy(*key_columns(keys, set(df.columns))).agg(*merged(metric))


def corrected(df: DataFrame, metric: str | None = None) -> DataFrame:
    """Five-tuple aggregation in which both directions of a conversation become one record.

    The two directions meet under a canonical key, the lower (address, port) first. If both carried a SYN they are
    conversations of their own; else the side with the SYN is the source, else the side that started first (the lower one
    on a tie). ESP is never corrected. Independent of the order of records. Directions are merged first, so the second
    step moves at most two rows a conversation, however many records a conversation has.
    """
    halves = df.groupBy("proto", "saddr", "sport", "daddr", "dport").agg(F.first("saddr_i").alias("saddr_i"), F.first("daddr_i").alias("daddr_i"), *_parts(metric))
    end = lambda a, p: F.struct(F.coalesce(F.col(a), F.lit("")).alias("a"), F.coalesce(F.col(p), F.lit(-1)).alias("p"))
    source, target = end("saddr", "sport"), end("daddr", "dport")
    rows = halves.withColumns({"_low": F.least(source, target), "_high": F.greatest(source, target), "_fwd": source <= target, "_syn": F.coalesce((F.col("proto") == 6) & (F.col("status").bitwiseAND(1) == 1), F.lit(False))})
    w = Window.partitionBy("proto", "_low", "_high")
    some = lambda cond: F.max(F.coalesce(cond, F.lit(False))).over(w)
    syn_f, syn_r = some(F.col("_syn") & F.col("_fwd")), some(F.col("_syn") & ~F.col("_fwd"))
    start_f, start_r = (F.coalesce(F.min(F.when(c, F.col("stime_us"))).over(w), F.lit(2**62)) for c in (F.col("_fwd"), ~F.col("_fwd")))
    apart = (syn_f & syn_r) | F.coalesce(F.col("proto") == 50, F.lit(False))
    forward = F.when(apart, F.col("_fwd")).when(syn_f, True).when(syn_r, False).otherwise(start_f <= start_r)
    rows = rows.withColumn("_forward", forward)
    rows = reverse(rows, F.col("_fwd") != F.col("_forward"))
    return rows.groupBy(*FIVE_TUPLE.split()).agg(*_united(metric))


def _parts(metric: str | None) -> list[Column]:
    """Like :func:`merged`, with statistics as sums that can be merged once more."""
    out = merged()
    if metric:
        m = F.expr(X.sql(metric)).cast("double")
        out += [F.count(m).alias("n"), F.sum(m).alias("sum"), F.sum(m * m).alias("sumsq"), F.min(m).alias("min"), F.max(m).alias("max")]
    return out


def _united(metric: bool | str | None) -> list[Column]:
    out = [
        F.sum("trans").alias("trans"), F.min("stime_us").alias("stime_us"), F.max("ltime_us").alias("ltime_us"), ((F.max("ltime_us") - F.min("stime_us")) / 1e6).alias("dur"),
        *(F.sum(c).alias(c) for c in SUMS), F.bit_or("status").alias("status"),
    ]
    if metric:
        mean = F.sum("sum") / F.nullif(F.sum("n"), F.lit(0))
        out += [F.sum("n").alias("n"), F.sum("sum").alias("sum"), mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum("sumsq") / F.nullif(F.sum("n"), F.lit(0)) - mean * mean)).alias("stddev"), F.min("min").alias("min"), F.max("max").alias("max")]
    return out


def rollup(df: DataFrame, keys: list[str], unit: str, metric: str = "dur") -> tuple[DataFrame, DataFrame]:
    """(daily, coarser): day aggregates by key, and these re-aggregated to 'month' or 'year'; statistics stay exact."""
    day = F.date_trunc("day", F.timestamp_micros("stime_us"))
    daily = df.where("stime_us is not null").groupBy(day.alias("period"), *keys).agg(*_parts(metric))
    return daily, daily.groupBy(F.date_trunc(unit, "period").alias("period"), *keys).agg(*_united(metric))


def percent(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column also as its share of the column's total over all rows, in percent (pct_x). One scan, one total row."""
    totals = df.agg(*(F.sum(c).alias(f"_{c}") for c in columns), F.lit(1).alias("_one"))
    rows = df.withColumn("_one", F.lit(1)).join(F.broadcast(totals), "_one")  # the totals are a single row
    return rows.withColumns({f"pct_{c}": 100.0 * F.col(c) / F.nullif(F.col(f"_{c}"), F.lit(0)) for c in columns}).drop("_one", *(f"_{c}" for c in columns))


# --- rule chains


@dataclass(frozen=True)
class Rule:
    """One line of an aggregation plan: which records, by which key; ``cont`` hands them on to later rules as well."""

    name: str
    filter: str = ""
    keys: str = FIVE_TUPLE
    grep: str = ""
    label: str = ""
    cont: bool = False
    status_s: float | None = None
    idle_s: float | None = None


def parse_rules(text: str) -> list[Rule]:
    """Rules from lines such as  filter="tcp" model="saddr daddr" status=60 idle=300 label="web" cont ; '#' starts a comment."""

    def seconds(name: str, line: str) -> float | None:
        found = re.search(rf"\b{name}=\"?([0-9.]+)\"?", re.sub(r'(filter|model|grep|label)="[^"]*"', "", line))
        return float(found[1]) if found and float(found[1]) > 0 else None

    out = []
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if not line or re.match(r"[A-Z_]+=", line):
            continue
        found = dict(re.findall(r'(\w+)="([^"]*)"', line))
        out.append(Rule(f"rule{len(out)}", found.get("filter", ""), found.get("model", FIVE_TUPLE), found.get("grep", ""), found.get("label", ""), bool(re.search(r"\bcont\b", re.sub(r'"[^"]*"', "", line))), seconds("status", line), seconds("idle", line)))
    return out


def cluster_by_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Aggregates each record by the first rule it matches, and by further ones while the matched rules say ``cont``.

    Records that match no rule, or only ones with ``cont``, are aggregated by the five-tuple as 'rest'. Result: rule,
    label, key (struct of texts of all key fields, null where the rule does not use them) and the merged counters. One
    scan and one shuffle however many rules there are. A rule with ``idle`` begins a new aggregate after such a pause (see
    :func:`idle_split`), one with ``status`` also once an aggregate spans that time (see :func:`status_split`); both leave
    out records without start.
    """
    from ..plans.filterlang import compile_filter

    columns = set(df.columns)
    all_rules = [*rules, Rule("rest")]
    names = sorted({k.split("/")[0] for r in all_rules for k in [*r.keys.split(), "proto"]} - {"all", "none"})
    taken, open_ = [], F.lit(True)
    for r in all_rules:
        match = F.coalesce(compile_filter(r.filter, columns), F.lit(False))
        if r.grep:
            match &= F.coalesce(F.col("label").rlike(r.grep), F.lit(False))
        specs = dict((k.partition("/")[0], k) for k in ([] if r.keys in ("all", "none") else r.keys.split()))
        if {"sport", "dport"} & set(specs):
            specs.setdefault("proto", "proto")
        keys = {n: key_columns(s, columns) for n, s in specs.items()}
        struct = F.struct(*((keys[n][-1] if n in keys else F.lit(None)).cast("string").alias(n) for n in names))
        taken.append(F.when(open_ & match, F.struct(F.lit(r.name).alias("rule"), F.lit(r.label).alias("label"), struct.alias("key"))))
        if not r.cont:
            open_ &= ~match
    rows = df.withColumn("_rule", F.explode(F.array_compact(F.array(*taken))))
    rows = rows.withColumns({"rule": F.col("_rule.rule"), "label": F.col("_rule.label"), **{f"_k{i}": F.col(f"_rule.key.{n}") for i, n in enumerate(names)}})
    keys = ["rule", "label", *(f"_k{i}" for i in range(len(names)))]
    timed = {(r.status_s, r.idle_s) for r in rules if r.status_s or r.idle_s}
    plain = rows.where(~F.col("rule").isin([r.name for r in rules if r.status_s or r.idle_s])) if timed else rows
    out = plain.groupBy(*keys).agg(*merged())
    for status_s, idle_s in sorted(timed, key=str):
        some = rows.where(F.col("rule").isin([r.name for r in rules if (r.status_s, r.idle_s) == (status_s, idle_s)]))
        out = out.unionByName((status_split(some, keys, status_s, idle_s) if status_s else idle_split(some, keys, idle_s)).drop("part"))
    key = F.struct(*(F.col(f"_k{i}").alias(n) for i, n in enumerate(names)))
    return out.select("rule", "label", key.alias("key"), *(c for c in out.columns if c not in keys))


# --- timers


def idle_split(df: DataFrame, keys: list[str], idle_s: float, slots: int = 1024) -> DataFrame:
    """Aggregates by key, a new record beginning where nothing was active for ``idle_s`` seconds or more.

    A record without an end ends where it starts. Records of a key that start within one slot of ``idle_s`` always belong
    together, so they merge first, by sums that start on the map side; what is left of a key is bounded by the length of
    time and not by its records. It is divided within slices of ``slots`` slots and then over the slices.
    """
    idle = int(idle_s * 1e6)

    def numbered(rows: DataFrame, within: list[str]) -> DataFrame:
        w = Window.partitionBy(*within).orderBy("stime_us", "ltime_us")
        before = F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_new", F.when(F.col("stime_us") - before < idle, 0).otherwise(1))
        return rows.withColumn("part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    rows = df.where("stime_us is not null").withColumn("_end", F.coalesce("ltime_us", "stime_us"))
    slot = slot_of("stime_us", idle) if idle > 0 else F.col("autoid")
    rows = rows.groupBy(*keys, slot.alias("_slot")).agg(*merged(), F.max("_end").alias("_end"))
    rows = rows.withColumn("_slice", slot_of("stime_us", max(1, idle) * slots))
    rows = numbered(rows, [*keys, "_slice"]).groupBy(*keys, "_slice", "part").agg(*_united(None), F.max("_end").alias("_end")).drop("part")
    return numbered(rows, keys).groupBy(*keys, "part").agg(*_united(None))


def status_split(df: DataFrame, keys: list[str], status_s: float, idle_s: float | None = None) -> DataFrame:
    """Aggregates by key in reports: a record is emitted once it spans ``status_s`` seconds, the next record opens anew.

    An ordered fold, as where a report ends decides where the next one starts. Only (stime, ltime) of a key are folded;
    each key's rows are sorted and streamed, the state is two numbers, and the reports are aggregated as usual. The fold of
    one key cannot be divided; where one key may hold most records, use :func:`idle_split` or bins instead.
    """
    status, idle = int(status_s * 1e6), None if idle_s is None else int(idle_s * 1e6)
    key = F.xxhash64(*keys)
    rows = df.where("stime_us is not null").withColumn("_key", key)
    spread = rows.repartition("_key").sortWithinPartitions("_key", *keys, "stime_us", "autoid")

    def fold(batches):
        import numpy as np
        import pandas as pd

        last, start, end, no = None, 0, 0, 0
        for pdf in batches:
            if not len(pdf):
                continue
            new = np.zeros(len(pdf), dtype=bool)
            for k in keys:
                values, before = pdf[k], pdf[k].shift()
                new |= ((values != before) & ~(values.isna() & before.isna())).to_numpy(dtype=bool)
            heads = pdf[keys].iloc[[0, -1]].astype(object).where(pdf[keys].iloc[[0, -1]].notna(), None).itertuples(index=False, name=None)
            first, final = heads
            new[0] = last is None or first != last[0]
            last = (final,)
            numbers = []
            starts, ends = pdf["stime_us"].tolist(), pdf["ltime_us"].fillna(pdf["stime_us"]).astype("int64").tolist()
            for opens, s, e in zip(new.tolist(), starts, ends):
                if opens:
                    start, end, no = s, e, 0
                elif end - start >= status or (idle is not None and s - end >= idle):
                    start, end, no = s, e, no + 1
                elif e > end:
                    end = e
                numbers.append(no)
            yield pdf.assign(part=pd.array(numbers, dtype="int64"))

    need = list(dict.fromkeys([*keys, "stime_us", "ltime_us", "trans", *SUMS, "status"]))
    types = dict(df.dtypes)
    out = spread.select(*need).mapInPandas(fold, ", ".join(f"{c} {types[c]}" for c in need) + ", part bigint")
    return out.groupBy(*keys, "part").agg(*merged())
