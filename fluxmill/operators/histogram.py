"""Histograms with linear or logarithmic bins, and order statistics."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields as X
from .ranges import split_points, with_range


def auto_step(low: float, high: float, bins: int) -> tuple[float, float]:
    """(start, width): the range from min(0, low), its width rounded up to two leading digits."""
    start = min(0.0, low)
    step = (high - start) / bins
    if step <= 0:
        return start, 1.0
    scale = 1
    while step < 10:
        step, scale = step * 10, scale * 10
    return start, math.ceil(step - 1e-9) / scale


def parse_spec(spec: str) -> dict:
    """'dur 10L:0-75u' -> field, bins, log, and (start, end) or size, with their units applied."""
    m = re.fullmatch(r"(?:(abs)\s+)?(\w+)\s+(\d+)(L?)(?::(.+))?", spec.strip())
    if not m:
        raise ValueError(f"no histogram {spec!r}")
    out = {"abs": bool(m[1]), "field": m[2], "bins": int(m[3]), "log": m[4] == "L", "start": None, "end": None}
    if m[5]:
        unit = {"s": 1.0, "m": 1e-3, "u": 1e-6, "": 1.0}
        r = re.fullmatch(r"(-?[\d.e+]+)-(-?[\d.e+]+)([smu]?)", m[5])
        if r:
            out["start"], out["end"] = float(r[1]) * unit[r[3]], float(r[2]) * unit[r[3]]
        else:
            s = re.fullmatch(r"([\d.e+]+)([smu]?)", m[5])
            out["start"], out["end"] = 0.0, float(s[1]) * unit[s[2]] * out["bins"]
    return out


def width(spec: dict) -> float:
    return (spec["end"] - spec["start"]) / spec["bins"]


def histogram(df: DataFrame, spec: str) -> DataFrame:
    """(bin, low, freq, rel, cum): bin 0 is what lies below the range, bins + 1 what lies at its end or above.

    Bins are closed below and open above. With 'L' they are equal steps of the decimal logarithm and the range is that of
    the logarithm. Without a range one is derived from the data (one small aggregate). Nulls are left out, empty bins too.
    rel and cum are percentages of all counted values.
    """
    s = parse_spec(spec)
    v = F.expr(X.sql(s["field"], set(df.columns))).cast("double")
    v = F.abs(v) if s["abs"] else v
    if s["log"]:
        v = F.log10(F.when(v > 0, v))
    rows = df.select(v.alias("v")).where("v is not null")
    if s["start"] is None:
        low, high = rows.agg(F.min("v"), F.max("v")).first()
        start, step = auto_step(low or 0.0, high or 0.0, s["bins"])
        if s["log"]:
            start, step = low or 0.0, ((high or 0.0) - (low or 0.0)) / s["bins"] or 1.0
    else:
        start, step = s["start"], width(s)
    no = F.when(F.col("v") < start, 0).otherwise(F.least(F.floor((F.col("v") - start) / step).cast("bigint") + 1, F.lit(s["bins"] + 1)))
    counts = rows.groupBy(no.alias("bin")).agg(F.count(F.lit(1)).alias("freq"))
    everything, upto = Window.partitionBy(), Window.orderBy("bin")  # over at most bins + 2 rows
    total = F.sum("freq").over(everything)
    low = F.when(F.col("bin") > 0, start + (F.col("bin") - 1) * step)
    return counts.select("bin", low.alias("low"), "freq", (100.0 * F.col("freq") / total).alias("rel"), (100.0 * F.sum("freq").over(upto) / total).alias("cum"))


def with_ranks(counts: DataFrame, keys: tuple[str, ...], bounds: list[float]) -> DataFrame:
    """Adds to counts (keys, v, c) the total n of the key and upto, the number of its values up to v.

    Values are cut into ranges at ``bounds``, which come from sampled quantiles; totals of the ranges give the offsets, and
    a running sum is taken within a range only, so a key with most of the values is shared by its ranges.
    """
    counts = with_range(counts, "v", bounds)
    sums = counts.groupBy(*keys, "_part").agg(F.sum("c").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_sum")
    sums = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_p"), before.alias("_before"), F.sum("_sum").over(Window.partitionBy(*keys)).alias("n"))
    match = F.col("_part") == F.col("_p")
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    within = F.sum("c").over(Window.partitionBy(*keys, "_part").orderBy("v"))
    return counts.join(sums, match).select(*keys, "v", "c", "n", (within + F.col("_before")).alias("upto"))


def order_statistics(df: DataFrame, field: str, keys: tuple[str, ...] = (), nozero: bool = False) -> DataFrame:
    """n, mean, stddev (population), min, max, median, p95 (the value at 0-based rank floor(0.95 n)) and mode per key.

    Values reduce to counts first; ranks come from running totals of the counts, so no list of values is ever built. Null
    keys are keys; a key without values has no row.
    The smallest of equally frequent values is the mode, and only values that occur more than twice are one.
    """
    v = F.expr(X.sql(field, set(df.columns))).cast("double")
    values = df.select(*keys, v.alias("v")).where("v is not null" + (" and v <> 0" if nozero else ""))
    counts = values.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    rows = with_ranks(counts, keys, split_points(values, "v"))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))  # noqa: E731  value at a 0-based rank
    half_low, half_high = F.expr("(n - 1) div 2"), F.expr("n div 2")
    mean = F.sum(F.col("v") * F.col("c")) / F.sum("c")
    square = F.sum(F.col("v") * F.col("v") * F.col("c")) / F.sum("c")
    return rows.groupBy(*keys).agg(
        F.sum("c").alias("n"), mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("stddev"), F.min("v").alias("min"), F.max("v").alias("max"),
        ((at(half_low) + at(half_high)) / 2).alias("median"), at(F.expr("cast(floor(0.95D * n) as bigint)")).alias("p95"),
        F.max(F.when(F.col("c") > 2, F.struct(F.col("c"), (-F.col("v")).alias("v"))))["v"].alias("_mode"),
    ).withColumn("mode", 0 - F.col("_mode")).drop("_mode")
