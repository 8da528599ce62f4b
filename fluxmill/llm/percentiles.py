"""Exact percentiles per group from cumulative frequencies that add up over days and partitions.

Rows reduce to counts per (group, value) before anything else; these counts are the mergeable partial result. The counts
are range sorted: values are cut at sampled quantiles, each range's total gives the offset of the ranges after it, and a
running sum inside a range plus its offset is the rank of a value; the first value to reach a target rank is the percentile.
The bounds are fixed values of the plan, so a recomputed partition finds the same ranges, and there are as many ranges as
the rows ask for, so a group that holds most rows is spread over them. Only ranges that hold a wanted rank are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranges import split_points, with_range


def rounded(v: Column, bits: int) -> Column:
    """A whole number >= 0 with its leading ``bits`` + 1 bits kept: at most a share of 2**-bits below its value."""
    drop = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(v, F.lit(1)).cast("double"))).cast("int") - bits)
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def value_counts(df: DataFrame, groups: list[str], value: str, keep_bits: int | None = None) -> DataFrame:
    """Counts per group and value: (groups, value, n). Rows with a null value are left out; null groups are groups.

    With ``keep_bits`` values (>= 0) are first rounded down to that many bits after the leading one, which bounds the size
    of the partial result by 64 * 2**keep_bits rows a group at a relative error of 2**-keep_bits.
    """
    v = F.col(value).cast("bigint")
    rows = df.where(F.col(value).isNotNull()).select(*groups, (v if keep_bits is None else rounded(v, keep_bits)).alias("value"))
    return rows.groupBy(*groups, "value").agg(F.count(F.lit(1)).alias("n"))


def merged(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Adds partial counts, of several days for instance, into counts of coarser or equal groups."""
    return counts.groupBy(*groups, "value").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, groups: list[str], percents: tuple[float, ...], bounds: list[float] | None = None) -> DataFrame:
    """For each group and percent q the smallest value that at least q % of the group's values do not exceed.

    ``counts`` is a result of :func:`value_counts` or :func:`merged`. Result: (groups, q, value, n), n being the number of
    values of the group. q is taken to three decimals, 0 gives the smallest value. Equal values share their ranks, groups
    with a null key are kept, an empty table gives an empty result. ``bounds`` are ascending cuts of the values, best from
    ``ranges.split_points`` over the rows that were counted; without them the counts themselves are sampled, which runs what
    they come from twice more. Any bounds give the same result, good ones give ranges of equal size.
    """
    counts = counts.select(*(F.col(g).alias(f"g{i}") for i, g in enumerate(groups)), F.col("value").cast("bigint").alias("value"), F.col("n").cast("bigint").alias("n"))
    gs = [f"g{i}" for i in range(len(groups))]
    counts = with_range(counts, "value", split_points(counts, "value") if bounds is None else bounds, "part")
    sums = counts.groupBy(*gs, "part").agg(F.sum("n").alias("part_n"))
    by_part = Window.partitionBy(*gs).orderBy("part")
    sums = sums.select(*gs, "part", (F.sum("part_n").over(by_part) - F.col("part_n")).alias("before"), "part_n", F.sum("part_n").over(Window.partitionBy(*gs)).alias("total"))
    rank = lambda q: F.greatest(F.lit(1), F.expr(f"({round(q * 1000)} * total + 99999) div 100000"))
    wanted = F.filter(
        F.array(*(F.struct(F.lit(float(q)).alias("q"), (rank(q) - F.col("before")).alias("r")) for q in percents)),
        lambda x: (x["r"] > 0) & (x["r"] <= F.col("part_n")),
    )
    sums = sums.withColumn("wanted", wanted).where("size(wanted) > 0").select(*(F.col(g).alias(f"w{g}") for g in gs), F.col("part").alias("wpart"), "wanted", "total")
    match = F.col("part") == F.col("wpart")
    for g in gs:
        match &= F.col(g).eqNullSafe(F.col(f"w{g}"))
    rows = counts.join(sums, match)
    upto = F.sum("n").over(Window.partitionBy(*gs, "part").orderBy("value"))
    rows = rows.select(*gs, "value", "n", "wanted", "total", upto.alias("upto"))
    hit = F.filter("wanted", lambda x: (x["r"] <= F.col("upto")) & (x["r"] > F.col("upto") - F.col("n")))
    return rows.select(*gs, "value", "total", F.explode(hit).alias("x")).select(*(F.col(g).alias(name) for g, name in zip(gs, groups)), F.col("x.q").alias("q"), "value", F.col("total").alias("n"))
