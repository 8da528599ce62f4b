"""Running totals over a whole table in the order of a number, through ranges with bounds from sampled quantiles.

A sample gives bounds between which about equally many rows lie; they are fixed values of the plan from then on, so a
recomputed partition finds the same ranges. Totals of the ranges give each range's offset, and only within a range are rows
sorted. The number of ranges follows the number of rows, so a range stays of the same size at any scale.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, and the most ranges there may be: beyond PER_RANGE * MOST_RANGES rows the ranges grow instead.
PER_RANGE, MOST_RANGES = 10_000, 100_000
#: Sampled values for each range; the driver receives at most SAMPLED * MOST_RANGES numbers.
SAMPLED = 20


def split_points(basis: DataFrame, column: str, per_range: int = PER_RANGE, seed: int = 11) -> list[float]:
    """Ascending bounds that cut the values of a column into ranges of about ``per_range`` rows; none for few rows.

    Counts the rows and samples them, so ``basis`` should be a stored table or cheap to compute. Nulls and NaN give no bounds. A value
    that is more frequent than a range has rows makes one bound only.
    """
    n = basis.count()
    k = min(MOST_RANGES, -(-n // per_range))
    if k <= 1:
        return []
    share = SAMPLED * k / n
    values = basis.select(F.col(column).cast("double").alias("v"))
    xs = (values if share >= 1 else values.sample(share, seed)).toPandas()["v"].to_numpy(float)
    xs = np.sort(xs[~np.isnan(xs)])
    return [float(x) for x in np.unique(xs[[len(xs) * i // k for i in range(1, k)]])] if len(xs) else []


def with_range(df: DataFrame, column: str, bounds: list[float], name: str = "_part") -> DataFrame:
    """Adds the number of the range a value lies in, ascending with the values; null and NaN come last."""
    if not bounds:
        return df.withColumn(name, F.lit(0))
    v = F.col(column).cast("double")
    edges = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="_v", outputCol="_b", handleInvalid="keep")
    rows = edges.transform(df.withColumn("_v", v))
    return rows.withColumn(name, F.coalesce(F.col("_b").cast("int"), F.lit(len(bounds) + 1))).drop("_v", "_b")


def running_total(df: DataFrame, order: list[str], amount: Column, bounds: list[float] | None = None) -> DataFrame:
    """Adds _upto: the sum of ``amount`` over all rows up to and with this one in the order of ``order``.

    The first of the columns is a number and is cut at ``bounds`` (sampled from ``df`` if not given).
    """
    bounds = split_points(df, order[0]) if bounds is None else bounds
    rows = with_range(df.withColumn("_amount", amount), order[0], bounds)
    sums = rows.groupBy("_part").agg(F.sum("_amount").alias("_sum"))
    offsets = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))  # as many rows as ranges
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_within", F.sum("_amount").over(w)).join(F.broadcast(offsets), "_part")  # at most MOST_RANGES + 2 rows
    return rows.withColumn("_upto", F.col("_within") + F.col("_before")).drop("_part", "_within", "_before", "_amount")
