"""Totals over trailing windows of days, through event-contribution deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trailing_totals(df: DataFrame, key: str, day: str, amount: str, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """For each key and each day from its first to its last: the totals and daily averages of the trailing windows.

    ``day`` is a day number (days since 1970). Each daily amount adds at its day and subtracts when it leaves a window; the
    running sum of these deltas is the window's total. Amounts are summed per key and day before anything else moves, so
    no task sees more than (days x (windows + 2)) rows of a key, however many rows the key has.

    Rows with a null key or day are left out, a null amount counts as 0 but its day counts as a day with activity; days
    without rows appear with what is still in the window. Result: key, day, day_no (0 on the key's first day), total_w and
    avg_w for each window w, where avg_w = total_w / w. An empty table gives an empty result.
    """
    daily = (
        df.select(F.col(key).alias("key"), F.col(day).cast("int").alias("day"), F.coalesce(F.col(amount).cast("bigint"), F.lit(0)).alias("amount"))
        .where("key is not null and day is not null")
        .groupBy("key", "day")
        .agg(F.sum("amount").alias("amount"))
    )
    per_key = Window.partitionBy("key")
    spans = daily.withColumns({"first": F.min("day").over(per_key), "last": F.max("day").over(per_key)})
    zero = [F.lit(0).cast("bigint").alias(f"d{w}") for w in windows]
    enter = F.struct(F.col("day").alias("day"), *(F.col("amount").alias(f"d{w}") for w in windows))
    leave = [F.struct((F.col("day") + w).alias("day"), *((-F.col("amount") if v == w else F.lit(0).cast("bigint")).alias(f"d{v}") for v in windows)) for w in windows]
    calendar = F.when(
        F.col("day") == F.col("first"), F.transform(F.sequence("first", "last"), lambda d: F.struct(d.alias("day"), *zero))
    ).otherwise(F.array().cast("array<struct<day:int," + ",".join(f"d{w}:bigint" for w in windows) + ">>"))
    deltas = spans.select("key", "first", "last", F.explode(F.concat(F.array(enter, *leave), calendar)).alias("x")).select("key", "first", "last", "x.*")
    deltas = deltas.where("day <= last").groupBy("key", "first", "day").agg(*(F.sum(f"d{w}").alias(f"d{w}") for w in windows))
    running = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    out = deltas.select("key", "first", "day", *(F.sum(f"d{w}").over(running).alias(f"total_{w}") for w in windows))
    averages = [(F.col(f"total_{w}") / w).alias(f"avg_{w}") for w in windows]
    return out.select(F.col("key").alias(key), F.col("day"), (F.col("day") - F.col("first")).alias("day_no"), *(f"total_{w}" for w in windows), *averages)
