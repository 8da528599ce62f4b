"""Sessions of activity, through merging interval state.

Every event opens the interval from its time to the end of the inactivity gap; intervals of one key that overlap merge.
Events within one slot of the gap's length always overlap, so they merge first, by a sum that starts on the map side: what
is left of a key is bounded by the length of time and not by its events. The slots' intervals merge within slices of SLOTS
slots, so that a long history is shared by many tasks, and only the first and last session of a slice take part in joining
slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 4096


def slot_of(us: str, length_us: int) -> Column:
    """Number of the slot of ``length_us`` that a time lies in, also before 1970."""
    return F.expr(f"({us} - pmod({us}, {length_us}L)) div {length_us}L")


def sessions(df: DataFrame, key: str, time_us: str, gap_s: float, totals: tuple[str, ...] = (), slots: int = SLOTS) -> DataFrame:
    """Sessions of each key: key, start_us, end_us, duration_us, n and the sums of the columns ``totals``.

    A session ends where the next event comes more than ``gap_s`` seconds later; exactly ``gap_s`` does not divide. start
    and end are the first and last event. Rows with a null key or time are left out, nulls in ``totals`` count as 0, equal
    times and repeated rows count as events of one session, and an empty table gives an empty result. In a batch every
    event is there, however late it arrived; the streaming form waits for late ones up to its watermark.
    """
    gap = round(gap_s * 1_000_000)
    sums = [f"t{i}" for i in range(len(totals))]
    rows = df.select(F.col(key).alias("key"), F.col(time_us).cast("bigint").alias("us"), *(F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(t) for c, t in zip(totals, sums)))
    states = rows.where("key is not null and us is not null").groupBy("key", slot_of("us", max(1, gap)).alias("slot"))
    states = states.agg(F.min("us").alias("a"), F.max("us").alias("b"), F.count(F.lit(1)).alias("n"), *(F.sum(t).alias(t) for t in sums))
    merge = [F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"), *(F.sum(t).alias(t) for t in sums)]
    if gap:
        open_for = F.concat((F.col("b") - F.col("a") + gap).cast("string"), F.lit(" microseconds"))
        # session_window joins intervals that touch, so an event exactly gap later still belongs to the session
        window = F.session_window(F.timestamp_micros("a"), open_for)
        parts = states.groupBy("key", slot_of("slot", slots).alias("slice"), window).agg(*merge).drop("session_window")
        here = Window.partitionBy("key", "slice").orderBy("a")
        edge = F.lag("a").over(here).isNull() | F.lead("a").over(here).isNull()
        parts = parts.withColumn("part", F.when(~edge, F.col("slice")))
        w = Window.partitionBy("key", "part").orderBy("a")
        new = F.when(F.col("a") - F.lag("b").over(w) <= gap, 0).otherwise(1)
        parts = parts.withColumn("new", new).withColumn("no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        states = parts.groupBy("key", "part", "no").agg(*merge)
    return states.select(F.col("key").alias(key), F.col("a").alias("start_us"), F.col("b").alias("end_us"), (F.col("b") - F.col("a")).alias("duration_us"), "n", *(F.col(t).alias(c) for t, c in zip(sums, totals)))


def stream_sessions(df: DataFrame, key: str, ts: str, gap_s: int, late: str, totals: tuple[str, ...] = ()) -> DataFrame:
    """The same over a stream: events up to ``late`` behind the newest still extend, join or bridge open sessions.

    A session is emitted (append mode) once the watermark has passed its end; later events than that are dropped.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    out = rows.groupBy(F.col(key), F.session_window(ts, f"{gap_s} seconds").alias("w")).agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n"), *(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in totals)
    )
    us = lambda c: F.unix_micros(c)
    return out.select(key, us("first").alias("start_us"), us("last").alias("end_us"), (us("last") - us("first")).alias("duration_us"), "n", *totals)
