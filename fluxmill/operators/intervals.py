"""Continuous periods and gaps of overlapping intervals, through canonical dyadic blocks.

An interval of whole microseconds [s, e] is laid on a half-microsecond axis as [2s, 2e+1): intervals that touch share a
unit there and instants have the length of one unit, so both need no special case. The axis is cut into slices of
2**slice_bits units; (key, slice) is the unit of distribution, so a key that holds a large part of all rows is spread over
all its slices. Within a slice each interval is decomposed into its canonical dyadic blocks, blocks below another block
are removed, complete sibling pairs are merged upward, and adjacent blocks coalesce into periods. Rows arrive sorted, so a
worker holds one Arrow batch and the last open period. Only the first and last period of a slice take part in stitching
slices together, which is at most two rows a slice however many rows the key has.

An interval over many slices goes into its first and last slice only. The slices between are covered whole: they are blocks
of a higher level, an interval on the axis of slice numbers, and are merged there by the same steps, on as many levels as
the longest interval asks for. What a covered slice holds of other intervals lies below these blocks and is absorbed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_BITS = 33
#: Intervals that reach over more slices than this become two edges and a cover; slice numbers are sliced by COVER_BITS.
LONG, COVER_BITS = 64, 12
LOCAL = "key string, slice bigint, lo bigint, hi bigint, prev_hi bigint, edge boolean"


def dyadic_blocks(lo: np.ndarray, hi: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and levels of the canonical dyadic blocks of the intervals [lo, hi), no block above level ``top``."""
    starts, levels = [], []
    for level in range(top + 1):
        first, past = (lo + ((1 << level) - 1)) >> level, hi >> level
        some = first < past
        if level < top:
            left, right = some & (first & 1 == 1), some & (past & 1 == 1)
            found = np.concatenate([first[left], past[right] - 1])
        else:
            n = np.where(some, past - first, 0)
            found = np.repeat(first, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        starts.append(found << level)
        levels.append(np.full(len(found), level, dtype=np.int64))
        alive = ((hi - lo) >> level) > 0
        if not alive.all():
            lo, hi = lo[alive], hi[alive]
    return np.concatenate(starts), np.concatenate(levels)


def maximal_blocks(starts: np.ndarray, levels: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Without repeats and without blocks covered by an ancestor; complete sibling pairs replaced by their parent."""
    order = np.unique((starts << 6) | (63 - levels))  # by start, the larger block first
    starts, levels = order >> 6, 63 - (order & 63)
    ends = starts + (np.int64(1) << levels)
    if len(ends) > 1:
        reach = np.maximum.accumulate(ends)
        keep = np.concatenate([[True], ends[1:] > reach[:-1]])  # blocks are laminar: below the reach means inside
        starts, levels = starts[keep], levels[keep]
    for level in range(int(levels.min()) if len(levels) else top, top):
        at = np.flatnonzero(levels[:-1] == level)
        at = at[(levels[at + 1] == level) & (starts[at + 1] - starts[at] == 1 << level) & (starts[at] & ((2 << level) - 1) == 0)]
        if len(at):
            levels[at] += 1
            keep = np.ones(len(starts), dtype=bool)
            keep[at + 1] = False
            starts, levels = starts[keep], levels[keep]
    return starts, levels


def union_of(lo: np.ndarray, hi: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint maximal periods of [lo, hi), never reaching over a multiple of 2**bits."""
    starts, levels = maximal_blocks(*dyadic_blocks(lo, hi, bits), bits)
    ends = starts + (np.int64(1) << levels)
    if not len(starts):
        return starts, ends
    new = np.concatenate([[True], (starts[1:] != ends[:-1]) | (starts[1:] >> bits != starts[:-1] >> bits)])
    first = np.flatnonzero(new)
    return starts[first], ends[np.concatenate([first[1:] - 1, [len(ends) - 1]])]


def _fold(bits: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last period so far, which later rows may extend: key, slice, lo, hi, prev_hi
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy(zero_copy_only=False)
            cut, lo, hi = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("slice", "lo", "hi"))
            if held:
                key = np.concatenate([np.array([held[0]], dtype=object), key])
                cut, lo, hi = (np.concatenate([[v], x]) for v, x in zip(held[1:4], (cut, lo, hi)))
            group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (cut[1:] != cut[:-1]))]).astype(np.int64)
            start_of = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
            shift = (group << bits) - (cut << bits)
            plo, phi = union_of(lo + shift, hi + shift, bits)
            g = plo >> bits
            k, c = key[start_of[g]], cut[start_of[g]]
            back = (c << bits) - (g << bits)
            plo, phi = plo + back, phi + back
            first = np.concatenate([[True], g[1:] != g[:-1]])
            last = np.concatenate([first[1:], [True]])
            prev = np.concatenate([[0], phi[:-1]])
            no_prev = first.copy()
            if held and held[4] is not None:
                prev[0], no_prev[0] = held[4], False
            n = len(plo) - 1
            held = (k[n], c[n], plo[n], phi[n], None if no_prev[n] else prev[n])
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k[:n], pa.string()), pa.array(c[:n]), pa.array(plo[:n]), pa.array(phi[:n]), pa.array(prev[:n], pa.int64(), mask=no_prev[:n]), pa.array((no_prev | last)[:n])],
                    names=["key", "slice", "lo", "hi", "prev_hi", "edge"],
                )
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array([held[0]], pa.string()), *(pa.array([int(v)], pa.int64()) for v in held[1:4]), pa.array([None if held[4] is None else int(held[4])], pa.int64()), pa.array([True])],
                names=["key", "slice", "lo", "hi", "prev_hi", "edge"],
            )

    return fold


def _half_open(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Intervals (key, a, b) in half units, b excluded."""
    rows = df.select(F.col(key).cast("string").alias("key"), (F.col(start).cast("bigint") * 2).alias("a"), (F.col(end).cast("bigint") * 2 + 1).alias("b"))
    return rows.where("key is not null and a is not null and b is not null and a < b")


def _pieces(rows: DataFrame, bits: int) -> tuple[DataFrame, DataFrame | None]:
    """(key, slice, lo, hi) of intervals (key, a, b), and the merged covers (key, lo, hi) where slices are covered whole."""
    first, last = F.shiftright("a", bits), F.shiftright(F.col("b") - 1, bits)
    low = F.shiftleft(F.col("slice"), bits)
    furthest = rows.agg(F.max(last - first)).first()[0]
    rows = rows.distinct()  # repeats end before they travel
    there = F.sequence(first, last)
    if furthest is not None and furthest > LONG:
        there = F.when(last - first > LONG, F.array(first, last)).otherwise(there)
    pieces = rows.select("key", "a", "b", F.explode(there).alias("slice")).select("key", "slice", F.greatest(F.col("a"), low).alias("lo"), F.least(F.col("b"), low + F.lit(1 << bits)).alias("hi"))
    if furthest is None or furthest <= LONG:
        return pieces, None
    covers = _merged(rows.where(last - first > LONG).select("key", (first + 1).alias("a"), last.alias("b")), COVER_BITS)
    # slices that hold pieces and are covered get one more piece, the whole slice
    held = pieces.select("key", "slice").join(covers.select("key").distinct(), "key", "left_semi").distinct()
    both = held.select("key", F.col("slice").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("bigint").alias("until")).unionByName(covers.select("key", F.col("lo").alias("at"), F.lit(0).alias("side"), F.col("hi").alias("until")))
    until = F.last("until", ignorenulls=True).over(Window.partitionBy("key").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    whole = both.withColumn("until", until).where("side = 1 and at < until").select("key", F.col("at").alias("slice"))
    whole = whole.select("key", "slice", low.alias("lo"), (low + F.lit(1 << bits)).alias("hi"))
    return pieces.unionByName(whole), covers.select("key", F.shiftleft("lo", bits).alias("lo"), F.shiftleft("hi", bits).alias("hi"))


def _local(rows: DataFrame, bits: int) -> DataFrame:
    """Periods of each (key, slice), and covers; edge marks the first and last one of a slice, and every cover."""
    pieces, covers = _pieces(rows, bits)
    local = pieces.repartition("key", "slice").sortWithinPartitions("key", "slice", "lo").mapInArrow(_fold(bits), LOCAL)
    if covers is None:
        return local
    null = F.lit(None).cast("bigint")
    return local.unionByName(covers.select("key", null.alias("slice"), "lo", "hi", null.alias("prev_hi"), F.lit(True).alias("edge")))


def _with_previous(local: DataFrame) -> DataFrame:
    """prev: how far the periods before reach, across slices. Inner rows stay spread by slice, only edges gather by key."""
    w = Window.partitionBy("key", F.when(~F.col("edge"), F.col("slice"))).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    return local.withColumn("prev", F.when(F.col("edge"), F.max("hi").over(w)).otherwise(F.col("prev_hi"))).withColumn("prev", F.greatest("prev", "prev_hi"))


def _merged(rows: DataFrame, bits: int) -> DataFrame:
    """Disjoint periods (key, lo, hi) of half-open intervals (key, a, b)."""
    part: Column = F.when(~F.col("edge"), F.col("slice"))
    rows = _with_previous(_local(rows, bits)).withColumn("part", part)
    w = Window.partitionBy("key", "part").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    new = F.when(F.col("prev").isNull() | (F.col("prev") < F.col("lo")), 1).otherwise(0)
    return rows.withColumn("no", F.sum(new).over(w)).groupBy("key", "part", "no").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("key", "lo", "hi")


def gaps(df: DataFrame, key: str, start: str, end: str, slice_bits: int = SLICE_BITS) -> DataFrame:
    """Gaps of positive length between the continuous periods of each key: (key, gap_start, gap_end).

    ``start`` and ``end`` are whole numbers, both ends included; intervals that overlap or share an end form one period.
    Rows with a null key, start or end and rows of negative length are left out; repeated rows change nothing; an empty
    table gives an empty result. Other columns are ignored. An interval of any length makes five rows at most on its way,
    or as many as the slices it touches if these are not more than LONG.
    """
    rows = _with_previous(_local(_half_open(df, key, start, end), slice_bits)).where("prev < lo")
    return rows.select(F.col("key").alias(key), F.shiftright(F.col("prev") - 1, 1).alias("gap_start"), F.shiftright("lo", 1).alias("gap_end"))


def periods(df: DataFrame, key: str, start: str, end: str, slice_bits: int = SLICE_BITS) -> DataFrame:
    """Continuous periods of each key: (key, period_start, period_end). Cases as in :func:`gaps`."""
    rows = _merged(_half_open(df, key, start, end), slice_bits)
    return rows.select(F.col("key").alias(key), F.shiftright("lo", 1).alias("period_start"), F.shiftright(F.col("hi") - 1, 1).alias("period_end"))
