"""Ordered per-key results although a few keys hold most rows.

Rows are range partitioned on (key, order) with bounds from sampled quantiles, so a heavy key spans several partitions
and a partition of light keys holds many. A sorted partition folds to one state per key it meets: count, sums, first and
last position, largest step. The few states are stitched by key: counts and sums add up, and the
step over each boundary is taken between the last row of one state and the first of the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _fold(sums: tuple[str, ...]):
    names = ["key", "n", "first", "last", "step", *sums]
    types = [pa.string()] + [pa.int64()] * (len(names) - 1)

    def states(batch: pa.RecordBatch) -> list[np.ndarray]:
        """One array a field, over the keys of the batch in their order."""
        raw = batch.column("key").to_numpy(zero_copy_only=False)
        start = np.concatenate([[0], np.flatnonzero(raw[1:] != raw[:-1]) + 1])
        end = np.concatenate([start[1:] - 1, [len(raw) - 1]])
        at = batch.column("at")
        timed = ~np.asarray(at.is_null())
        t = np.asarray(at.fill_null(0), dtype=np.int64)
        n_timed = np.add.reduceat(timed.astype(np.int64), start)
        first = np.minimum(end - n_timed + 1, end)  # rows without a position sort first in their key
        step = np.zeros(len(t), dtype=np.int64)
        step[1:] = np.where(timed[1:] & timed[:-1], t[1:] - t[:-1], 0)
        step[start] = 0
        amounts = [np.add.reduceat(np.asarray(batch.column(c).fill_null(0), dtype=np.int64), start) for c in sums]
        return [raw[start], end - start + 1, t[first], t[end], np.maximum.reduceat(step, start), *amounts, n_timed == 0]

    def one(rows: list[np.ndarray], i: int) -> list:
        gone = bool(rows[-1][i])
        return [rows[0][i], int(rows[1][i]), None if gone else int(rows[2][i]), None if gone else int(rows[3][i]), *(int(x[i]) for x in rows[4:-1])]

    def merged(a: list, b: list) -> list:
        over = b[2] - a[3] if b[2] is not None and a[3] is not None else 0
        return [a[0], a[1] + b[1], b[2] if a[2] is None else a[2], a[3] if b[3] is None else b[3], max(a[4], b[4], over), *(x + y for x, y in zip(a[5:], b[5:]))]

    def some(rows: list[np.ndarray], lo: int, hi: int) -> pa.RecordBatch:
        gone = rows[-1][lo:hi]
        columns = [pa.array(rows[0][lo:hi], types[0]), pa.array(rows[1][lo:hi]), *(pa.array(x[lo:hi], mask=gone) for x in rows[2:4]), *(pa.array(x[lo:hi]) for x in rows[4:-1])]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def out(row: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the state of the last key, which the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = states(batch)
            n, lo = len(rows[0]), 0
            if held:
                if held[0] == rows[0][0]:
                    held, lo = merged(held, one(rows, 0)), 1
                if n > lo:
                    yield out(held)
                    held = None
            if n > lo:
                if n - 1 > lo:
                    yield some(rows, lo, n - 1)
                held = one(rows, n - 1)
        if held:
            yield out(held)

    return fold


def partial_states(df: DataFrame, key: str, at: str, sums: dict[str, str], tiebreak: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """States (key, n, first, last, step, sums) of every key and partition; several for a key that spans partitions."""
    names = tuple(f"s{i}" for i in range(len(sums)))
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(at).cast("bigint").alias("at"), *(F.col(c).alias(f"tie{i}") for i, c in enumerate(tiebreak)), *(F.col(c).cast("bigint").alias(n) for n, c in zip(names, sums.values())))
    order = ["key", "at", *(f"tie{i}" for i in range(len(tiebreak)))]
    spread = rows.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order).select("key", "at", *names)
    schema = "key string, n bigint, first bigint, last bigint, step bigint" + "".join(f", {n} bigint" for n in names)
    out = spread.mapInArrow(_fold(names), schema)
    return out.select("key", "n", "first", "last", "step", *(F.col(n).alias(c) for n, c in zip(names, sums)))


def stitch(states: DataFrame, key: str, sums: tuple[str, ...]) -> DataFrame:
    """One row a key: n, first, last, longest_step (null below two positioned rows) and the sums."""
    w = Window.partitionBy("key").orderBy(F.col("first").asc_nulls_last(), F.col("last"))
    over = F.when(F.col("first").isNotNull(), F.col("first") - F.lag("last").over(w))
    rows = states.withColumn("step", F.greatest("step", over))
    longest = F.when(F.max("last") > F.min("first"), F.max("step"))
    return rows.groupBy(F.col("key").alias(key)).agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), longest.alias("longest_step"), *(F.sum(c).alias(c) for c in sums)
    )


def keyed_fold(df: DataFrame, key: str, at: str, sums: dict[str, str], tiebreak: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """Per key: number of rows, first and last position, longest step between consecutive positions, and sums.

    ``at`` gives the order within a key, ``tiebreak`` further columns that let the range partitioner split a key even
    where all its positions are equal. A null key is a key of its own; rows with a null position count in n and the sums
    only; null amounts count as 0; repeated rows count each; longest_step is null for keys whose positions do not differ;
    an empty table gives an empty result.
    """
    return stitch(partial_states(df, key, at, sums, tiebreak, partitions), key, tuple(sums))
