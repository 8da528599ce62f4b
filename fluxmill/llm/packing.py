"""Sum-of-squares packing of sized items into containers of fixed capacity.

Items are spread over shards by a hash of identifier and size; there are as many shards as the number of items asks for, so
a shard is of the same size on every input and the numbers of its containers do not depend on machines or partitions. Every
shard packs by itself and keeps, besides the numbers of its open containers, the count N(g) of open containers for each
residual gap g. An item goes where the sum of N(g)**2 becomes smallest, which keeps no gap popular and lets gaps fill up
exactly. A shard leaves a few open containers only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 8192
#: Items of a shard: enough to fill its containers, few enough that many tasks pack.
PER_SHARD = 20_000
#: Beyond so many shards a task packs several, one after the other.
MOST_TASKS = 20_000


class Packer:
    """Open containers of one shard by residual gap."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.count, self.open, self.made = capacity, np.zeros(capacity + 1, np.int64), {}, 0

    def _new(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, size: int) -> int:
        """Number of the container an item of 1 <= size <= capacity goes to."""
        c, n = self.capacity, self.count
        if size == c:
            return self._new()
        # change of the sum when a container of gap g (size <= g < c) takes the item; an exact fit leaves no gap
        change = 2 - 2 * n[size:c] + 2 * n[: c - size]
        change[0] = 1 - 2 * n[size]
        change[n[size:c] == 0] = np.iinfo(np.int64).max
        gap = size + int(np.argmin(change))
        if change[gap - size] > 2 * n[c - size] + 1:
            number, gap = self._new(), c
        else:
            number = self.open[gap].pop()
            n[gap] -= 1
        left = gap - size
        if left:
            self.open.setdefault(left, []).append(number)
            n[left] += 1
        return number


def _pack(capacity: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, shard, empty = None, None, None
        for batch in batches:
            at, pieces, sizes, bins = [], [], [], []
            for i, (here, size) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("size").to_pylist())):
                if here != shard:
                    packer, shard, empty = Packer(capacity), here, None
                if size <= 0:
                    empty = packer._new() if empty is None else empty
                    todo = [(0, empty)]
                else:
                    full, rest = divmod(size, capacity)
                    todo = [(capacity, packer.place(capacity)) for _ in range(full)] + ([(rest, packer.place(rest))] if rest else [])
                for no, (part, number) in enumerate(todo):
                    at.append(i)
                    pieces.append(no)
                    sizes.append(part)
                    bins.append((shard << 32) + number)
            if at:
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(pieces, pa.int32()), pa.array(sizes, pa.int64()), pa.array(bins, pa.int64())], names=["id", "piece", "size", "container"])

    return pack


def pack(df: DataFrame, ident: str, size: str, capacity: int = CAPACITY, per_shard: int = PER_SHARD) -> DataFrame:
    """Container of every item: (ident, piece, size, container).

    Items above the capacity are split into full containers and a remainder, which is packed like an item; no other item
    is split. Null, zero and negative sizes take no room: such items share one container of their shard, with size 0. A
    null identifier is an item as well, and repeated rows are items each. An empty table gives an empty result. The same
    items give the same containers whatever the partitions. ``df`` is read twice, to count and to pack: hand in a stored
    or checkpointed table.
    """
    rows = df.select(F.col(ident).cast("bigint").alias("id"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("size"))
    shards = max(1, -(-rows.count() // per_shard))
    tasks = min(shards, MOST_TASKS)
    rows = rows.withColumn("h", F.xxhash64("id", "size")).withColumn("shard", F.pmod("h", F.lit(shards)))
    spread = rows.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "h", "id", "size").select("id", "size", "shard")
    out = spread.mapInArrow(_pack(capacity), "id bigint, piece int, size bigint, container bigint")
    return out.select(F.col("id").alias(ident), "piece", F.col("size").alias(size), "container")


def in_several(packed: DataFrame, ident: str) -> DataFrame:
    """Identifiers of the items that lie in more than one container."""
    rows = packed.groupBy(ident).agg(F.max("piece").alias("last"), F.min("container").alias("a"), F.max("container").alias("b"))
    return rows.where("last > 0 and a < b").select(ident)


def fill(packed: DataFrame, size: str, capacity: int = CAPACITY) -> DataFrame:
    """Containers by how full they are, in twentieths: (filled, containers, size, share of all room that is used)."""
    per = packed.groupBy("container").agg(F.sum(size).alias("size")).where("size > 0")
    level = F.expr(f"size * 20 div {capacity}").cast("int")
    rows = per.groupBy(level.alias("filled")).agg(F.count(F.lit(1)).alias("containers"), F.sum("size").alias("size"))
    everything = Window.partitionBy()
    return rows.withColumn("used", F.sum("size").over(everything) / (F.sum("containers").over(everything) * capacity))
