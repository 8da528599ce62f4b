"""Most frequent values within bounded memory: a majority-vote sketch of hash cells.

Each cell stores the number of values that fell into it, a candidate, and the candidate's vote surplus. Merging cells adds
the totals and lets the votes of different candidates cancel. For a cell with total V, candidate k and surplus C:
C <= count(k) <= (V + C) / 2, and no other value of the cell occurs more than (V - C) / 2 times. Every worker keeps
``rows`` x ``width`` cells a field, whatever it reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

ROWS, WIDTH_BITS = 3, 10
CELLS = "fld int, row int, cell int, item string, surplus bigint, total bigint"


def _votes(cell: np.ndarray, item: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per cell the position of its strongest item and the surplus that is left when all others have voted against it."""
    order = np.lexsort((item, cell))
    c, i, w = cell[order], item[order], weight[order]
    start = np.concatenate([[0], np.flatnonzero((c[1:] != c[:-1]) | (i[1:] != i[:-1])) + 1])
    votes, c, at = np.add.reduceat(w, start), c[start], order[start]
    strong = np.lexsort((votes, c))
    last = np.concatenate([np.flatnonzero(c[strong][1:] != c[strong][:-1]), [len(c) - 1]])
    win = strong[last]
    first = np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1])
    return c[first], at[win], np.maximum(0, 2 * votes[win] - np.add.reduceat(votes, first))


def _sketch(n_fields: int, rows: int, bits: int):
    width = 1 << bits

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (n_fields, rows, width)
        total, surplus, held = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        text = np.full(shape, None, dtype=object)
        for batch in batches:
            for f in range(n_fields):
                value, code = batch.column(f"v{f}"), batch.column(f"h{f}")
                if value.null_count:
                    there = value.is_valid()
                    value, code = value.filter(there), code.filter(there)
                if not len(value):
                    continue
                item, at, n = np.unique(code.to_numpy(zero_copy_only=False), return_index=True, return_counts=True)
                words = value.take(pa.array(at)).to_numpy(zero_copy_only=False)
                for r in range(rows):
                    cell = (item >> (bits * r)) & (width - 1)
                    np.add.at(total[f, r], cell, n)
                    old = np.flatnonzero(surplus[f, r])
                    c, win, left = _votes(np.concatenate([cell, old]), np.concatenate([item, held[f, r][old]]), np.concatenate([n, surplus[f, r][old]]))
                    new_text, new_item = np.concatenate([words, text[f, r][old]])[win], np.concatenate([item, held[f, r][old]])[win]
                    text[f, r][c], held[f, r][c], surplus[f, r][c] = new_text, new_item, left
        f, r, c = np.nonzero(total)
        if len(f):
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x.astype(np.int32)) for x in (f, r, c)), pa.array(text[f, r, c], pa.string()), pa.array(surplus[f, r, c]), pa.array(total[f, r, c])],
                names=["fld", "row", "cell", "item", "surplus", "total"],
            )

    return sketch


def sketch(df: DataFrame, fields: list[str], rows: int = ROWS, bits: int = WIDTH_BITS) -> DataFrame:
    """Partial cells (fld, row, cell, item, surplus, total) of the fields, fld being the position in ``fields``.

    Fields are compared as text; nulls do not count. The cells of several parts or days may be united before merging.
    """
    texts = [F.col(c).cast("string") for c in fields]
    cols = df.select(*(t.alias(f"v{i}") for i, t in enumerate(texts)), *(F.xxhash64(t).alias(f"h{i}") for i, t in enumerate(texts)))
    return cols.mapInArrow(_sketch(len(fields), rows, bits), CELLS)


def merge(cells: DataFrame) -> DataFrame:
    """One row a cell, in the form of :func:`sketch`. By cell and candidate first, so one cell is shared by many tasks."""
    by_item = cells.groupBy("fld", "row", "cell", "item").agg(F.sum("surplus").alias("s"), F.sum("total").alias("t"))
    one = by_item.groupBy("fld", "row", "cell").agg(F.max(F.struct("s", "item")).alias("top"), F.sum("s").alias("all"), F.sum("t").alias("total"))
    return one.select("fld", "row", "cell", "top.item", F.greatest(F.lit(0), 2 * F.col("top.s") - F.col("all")).alias("surplus"), "total")


def bounds(cells: DataFrame) -> DataFrame:
    """Candidates of merged cells with bounds of their counts: (fld, item, lower, upper, n), n = values of the field."""
    n = F.sum("total").over(Window.partitionBy("fld", "row"))
    rows = cells.withColumn("n", n)
    return rows.groupBy("fld", "item").agg(F.max("surplus").alias("lower"), F.min(F.expr("(total + surplus) div 2")).alias("upper"), F.max("n").alias("n"))


def bits_for(ppm: int) -> int:
    """Width of a sketch row, in bits, for values of so many parts per million: four cells for each value there can be."""
    return max(WIDTH_BITS, (4_000_000 // ppm - 1).bit_length())


def frequent(df: DataFrame, fields: list[str], ppm: int, rows: int = ROWS, bits: int | None = None) -> DataFrame:
    """Values of each field that make up at least ``ppm`` parts per million of its non-null values.

    Result: (fld, item, count, lower, upper, n). The sketch names the candidates and is stored, a second pass counts them
    exactly. A value can only be missed by the sketch if it shares a cell with as frequent ones in every row; cells where
    that is possible are known from V - C, and values all of whose cells are such are counted as well, so the result is
    exact. What the second pass broadcasts is bounded: a field has at most rows * 1,000,000 / ppm candidates, and
    500,000 / ppm doubtful cells a row, as the totals of a row's cells add up to n. A worker's memory follows from rows,
    bits and fields, not from the data.
    """
    bits = bits_for(ppm) if bits is None else bits
    n = F.sum("total").over(Window.partitionBy("fld", "row"))
    cells = cut(merge(sketch(df, fields, rows, bits))).withColumn("n", n)
    heavy = (F.col("total") + F.col("surplus")) * 500_000 >= F.col("n") * ppm
    doubtful = (F.col("total") - F.col("surplus")) * 500_000 >= F.col("n") * ppm
    limits = F.max("surplus").alias("lower"), F.min(F.expr("(total + surplus) div 2")).alias("upper")
    named = cells.where(heavy & F.col("item").isNotNull()).groupBy("fld", "item").agg(*limits)
    totals = cells.groupBy("fld").agg(F.max("n").alias("n"))
    values = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("fld"), F.col(c).cast("string").alias("item")) for i, c in enumerate(fields)))).alias("x")).select("x.*").where("item is not null")
    hits, open_ = values.join(F.broadcast(named), ["fld", "item"], "left"), F.lit(True)
    for r in range(rows):
        cell = F.shiftright(F.xxhash64("item"), bits * r).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).cast("int")
        doubt = cells.where(doubtful & (F.col("row") == r)).select("fld", F.col("cell").alias(f"cell{r}"), F.lit(True).alias(f"doubt{r}"))
        hits = hits.withColumn(f"cell{r}", cell).join(F.broadcast(doubt), ["fld", f"cell{r}"], "left")
        open_ &= F.coalesce(f"doubt{r}", F.lit(False))
    hits = hits.where(F.col("upper").isNotNull() | open_)
    counted = hits.groupBy("fld", "item").agg(F.count(F.lit(1)).alias("count"), F.max("lower").alias("lower"), F.max("upper").alias("upper"))
    out = counted.join(F.broadcast(totals), "fld").where(F.col("count") * 1_000_000 >= F.col("n") * ppm)  # one row a field
    return out.select("fld", "item", "count", "lower", "upper", "n")
