"""Distinct counts for any combination of groups, from membership patterns.

Each identifier reduces to the set of groups (here: days) that contain it, kept as bitmaps of 62 groups a word; equal
patterns are counted. The pattern totals are exact and additive over identifiers, so the distinct count of any union,
intersection or difference of groups is a sum over patterns. Partial results merge before patterns are counted: bitmaps
of one identifier are or-ed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 62


def bitmaps(df: DataFrame, scope: list[str], ident: str, group_no: str) -> DataFrame:
    """(scope, ident, word, bits): the mergeable partial result, one row for each identifier and word of 62 groups.

    ``group_no`` is a whole number, below 0 too (days before 1970). Rows with a null identifier or group are left out;
    repeats change nothing.
    """
    rows = df.where(F.col(ident).isNotNull() & F.col(group_no).isNotNull())
    no = F.col(group_no).cast("bigint")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(no, F.lit(WORD)).cast("int"))
    rows = rows.select(*scope, F.col(ident).alias("ident"), F.floor(no / WORD).cast("int").alias("word"), bit.alias("bits"))
    return rows.groupBy(*scope, "ident", "word").agg(F.bit_or("bits").alias("bits"))


def merge(*partials: DataFrame) -> DataFrame:
    """Bitmaps of several parts of the data as one."""
    rows = partials[0]
    for p in partials[1:]:
        rows = rows.unionByName(p)
    keys = [c for c in rows.columns if c != "bits"]
    return rows.groupBy(*keys).agg(F.bit_or("bits").alias("bits"))


def members(maps: DataFrame, scope: list[str]) -> DataFrame:
    """One row an identifier: (scope, ident, pattern), the pattern as sorted words. Its size is bounded by the groups."""
    return maps.groupBy(*scope, "ident").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("pattern"))


def patterns(rows: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, pattern, n): how many identifiers of the scope have exactly this pattern."""
    return rows.groupBy(*scope, "pattern").agg(F.count(F.lit(1)).alias("n"))


def group_numbers(pattern: str | Column = "pattern") -> Column:
    """The numbers of the groups in a pattern."""
    has = lambda bits, i: F.call_function("shiftright", bits, i).bitwiseAND(F.lit(1).cast("bigint")) == 1
    words = F.transform(pattern, lambda w: F.transform(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: has(w["bits"], i)), lambda i: w["word"] * WORD + i))
    return F.flatten(words)


def per_group(totals: DataFrame, scope: list[str]) -> DataFrame:
    """Distinct identifiers of each single group: (scope, group_no, n)."""
    rows = totals.select(*scope, F.explode(group_numbers()).alias("group_no"), "n")
    return rows.groupBy(*scope, "group_no").agg(F.sum("n").alias("n"))


def answers(totals: DataFrame, scope: list[str], questions: dict[str, Column]) -> DataFrame:
    """Distinct identifiers that meet each condition on the column ``groups``, the array of an identifier's groups.

    A union of groups is ``exists(groups, ...)``, an intersection two of these, a difference one without the other.
    """
    rows = totals.select(*scope, "n", group_numbers().alias("groups"))
    return rows.groupBy(*scope).agg(*(F.sum(F.when(q, F.col("n")).otherwise(0)).alias(name) for name, q in questions.items()))
