"""Stored tables and the cleaned views that the operators start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def address(c: str | Column) -> Column:
    """Address as it is compared: without blanks at the ends, lower case."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def counter(c: str | Column) -> Column:
    """Counter with its missing marker (-1) turned into null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != -1, c)


def day_text(us: str | Column) -> Column:
    """UTC day 'YYYY-MM-DD' of epoch microseconds."""
    us = F.col(us) if isinstance(us, str) else us
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd")


def day_number(us: str | Column) -> Column:
    """Days since 1970 of epoch microseconds (floored, so also right before 1970)."""
    us = F.col(us) if isinstance(us, str) else us
    return F.unix_date(F.to_date(F.timestamp_micros(us)))


def records(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Each record once: stored copies of one (sid, seq) collapse.

    Copies carry equal values, so grouping by (sid, seq) and the requested values keeps one of them without having to
    choose. Rows whose sid or seq is null cannot be copies of anything and stay as they are. The values are computed
    before the shuffle and nothing else is moved. Result: sid, seq, own (autoid of rows without a name, else null) and
    the requested columns.
    """
    wanted = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]
    nameless = F.col("sid").isNull() | F.col("seq").isNull()
    return df.select("sid", "seq", F.when(nameless, F.col("autoid")).alias("own"), *wanted).distinct()
