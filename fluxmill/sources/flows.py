"""The flow view: one row a stored record, addresses and counters cleaned, every column nullable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import address, counter, table

COUNTERS = ("spkts", "dpkts", "sbytes", "dbytes")
#: Columns that swap when a record is reversed.
PAIRS = (
    ("saddr", "daddr"), ("saddr_i", "daddr_i"), ("sport", "dport"), ("spkts", "dpkts"), ("sbytes", "dbytes"), ("sappbytes", "dappbytes"), ("sloss", "dloss"), ("sttl", "dttl"), ("stos", "dtos"),
    ("smac", "dmac"), ("sco", "dco"), ("sas", "das"), ("sloc", "dloc"), ("suser", "duser"),
)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(table(spark, sf_dir, "argus"))


def clean(df: DataFrame) -> DataFrame:
    return df.withColumns({"saddr": address("saddr"), "daddr": address("daddr"), **{c: counter(c) for c in COUNTERS}})


def reverse(df: DataFrame, when=None) -> DataFrame:
    """Every source half swapped with its destination half, in all rows or in those where ``when`` holds."""
    here = set(df.columns)
    new = {}
    for s, d in PAIRS:
        if s in here and d in here:
            if when is None:
                new[s], new[d] = F.col(d), F.col(s)
            else:
                new[s], new[d] = F.when(when, F.col(d)).otherwise(F.col(s)), F.when(when, F.col(s)).otherwise(F.col(d))
    return df.withColumns(new)


def both_ways(df: DataFrame) -> DataFrame:
    """Every record as it is and once more reversed (column ``reversed``), in one pass over the columns that are used."""
    return reverse(df.withColumn("reversed", F.explode(F.array(F.lit(False), F.lit(True)))), F.col("reversed"))


def one_way(df: DataFrame) -> DataFrame:
    """Both directions as records of their own with source counters only; those without source packets are left out."""
    zero = {c: F.lit(0).cast(t) for c, t in df.dtypes if c in ("dpkts", "dbytes", "dappbytes", "dloss")}
    return both_ways(df).withColumns(zero).where("spkts > 0")


def normalised(df: DataFrame) -> DataFrame:
    """The lower address in front: by number for IPv4, by text for others; equal addresses by port."""
    swap = F.coalesce(F.when(F.col("saddr_i").isNotNull() & F.col("daddr_i").isNotNull(), F.col("saddr_i") > F.col("daddr_i")).otherwise(F.col("saddr") > F.col("daddr")), F.lit(False))
    return reverse(df.withColumn("_swap", swap), F.col("_swap")).drop("_swap")


def strip(df: DataFrame, *sections: str) -> DataFrame:
    """Whole sections set to null, by name."""
    #: Which columns belong to a section.
    members = {
        "metric": "spkts dpkts sbytes dbytes sappbytes dappbytes", "ipattr": "sttl dttl stos dtos", "mac": "smac dmac", "icmp": "inode", "network": "status sloss dloss", "cocode": "sco dco", "asn": "sas das",
        "local": "sloc dloc", "suser": "suser", "duser": "duser", "label": "label", "transport": "sid inf seq",
    }
    gone = {c for s in sections for c in members[s].split()}
    return df.withColumns({c: F.lit(None).cast(t) for c, t in df.dtypes if c in gone})
