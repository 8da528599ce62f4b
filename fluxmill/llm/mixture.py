"""Mixing sources to target shares along a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1], share * (1 + tilt * (2t - 1)): its share on average,
rising for a positive tilt, falling for a negative one. The integral of the schedule times all tokens is the source's
cumulative token demand. Documents of a source stand in the order of a hash, again and again up to the source's cap; the
tokens before a use are a point on that demand, and the inverse of the integral gives the use its training position. Range
sorting all uses by position mixes the sources as the schedules say, and a source that cannot meet its demand is one whose
last use ends before the course does. Offsets come from sums of hash ranges within a source, so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of the hash that make a range: 16**4 ranges a source, each summed and then ordered by itself.
RANGE_DIGITS = 4
ORDER = ("position", "source", "doc_id", "repeat")


def source_name(c: str | Column) -> Column:
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def demands(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target's demand and supply in tokens: (source, target_share, max_repeats, docs, size, demand, supply).

    ``sizes`` has the columns source, docs, size, one row a source. demand = target_share * (size of all targets'
    documents), supply is the demand or, if that is less, max_repeats times the source's size. Targets that share a name
    count once, with the larger share and repeats; a null share or cap counts as 0.
    """
    goal = targets.select(source_name("source").alias("source"), F.coalesce(F.col("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.col("max_repeats"), F.lit(0)).alias("max_repeats"))
    goal = goal.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = goal.join(sizes, "source", "left").withColumns({"docs": F.coalesce("docs", F.lit(0)), "size": F.coalesce("size", F.lit(0))})
    rows = rows.withColumn("demand", F.col("target_share") * F.sum("size").over(Window.partitionBy()))  # as many rows as targets
    return rows.withColumn("supply", F.least("demand", (F.col("max_repeats") * F.col("size")).cast("double")))


def position(share_done: Column, tilt: Column) -> Column:
    """Time at which the demand of a source with this tilt has reached the given share of all it will be."""
    a = 1 - tilt
    return F.coalesce(2 * share_done / F.nullif(a + F.sqrt(a * a + 4 * tilt * share_done), F.lit(0.0)), F.lit(0.0))


def mix(docs: DataFrame, targets: DataFrame, tilts: dict[str, float] | None = None, digits: int = RANGE_DIGITS) -> tuple[DataFrame, DataFrame]:
    """Training order and report: ((doc_id, source, repeat, tokens, position, until), (source, ..., actual_share, ...)).

    ``docs`` has doc_id, source (any spelling of case and outer blanks) and tokens, and is read several times: hand in a
    stored or checkpointed table. A source is used from its first to its last document again and again until its supply
    is reached, so no document is used more than max_repeats times and repeats differ by one at most. A use stands at the
    position its demand has when it begins and lasts ``until`` it has grown by the use's tokens (1 at most). The order is
    range partitioned and sorted by position, and the report is taken from it: tokens used, repeats, actual share,
    overshoot (tokens used beyond the demand, less than the last document) and ends_at, the end of a source's last use
    (1 where the demand is met). Documents with a null source or one without target, and those without tokens, are left
    out; targets without documents appear in the report with 0 tokens, ending at 0. Repeated rows are documents each.
    """
    docs = docs.select("doc_id", source_name("source").alias("source"), F.col("tokens").cast("bigint").alias("tokens")).where("source is not null and tokens > 0")
    goal = targets.select(source_name("source").alias("source")).where("source is not null").distinct()
    docs = docs.join(goal, "source", "left_semi").withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    docs = docs.withColumn("range", F.substring("key", 1, digits))
    sums = docs.groupBy("source", "range").agg(F.sum("tokens").alias("b_size"), F.count(F.lit(1)).alias("b_docs"))
    offsets = sums.select("source", "range", (F.sum("b_size").over(Window.partitionBy("source").orderBy("range")) - F.col("b_size")).alias("offset"))
    plan = demands(sums.groupBy("source").agg(F.sum("b_docs").alias("docs"), F.sum("b_size").alias("size")), targets)
    tilt = F.lit(0.0)
    for s, x in (tilts or {}).items():
        tilt = F.when(F.col("source") == s, F.lit(float(x))).otherwise(tilt)
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = docs.withColumn("upto", F.sum("tokens").over(within)).join(offsets, ["source", "range"]).join(plan.select("source", "size", "demand", "supply").where("supply > 0"), "source")
    placed = placed.withColumn("before", F.col("offset") + F.col("upto") - F.col("tokens"))
    rounds = F.sequence(F.lit(0), F.ceil(F.col("supply") / F.col("size")).cast("int") - 1)
    uses = placed.select("doc_id", "source", "tokens", "demand", "supply", "size", "before", F.explode(rounds).alias("repeat"))
    uses = uses.withColumn("done", F.col("repeat") * F.col("size") + F.col("before")).where("done < supply")
    until = F.least(F.lit(1.0), (F.col("done") + F.col("tokens")) / F.col("demand"))
    uses = uses.select("doc_id", "source", "repeat", "tokens", position(F.col("done") / F.col("demand"), tilt).alias("position"), position(until, tilt).alias("until"))
    order = uses.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return order, report(order, plan)


def report(order: DataFrame, plan: DataFrame) -> DataFrame:
    """What each target got, from the uses in their training order."""
    used = order.groupBy("source").agg(F.sum("tokens").alias("tokens"), (F.max("repeat") + 1).alias("most_repeats"), F.max("until").alias("until"))
    rows = plan.join(used, "source", "left").withColumns({"tokens": F.coalesce("tokens", F.lit(0)), "most_repeats": F.coalesce("most_repeats", F.lit(0))})
    rows = rows.withColumn("actual_share", F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy()), F.lit(0)))
    rows = rows.withColumn("overshoot", F.greatest(F.lit(0.0), F.col("tokens") - F.col("demand")))
    return rows.withColumn("ends_at", F.when(F.coalesce("demand", F.lit(0.0)) <= 0, F.lit(1.0)).otherwise(F.coalesce("until", F.lit(0.0)))).drop("until")
