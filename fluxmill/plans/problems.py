"""Queries of the general data-pipeline problems over the stored flow records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals, rolling, sessions, skew
from ..session import cut
from ..sources.tables import address, counter, day_number, records, table
from .registry import DADDR, RECORDS, SADDR, core

# --- 1: overlapping and gapped intervals


def _length_us() -> Column:
    by_dur = F.round(F.col("dur") * 1e6).cast("bigint")
    return F.coalesce(by_dur, F.col("ltime_us") - F.col("stime_us"), F.lit(0))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "argus").where("stime_us is not null and saddr is not null")
    return stored.select(address("saddr").alias("saddr"), F.col("stime_us").alias("s"), (F.col("stime_us") + _length_us()).alias("e")).where("e >= s")


_P1 = """WITH spans AS (
  SELECT lower(trim(saddr)) AS saddr, stime_us AS s,
         stime_us + coalesce(cast(round(dur * 1e6) AS BIGINT), ltime_us - stime_us, 0) AS e
  FROM argus WHERE stime_us IS NOT NULL AND saddr IS NOT NULL),
seen AS (SELECT saddr, s, e, max(e) OVER (PARTITION BY saddr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans WHERE e >= s)
"""


@core("p1_found", _P1 + """SELECT saddr, reach AS gap_start_us, s AS gap_end_us FROM seen WHERE reach < s
  AND date_trunc('day', make_timestamp(reach)) = date_trunc('day', make_timestamp(s))""")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps within a UTC day. Copies of a record cover what it covers, so they need not be removed first."""
    rows = intervals.gaps(_spans(spark, sf_dir), "saddr", "s", "e").where(day_number("gap_start") == day_number("gap_end"))
    return rows.select("saddr", F.col("gap_start").alias("gap_start_us"), F.col("gap_end").alias("gap_end_us"))


@core("p1_periods", _P1 + """, numbered AS (SELECT *, sum(CASE WHEN reach >= s THEN 0 ELSE 1 END) OVER (PARTITION BY saddr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS no FROM seen)
SELECT saddr, min(s) AS period_start_us, max(e) AS period_end_us FROM numbered GROUP BY saddr, no""")
def p1_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals.periods(_spans(spark, sf_dir), "saddr", "s", "e")
    return rows.select("saddr", F.col("period_start").alias("period_start_us"), F.col("period_end").alias("period_end_us"))


# --- 3: rolling totals


def _trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "argus").where("stime_us is not null and saddr is not null")
    return rolling.trailing_totals(records(stored, saddr=address("saddr"), day=day_number("stime_us"), sbytes=counter("sbytes")), "saddr", "day", "sbytes")


_P3 = f"""WITH daily AS (SELECT saddr, day, sum(coalesce(sbytes, 0)) AS b FROM
  {RECORDS.format(SADDR + ", cast(make_timestamp(stime_us) AS DATE) AS day, CASE WHEN sbytes <> -1 THEN sbytes END AS sbytes")}
  WHERE saddr IS NOT NULL AND day IS NOT NULL GROUP BY saddr, day),
span AS (SELECT saddr, min(day) AS f, max(day) AS l FROM daily GROUP BY saddr),
cal AS (SELECT saddr, f, cast(unnest(generate_series(f, l, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
tot AS (SELECT c.saddr, c.day, c.day - c.f AS day_no,
  cast(sum(coalesce(d.b, 0)) OVER (PARTITION BY c.saddr ORDER BY c.day ROWS 6 PRECEDING) AS BIGINT) AS total_7,
  cast(sum(coalesce(d.b, 0)) OVER (PARTITION BY c.saddr ORDER BY c.day ROWS 29 PRECEDING) AS BIGINT) AS total_30
  FROM cal c LEFT JOIN daily d ON d.saddr = c.saddr AND d.day = c.day)
"""


@core("p3_found", _P3 + "SELECT saddr, strftime(day, '%Y-%m-%d') AS utc_day FROM tot WHERE day_no >= 29 AND total_30 > 0 AND 10 * total_7 >= 7 * total_30")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _trailing(spark, sf_dir).where("day_no >= 29 and total_30 > 0 and 10 * total_7 >= 7 * total_30")
    return rows.select("saddr", F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd").alias("utc_day"))


@core("p3_totals", _P3 + "SELECT saddr, strftime(day, '%Y-%m-%d') AS utc_day, total_7, total_30, round(total_7 / 7, 3) AS avg_7, round(total_30 / 30, 3) AS avg_30 FROM tot")
def p3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd").alias("utc_day")
    return _trailing(spark, sf_dir).select("saddr", day, "total_7", "total_30", F.round("avg_7", 3).alias("avg_7"), F.round("avg_30", 3).alias("avg_30"))


# --- 4: sessions

_P4 = f"""WITH r AS (SELECT saddr, us, p, us - lag(us) OVER (PARTITION BY saddr ORDER BY us) AS d FROM
  {RECORDS.format(SADDR + ", stime_us AS us, CASE WHEN spkts <> -1 THEN spkts END AS p")} WHERE saddr IS NOT NULL AND us IS NOT NULL),
n AS (SELECT *, sum(CASE WHEN d <= 1800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY saddr ORDER BY us ROWS UNBOUNDED PRECEDING) AS no FROM r),
s AS (SELECT saddr, min(us) AS start_us, max(us) AS end_us, max(us) - min(us) AS duration_us, count(*) AS n, cast(sum(coalesce(p, 0)) AS BIGINT) AS spkts FROM n GROUP BY saddr, no)
"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "argus").where("stime_us is not null and saddr is not null")
    return sessions.sessions(records(stored, saddr=address("saddr"), us="stime_us", spkts=counter("spkts")), "saddr", "us", 1800, ("spkts",))


@core("p4_found", _P4 + "SELECT saddr, start_us, end_us FROM s WHERE n >= 3 AND spkts >= 100")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir).where("n >= 3 and spkts >= 100").select("saddr", "start_us", "end_us")


@core("p4_sessions", _P4 + "SELECT * FROM s")
def p4_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir)


# --- 6: a few keys holding most records


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each distinct end of a record, lead = 1 on one row of each record (a null end if it has none)."""
    rows = records(table(spark, sf_dir, "argus"), saddr=address("saddr"), daddr=address("daddr"), us="stime_us", sbytes=counter("sbytes"))
    ends = F.array_compact(F.array_distinct(F.array("saddr", "daddr")))
    rows = rows.select("sid", "seq", "us", "sbytes", F.posexplode_outer(ends).alias("no", "addr"))
    return rows.withColumn("lead", F.when(F.coalesce("no", F.lit(0)) == 0, 1).otherwise(0))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.partial_states(_ends(spark, sf_dir), "addr", "us", {"sbytes": "sbytes", "lead": "lead"}, ("seq", "sid"))


_P6 = f"""WITH r AS (SELECT * FROM {RECORDS.format(SADDR + ", " + DADDR + ", stime_us AS us, CASE WHEN sbytes <> -1 THEN sbytes END AS b")}),
e AS (SELECT saddr AS addr, us, b FROM r UNION ALL SELECT daddr, us, b FROM r WHERE daddr IS DISTINCT FROM saddr)
"""


@core("p6_found", _P6 + "SELECT addr FROM e WHERE addr IS NOT NULL GROUP BY addr HAVING count(*) * 1000 >= 25 * (SELECT count(*) FROM r)")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stitched states are written once and read twice: for the number of records and for the heavy addresses."""
    per_key = cut(skew.stitch(_states(spark, sf_dir), "addr", ("sbytes", "lead")))
    total = per_key.agg(F.coalesce(F.sum("lead"), F.lit(0))).first()[0]
    return per_key.where(F.col("addr").isNotNull() & (F.col("n") * 1000 >= 25 * F.lit(total))).select("addr")


@core("p6_per_address", _P6 + """, l AS (SELECT addr, us, b, us - lag(us) OVER (PARTITION BY addr ORDER BY us NULLS FIRST) AS d FROM e WHERE addr IS NOT NULL)
SELECT addr, count(*) AS n, min(us) AS first_us, max(us) AS last_us, CASE WHEN max(us) > min(us) THEN max(d) END AS longest_pause_us, cast(sum(coalesce(b, 0)) AS BIGINT) AS sbytes FROM l GROUP BY addr""")
def p6_per_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = skew.stitch(_states(spark, sf_dir), "addr", ("sbytes", "lead")).where("addr is not null")
    return rows.select("addr", "n", F.col("first").alias("first_us"), F.col("last").alias("last_us"), F.col("longest_step").alias("longest_pause_us"), "sbytes")
