"""Queries that run as streams over the stored table, with the SQL of their batch result; readers and writers round trip."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decoders, interop
from ..operators import bins, cluster
from ..session import shared_folder
from ..sources import formats, sinks
from ..sources.flows import clean, flows
from ..sources.tables import table
from ..streaming import flows as live
from .filterlang import where
from .reference import DAY_BIN, VIEW, sql
from .registry import core


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The stored table as a stream, whether it is one file or a directory of files."""
    at = f"{d}/argus.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    reader = spark.readStream.schema(table(spark, d, "argus").schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        return clean(reader.option("pathGlobFilter", "argus.parquet").parquet(d))
    return clean(reader.parquet(at))


#: Batches of the streams below, in order of arrival.
PARTS = 4


def _arriving(spark: SparkSession, d: str) -> DataFrame:
    return clean(live.staged(table(spark, d, "argus"), "autoid", PARTS))


_COUNTS = ", ".join(f"cast(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ("spkts", "dpkts", "sbytes", "dbytes"))
#: The batch of a record, the watermark by which it counts as late (of the batch before, so the newest start of the batches
#: before that, less the hold time), and the watermark after the last batch, by which results are closed.
_ARRIVAL = """z AS (SELECT min(autoid) AS lo, max(autoid) AS hi FROM f), h AS (SELECT f.*, least(3, floor((autoid - lo) / ((hi + 1 - lo) / 4.0)))::INT AS batch FROM f, z WHERE stime_us IS NOT NULL),
m AS (SELECT b, (SELECT max(stime_us) FROM h WHERE batch < b - 1) - {hold} AS mark FROM (SELECT unnest([0, 1, 2, 3]) AS b)), l AS (SELECT h.*, coalesce(mark, -(1::BIGINT << 60)) AS mark, (SELECT max(stime_us) FROM h) - {hold} AS final FROM h JOIN m ON b = batch)"""


@core("st2_bins", sql(f"SELECT bin_us, proto, count(*) AS n, {_COUNTS} FROM (SELECT *, {DAY_BIN.format(s=3600000000)} AS bin_us FROM l) WHERE bin_us + 3600000000 > mark AND bin_us + 3600000000 <= final GROUP BY 1, 2", _ARRIVAL.format(hold=21_600_000_000)))
def st2_bins(spark: SparkSession, d: str) -> DataFrame:
    """Bins that are closed when the stored input ends, in append mode: records later than the hold time are dropped."""
    return live.stored_result(live.time_bins(_arriving(spark, d), "1 hour", "6 hours", ["proto"]))


@core("st2_sliding", sql("SELECT bin_us, count(*) AS n FROM (SELECT *, (stime_us // 1800000000 - unnest([0, 1])) * 1800000000 AS bin_us FROM l) WHERE bin_us + 3600000000 > mark AND bin_us + 3600000000 <= final GROUP BY 1", _ARRIVAL.format(hold=86_400_000_000)))
def st2_sliding(spark: SparkSession, d: str) -> DataFrame:
    return live.stored_result(live.time_bins(_arriving(spark, d), "1 hour", "1 day", [], "30 minutes").select("bin_us", "n"))


@core("st4_late", sql("SELECT count(*) AS late, count(*) FILTER (bin_us + 3600000000 > final) AS open FROM (SELECT *, DAYBIN AS bin_us FROM l) WHERE bin_us + 3600000000 <= mark OR bin_us + 3600000000 > final".replace("DAYBIN", DAY_BIN.format(s=3600000000)), _ARRIVAL.format(hold=21_600_000_000)))
def st4_late(spark: SparkSession, d: str) -> DataFrame:
    """How many records the stream of st2_bins left out: those behind the watermark, and those of bins still open."""
    closed = live.stored_result(live.time_bins(_arriving(spark, d), "1 hour", "6 hours", []))
    stored = table(spark, d, "argus").where("stime_us is not null")
    newest = stored.agg(F.max("stime_us").alias("newest"))
    ends = stored.withColumn("one", F.lit(1)).join(F.broadcast(newest.withColumn("one", F.lit(1))), "one")  # one row
    rest = ends.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(bins.bin_start(F.col("stime_us"), "1h") + 3_600_000_000 > F.col("newest") - 21_600_000_000, 1).otherwise(0)).alias("open"))
    kept = closed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept"))
    return rest.withColumn("one", F.lit(1)).join(F.broadcast(kept.withColumn("one", F.lit(1))), "one").select((F.col("n") - F.col("kept")).alias("late"), "open")


@core(
    "st5_sessions",
    sql(
        "SELECT saddr, min(stime_us) AS start_us, max(stime_us) AS end_us, max(stime_us) - min(stime_us) AS duration_us, count(*) AS n FROM n GROUP BY saddr, no HAVING max(stime_us) + 1800000000 <= max(final)",
        _ARRIVAL.format(hold=2_592_000_000_000),
        "n AS (SELECT *, sum(CASE WHEN d <= 1800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY saddr ORDER BY stime_us, autoid ROWS UNBOUNDED PRECEDING) AS no FROM (SELECT *, stime_us - lag(stime_us) OVER (PARTITION BY saddr ORDER BY stime_us, autoid) AS d FROM l WHERE saddr IS NOT NULL AND stime_us + 1800000000 > mark))",
    ),
)
def st5_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that the watermark has passed when the stored input ends, in append mode; late events within it join in."""
    return live.stored_result(live.stream_sessions(_arriving(spark, d), "saddr", "stime", 1800, "30 days"))


@core("st8_filter", sql("SELECT autoid, saddr, daddr FROM f WHERE proto = 6 AND status & 1 = 1 AND dport = 443"))
def st8_filter(spark: SparkSession, d: str) -> DataFrame:
    return live.stored_result(where(_stream(spark, d), "syn and tcp dst port 443").select("autoid", "saddr", "daddr"))


@core("st6_top", "WITH " + VIEW + " SELECT saddr, cast(sum(coalesce(sbytes, 0) + coalesce(dbytes, 0)) AS BIGINT) AS bytes, count(*) AS n FROM f WHERE stime_us IS NOT NULL GROUP BY saddr ORDER BY bytes DESC, saddr NULLS LAST LIMIT 10")
def st6_top(spark: SparkSession, d: str) -> DataFrame:
    """The list after the last batch; the window is the decade, so keys that later batches do not touch have to stay."""
    at = f"{shared_folder(spark)}/top-{uuid.uuid4().hex}"
    seen = []
    live.run_available(live.top_k(_arriving(spark, d), "saddr", 10, "3650 days", lambda rows, no: seen.append(no), f"{at}/lists").option("checkpointLocation", f"{at}/log"))
    return spark.read.parquet(f"{at}/lists/list={max(seen)}").select("saddr", "bytes", "n")


_REPORTS = """r AS (SELECT saddr, stime_us AS s, greatest(coalesce(ltime_us, stime_us), stime_us) AS e, coalesce(sbytes, 0) + coalesce(dbytes, 0) AS b, row_number() OVER (PARTITION BY saddr ORDER BY stime_us, greatest(coalesce(ltime_us, stime_us), stime_us), coalesce(sbytes, 0) + coalesce(dbytes, 0)) AS k FROM f WHERE saddr IS NOT NULL AND stime_us IS NOT NULL),
w AS (SELECT saddr, k, s AS s0, e AS e0, 0 AS no FROM r WHERE k = 1 UNION ALL SELECT r.saddr, r.k, CASE WHEN e0 - s0 >= 300000000 OR r.s - e0 >= 3600000000 THEN r.s ELSE least(s0, r.s) END, CASE WHEN e0 - s0 >= 300000000 OR r.s - e0 >= 3600000000 THEN r.e ELSE greatest(e0, r.e) END,
  no + CASE WHEN e0 - s0 >= 300000000 OR r.s - e0 >= 3600000000 THEN 1 ELSE 0 END FROM w JOIN r ON r.saddr = w.saddr AND r.k = w.k + 1),
g AS (SELECT saddr, no, min(s) AS stime_us, max(e) AS ltime_us, count(*) AS n, sum(b)::BIGINT AS bytes FROM r JOIN w USING (saddr, k) GROUP BY ALL)"""


@core("st5_status", f"""WITH RECURSIVE {VIEW},
{_REPORTS}
SELECT saddr, stime_us, ltime_us, n, bytes, CASE WHEN no < max(no) OVER (PARTITION BY saddr) THEN CASE WHEN ltime_us - stime_us >= 300000000 THEN 'status' ELSE 'idle' END
  WHEN (ltime_us + 3600000000) // 1000 < (SELECT max(s) FROM r) // 1000 - 3600000 THEN 'idle' ELSE 'open' END AS reason FROM g""")
def st5_status(spark: SparkSession, d: str) -> DataFrame:
    return live.stored_result(live.status_reports(_stream(spark, d), ["saddr"], 300, 3600), still_open=live.open_reports)


@core("s2_range", sql("SELECT autoid, saddr FROM f WHERE autoid >= 100 AND autoid < 5000"))
def s2_range(spark: SparkSession, d: str) -> DataFrame:
    return formats.scan_range(flows(spark, d), 100, 5000).select("autoid", "saddr")


@core("k5_upsert", sql("SELECT saddr, cast(sum(trans) AS BIGINT) AS trans, min(stime_us) AS stime_us, max(ltime_us) AS ltime_us FROM f GROUP BY saddr"))
def k5_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Two halves of the table inserted one after the other into a keyed table."""
    f = flows(spark, d)
    halves = [f.where(F.pmod("seq", F.lit(2)) == i).groupBy("saddr").agg(F.sum("trans").alias("trans"), F.min("stime_us").alias("stime_us"), F.max("ltime_us").alias("ltime_us")) for i in (0, 1)]
    return sinks.upsert(halves[0], halves[1], ["saddr"], {"trans": F.sum, "stime_us": F.min, "ltime_us": F.max})


@core("u3_decode")
def u3_decode(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d).where("suser is not null").select("autoid", decoders.decode("suser").alias("decoded"))


@core("x3_strftime", sql("SELECT autoid, strftime(make_timestamp(stime_us), '%Y/%m/%d %H:%M:%S.%f') AS text FROM f WHERE stime_us IS NOT NULL"))
def x3_strftime(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d).where("stime_us is not null").select("autoid", interop.strftime("stime_us", "%Y/%m/%d %H:%M:%S.%f").alias("text"))


@core("x8_places", sql(
    "SELECT country, asn, count(*) AS n FROM f LEFT JOIN b USING (daddr_i) GROUP BY country, asn", "c AS (SELECT lo, hi, masklen, arg_min({'country': country, 'asn': asn}, {'c': coalesce(country, ''), 'a': coalesce(asn, -1)}) AS v FROM cidr_label WHERE country IS NOT NULL OR asn IS NOT NULL GROUP BY ALL)",
    "b AS (SELECT daddr_i, arg_max(v, masklen).country AS country, arg_max(v, masklen).asn AS asn FROM (SELECT DISTINCT daddr_i FROM f WHERE daddr_i IS NOT NULL) JOIN c ON daddr_i BETWEEN lo AND hi GROUP BY daddr_i)"))
def x8_places(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import lookups

    places = table(spark, d, "cidr_label").where("country is not null or asn is not null")
    return lookups.longest_prefix(flows(spark, d), "daddr_i", places, {"country": "country", "asn": "asn"}).groupBy("country", "asn").agg(F.count(F.lit(1)).alias("n"))


@core("a28_reaggregate", sql("SELECT saddr, cast(sum(trans) AS BIGINT) AS trans FROM f GROUP BY saddr"))
def a28_reaggregate(spark: SparkSession, d: str) -> DataFrame:
    """An aggregate of aggregates over coarser keys equals the aggregate of the records."""
    return cluster.cluster(cluster.cluster(flows(spark, d), "saddr daddr proto").withColumns({"saddr_i": F.lit(None).cast("bigint")}), "saddr").select("saddr", "trans")
