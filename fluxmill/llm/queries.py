"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import split_points
from ..plans.registry import DADDR, DAY, RECORDS, SADDR, Registry
from ..session import cut
from ..sources.tables import address, counter, day_number, records, table
from . import membership, mixture, packing, percentiles, tokens, toxicity, votes

llm = Registry()

# --- 2: percentiles

GROUPS = ["utc_day", "proto", "metric"]


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    dur = F.when(F.col("dur") >= 0, F.round(F.col("dur") * 1e6).cast("bigint"))
    return table(spark, sf_dir, "argus").where("stime_us is not null").withColumns({"dur": dur, "sbytes": counter("sbytes"), "dbytes": counter("dbytes")})


def _each(rows: DataFrame, *keep: str) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.when(F.col(m) >= 0, F.col(m)).alias("value")) for m in ("dur", "sbytes", "dbytes")))
    return rows.select(*keep, F.explode(pairs).alias("x")).select(*keep, "x.metric", "x.value")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(_measured(spark, sf_dir), day=day_number("stime_us"), proto=F.col("proto").cast("int"), dur="dur", sbytes="sbytes", dbytes="dbytes")
    return _each(rows, "day", "proto")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.value_counts(_metrics(spark, sf_dir), ["day", "proto", "metric"], "value")


def _cuts(spark: SparkSession, sf_dir: str) -> list[float]:
    """Bounds for the range sort, sampled from the stored rows; copies of records do not matter here."""
    return split_points(_each(_measured(spark, sf_dir)), "value")


def _text_day(df: DataFrame) -> DataFrame:
    return df.withColumn("utc_day", F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd")).drop("day")


_P2 = f"""WITH r AS {RECORDS.format(DAY + " AS utc_day, cast(proto AS INT) AS proto, cast(round(dur * 1e6) AS BIGINT) AS dur, sbytes, dbytes")},
v AS (SELECT utc_day, proto, unnest(['dur', 'sbytes', 'dbytes']) AS metric, unnest([dur, sbytes, dbytes]) AS value FROM r WHERE utc_day IS NOT NULL),
"""
_RANKED = """k AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY {g}) AS n FROM v WHERE value >= 0 WINDOW w AS (PARTITION BY {g} ORDER BY value)),
p AS (SELECT {g}, q, min(value) AS value, any_value(n) AS n FROM k, (SELECT unnest([50.0, 90.0, 95.0, 99.0]) AS q) WHERE 100 * k >= q * n GROUP BY {g}, q)
"""


@llm("p2_found", _P2 + _RANKED.format(g="utc_day, proto, metric") + """SELECT DISTINCT utc_day, proto, metric FROM p WHERE n >= 30 AND
  ((metric = 'dur' AND q = 50 AND value >= 10000000) OR (metric = 'sbytes' AND q = 90 AND value >= 200000) OR (metric = 'dbytes' AND q = 95 AND value >= 2000000))""")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = percentiles.percentiles(_daily(spark, sf_dir), ["day", "proto", "metric"], (50, 90, 95), _cuts(spark, sf_dir))
    case = "(metric = 'dur' and q = 50 and value >= 10000000) or (metric = 'sbytes' and q = 90 and value >= 200000) or (metric = 'dbytes' and q = 95 and value >= 2000000)"
    return _text_day(rows.where("n >= 30").where(case)).select(*GROUPS)


@llm("p2_percentiles", _P2 + _RANKED.format(g="utc_day, proto, metric") + "SELECT utc_day, proto, metric, cast(q AS DOUBLE) AS q, value, n FROM p")
def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations are in microseconds."""
    return _text_day(percentiles.percentiles(_daily(spark, sf_dir), ["day", "proto", "metric"], (50, 90, 95, 99), _cuts(spark, sf_dir))).select(*GROUPS, "q", "value", "n")


@llm("p2_combined", _P2 + _RANKED.format(g="proto, metric") + "SELECT proto, metric, cast(q AS DOUBLE) AS q, value, n FROM p")
def p2_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles over all days, from the partial results of the single days."""
    return percentiles.percentiles(percentiles.merged(_daily(spark, sf_dir), ["proto", "metric"]), ["proto", "metric"], (50, 90, 95, 99), _cuts(spark, sf_dir))


@llm("p2_rounded", _P2 + """s AS (SELECT proto, metric, value, greatest(0, cast(floor(log2(greatest(value, 1))) AS INT) - 7) AS d FROM v WHERE value >= 0),
c AS (SELECT proto, metric, (value >> d) << d AS value, count(*) AS n FROM s GROUP BY ALL)
SELECT proto, metric, value, n FROM c""")
def p2_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compact partial result: counts of values rounded down by less than a 128th."""
    return percentiles.value_counts(_metrics(spark, sf_dir), ["proto", "metric"], "value", keep_bits=7)


# --- 5: distinct counts


def _pair_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "argus").where("stime_us is not null and saddr is not null and daddr is not null")
    rows = stored.select(address("saddr").alias("saddr"), address("daddr").alias("daddr"), day_number("stime_us").alias("day"))
    pairs = membership.members(membership.bitmaps(rows, ["saddr"], "daddr", "day"), ["saddr"])
    sides = F.array(F.struct(F.lit("saddr").alias("grp"), F.col("saddr").alias("addr")), F.struct(F.lit("daddr").alias("grp"), F.col("ident").alias("addr")))
    rows = pairs.select("pattern", F.explode(sides).alias("x")).select("x.grp", "x.addr", "pattern")
    return membership.patterns(rows, ["grp", "addr"])


_P5 = f"""WITH r AS (SELECT {SADDR}, {DADDR}, {DAY} AS utc_day FROM argus WHERE stime_us IS NOT NULL AND saddr IS NOT NULL AND daddr IS NOT NULL),
e AS (SELECT 'saddr' AS grp, saddr AS addr, daddr AS other, utc_day FROM r UNION ALL SELECT 'daddr', daddr, saddr, utc_day FROM r)
"""


@llm("p5_found", _P5 + "SELECT utc_day, grp, addr FROM e GROUP BY ALL HAVING count(DISTINCT other) >= 64")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known error is 0. Copies of a record add nothing to a set, so they need not be removed first."""
    rows = membership.per_group(_pair_patterns(spark, sf_dir), ["grp", "addr"]).where("n >= 64")
    return _text_day(rows.withColumnRenamed("group_no", "day")).select("utc_day", "grp", "addr")


@llm("p5_combinations", _P5 + """, w AS (SELECT *, strftime(cast(utc_day AS DATE), '%w') IN ('0', '6') AS rest FROM e),
o AS (SELECT grp, addr, other, bool_or(rest) AS r, bool_or(NOT rest) AS d FROM w GROUP BY ALL)
SELECT grp, addr, count(*) AS n_any_day, count(*) FILTER (r) AS n_weekend, count(*) FILTER (r AND d) AS n_both, count(*) FILTER (r AND NOT d) AS n_weekend_only FROM o GROUP BY ALL""")
def p5_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partners over combinations of days: a union, an intersection and a difference of weekends and working days."""
    rest = lambda d: F.pmod(d + 4, F.lit(7)).isin(0, 6)  # noqa: E731  day 0 was a Thursday
    weekend, working = F.exists("groups", rest), F.exists("groups", lambda d: ~rest(d))
    asked = {"n_any_day": F.lit(True), "n_weekend": weekend, "n_both": weekend & working, "n_weekend_only": weekend & ~working}
    return membership.answers(_pair_patterns(spark, sf_dir), ["grp", "addr"], asked)


@llm("p5_merged", _P5 + "SELECT utc_day, addr, count(DISTINCT other) AS n FROM e WHERE grp = 'saddr' GROUP BY ALL")
def p5_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial results of two halves of the table, merged: the same counts as from the whole."""
    stored = table(spark, sf_dir, "argus").where("stime_us is not null and saddr is not null and daddr is not null")
    halves = [stored.where(f"autoid % 2 = {i}").select(address("saddr").alias("saddr"), address("daddr").alias("daddr"), day_number("stime_us").alias("day")) for i in (0, 1)]
    maps = membership.merge(*(membership.bitmaps(h, ["saddr"], "daddr", "day") for h in halves))
    rows = membership.per_group(membership.patterns(membership.members(maps, ["saddr"]), ["saddr"]), ["saddr"])
    return _text_day(rows.withColumnRenamed("group_no", "day")).select("utc_day", F.col("saddr").alias("addr"), "n")


#: Addresses that a question may combine; patterns grow with their number times the days.
ASKED = 6


@llm("p5_across", _P5 + f""", b AS (SELECT addr AS host FROM e WHERE grp = 'saddr' GROUP BY addr ORDER BY count(DISTINCT other) DESC, addr LIMIT {ASKED}),
w AS (SELECT addr AS host, other, strftime(cast(utc_day AS DATE), '%w') IN ('0', '6') AS rest FROM e WHERE grp = 'saddr' AND addr IN (SELECT host FROM b)),
i AS (SELECT other, count(DISTINCT host) AS hosts, count(DISTINCT CASE WHEN rest THEN host END) AS resting FROM w GROUP BY other)
SELECT 'any' AS question, NULL AS host, count(*) AS n FROM i UNION ALL SELECT 'any at a weekend', NULL, count(*) FROM i WHERE resting > 0 UNION ALL SELECT 'all', NULL, count(*) FROM i WHERE hosts = (SELECT count(*) FROM b)
UNION ALL SELECT 'only', host, count(DISTINCT other) FROM w JOIN i USING (other) WHERE hosts = 1 GROUP BY host UNION ALL SELECT 'shared at a weekend', host, count(DISTINCT other) FROM w JOIN i USING (other) WHERE rest AND resting > 1 GROUP BY host""")
def p5_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct daddr over sets of saddr and days: patterns of (saddr, day) groups for the saddr with the most partners.

    Totals of single addresses would not add up; a daddr's pattern over all asked addresses and days answers any
    combination of them.
    """
    totals = _pair_patterns(spark, sf_dir).where("grp = 'saddr'")
    hosts = [r[0] for r in totals.groupBy("addr").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "addr").limit(ASKED).collect()]
    stored = table(spark, sf_dir, "argus").where("stime_us is not null and daddr is not null")
    rows = stored.select(address("saddr").alias("saddr"), address("daddr").alias("daddr"), day_number("stime_us").alias("day")).where(F.col("saddr").isin(hosts))
    number = F.array_position(F.array(*map(F.lit, hosts)), F.col("saddr")) - 1
    rows = rows.withColumn("no", F.col("day") * ASKED + number)
    totals = membership.patterns(membership.members(membership.bitmaps(rows, [], "daddr", "no"), []), [])
    host, rest = (lambda g: F.pmod(g, F.lit(ASKED))), (lambda g: F.pmod(F.floor(g / ASKED) + 4, F.lit(7)).isin(0, 6))
    of = lambda i, at=None: F.exists("groups", lambda g: (host(g) == i) if at is None else (host(g) == i) & rest(g))
    some = lambda tests: F.array_contains(F.array(*tests), True)
    everyone = range(len(hosts))
    asked = {"any": some([of(i) for i in everyone]), "any at a weekend": some([of(i, 1) for i in everyone]), "all": ~F.array_contains(F.array(*(of(i) for i in everyone)), False)}
    asked |= {f"only\t{hosts[i]}": of(i) & ~some([of(k) for k in everyone if k != i] or [F.lit(False)]) for i in everyone}
    asked |= {f"shared at a weekend\t{hosts[i]}": of(i, 1) & some([of(k, 1) for k in everyone if k != i] or [F.lit(False)]) for i in everyone}
    names = {f"q{i}": q for i, q in enumerate(asked)}
    one = membership.answers(totals, [], {k: asked[q] for k, q in names.items()})
    said = F.array(*(F.struct(F.lit(q.split("\t")[0]).alias("question"), F.lit((q.split("\t") + [None])[1]).cast("string").alias("host"), F.col(k).alias("n")) for k, q in names.items()))
    return one.select(F.explode(said).alias("x")).select("x.*").where("n > 0 or host is null")


# --- 7: most frequent values

FIELDS = ["saddr", "daddr", "dport"]
_P7 = f"""WITH r AS {RECORDS.format(SADDR + ", " + DADDR + ", dport")},
v AS (SELECT unnest(['saddr', 'daddr', 'dport']) AS fld, unnest([saddr, daddr, cast(dport AS VARCHAR)]) AS item FROM r),
c AS (SELECT fld, item, count(*) AS "count", sum(count(*)) OVER (PARTITION BY fld) AS n FROM v WHERE item IS NOT NULL GROUP BY fld, item)
"""


def _frequent(spark: SparkSession, sf_dir: str, ppm: int = 10_000) -> DataFrame:
    rows = records(table(spark, sf_dir, "argus"), saddr=address("saddr"), daddr=address("daddr"), dport="dport")
    names = F.element_at(F.array(*map(F.lit, FIELDS)), F.col("fld") + 1)
    return votes.frequent(rows, FIELDS, ppm).withColumn("fld", names)


@llm("p7_found", _P7 + "SELECT fld, item FROM c WHERE \"count\" * 100 >= n")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequent(spark, sf_dir).select("fld", "item")


@llm("p7_counts", _P7 + "SELECT fld, item, \"count\", cast(n AS BIGINT) AS n FROM c WHERE \"count\" * 100 >= n")
def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequent(spark, sf_dir).select("fld", "item", "count", "n")


@llm("p7_rarer", _P7 + "SELECT fld, item, \"count\", true AS bounded FROM c WHERE \"count\" * 2000 >= n")
def p7_rarer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of at least one in two thousand, and whether the sketch's bounds, where it named them, hold."""
    rows = _frequent(spark, sf_dir, 500)
    return rows.select("fld", "item", "count", F.coalesce(F.col("count").between(F.col("lower"), F.col("upper")), F.lit(True)).alias("bounded"))


@llm("p7_bounds")
def p7_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch alone: every candidate with lower and upper bound of its count."""
    rows = records(table(spark, sf_dir, "argus"), saddr=address("saddr"), daddr=address("daddr"), dport="dport")
    return votes.bounds(votes.merge(votes.sketch(rows, FIELDS))).where("item is not null")


@llm("p7_bounds_hold", _P7 + "SELECT fld, item, \"count\", true AS holds FROM c WHERE \"count\" * 100 >= n")
def p7_bounds_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch's bounds against the counts of all values, for those of at least a hundredth."""
    rows = records(table(spark, sf_dir, "argus"), saddr=address("saddr"), daddr=address("daddr"), dport="dport")
    each = F.array(*(F.struct(F.lit(i).alias("fld"), F.col(c).cast("string").alias("item")) for i, c in enumerate(FIELDS)))
    counts = rows.select(F.explode(each).alias("x")).select("x.*").where("item is not null").groupBy("fld", "item").agg(F.count(F.lit(1)).alias("count"))
    found = votes.bounds(votes.merge(votes.sketch(rows, FIELDS))).join(counts, ["fld", "item"]).where("count * 100 >= n")
    return found.select(F.element_at(F.array(*map(F.lit, FIELDS)), F.col("fld") + 1).alias("fld"), "item", "count", F.col("count").between(F.col("lower"), F.col("upper")).alias("holds"))


# --- 8: filling containers


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tokens.count_tokens("text").alias("tokens"))
    return packing.pack(cut(docs), "doc_id", "tokens")


def _packed_by_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("chars")), "doc_id", "chars", CHARS)


@llm("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that packing had to put into more than one container."""
    return packing.in_several(_packed(spark, sf_dir), "doc_id")


@llm("p8_containers")
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


@llm("p8_fill")
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(_packed(spark, sf_dir), "tokens")


#: Capacity of the containers that are packed by characters, for comparison with SQL.
CHARS = 25_000


@llm("p8_pieces_by_chars", f"SELECT doc_id, greatest(1, ceil(n_chars / {CHARS})::BIGINT) AS pieces, coalesce(n_chars, 0) AS chars, least(coalesce(n_chars, 0), {CHARS}) AS largest, n_chars > {CHARS} AS several FROM documents")
def p8_pieces_by_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What packing made of every document, with characters for tokens: only what exceeds a container is split."""
    rows = _packed_by_chars(spark, sf_dir).groupBy("doc_id")
    return rows.agg(F.count(F.lit(1)).alias("pieces"), F.sum("chars").alias("chars"), F.max("chars").alias("largest"), (F.count_distinct("container") > 1).alias("several"))


@llm("p8_room_by_chars", "SELECT sum(n_chars)::BIGINT AS chars, 0::BIGINT AS overfull, true AS tight FROM documents")
def p8_room_by_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All characters are packed, no container holds too many, and the containers are at most a twentieth (and two) more than the least possible number."""
    per = _packed_by_chars(spark, sf_dir).groupBy("container").agg(F.sum("chars").alias("size"))
    least = F.sum("size") / CHARS
    return per.agg(F.sum("size").alias("chars"), F.sum(F.when(F.col("size") > CHARS, 1).otherwise(0)).alias("overfull"), (F.count(F.when(F.col("size") > 0, 1)) <= least * 1.05 + 2).alias("tight"))


# --- 9: mixing sources

#: The main line fades while the small and the student repositories come in; the others keep their share throughout.
TILTS = {"forge_main": -0.5, "student_labs": 0.5, "embedded_vendor": 0.5}


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_target")
    docs = table(spark, sf_dir, "documents").select("doc_id", mixture.source_name("source").alias("source"), "text")
    named = targets.select(mixture.source_name("source").alias("source")).where("source is not null").distinct()
    sized = docs.join(named, "source", "left_semi").select("doc_id", "source", tokens.count_tokens("text").alias("tokens"))
    return mixture.mix(cut(sized), targets, TILTS)


def _mixed_by_chars(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixture.mix(table(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").alias("tokens")), table(spark, sf_dir, "mix_target"), TILTS)


@llm("p9_found", """WITH d AS (SELECT lower(trim(source)) AS source, sum(n_chars) AS size FROM documents WHERE source IS NOT NULL GROUP BY 1),
m AS (SELECT lower(trim(m.source)) AS source, target_share, max_repeats, coalesce(size, 0) AS size FROM mix_target m LEFT JOIN d ON d.source = lower(trim(m.source)))
SELECT source FROM m WHERE target_share * (SELECT sum(size) FROM m) > max_repeats * size""")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets whose last use, in all their allowed repeats, ends before the course does."""
    return _mixed(spark, sf_dir)[1].where("ends_at < 1").select("source")


@llm("p9_report")
def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


@llm("p9_order")
def p9_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


_TILT = "CASE source " + " ".join(f"WHEN '{s}' THEN {x}::DOUBLE" for s, x in TILTS.items()) + " ELSE 0::DOUBLE END"
_POSITION = "coalesce(2 * {x} / nullif((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * {x}), 0), 0)"
_P9 = f"""WITH g AS (SELECT lower(trim(source)) AS source, max(coalesce(target_share, 0)) AS target_share, max(coalesce(max_repeats, 0)) AS max_repeats FROM mix_target WHERE source IS NOT NULL GROUP BY 1),
k AS (SELECT doc_id, lower(trim(source)) AS source, n_chars AS n, md5(doc_id::VARCHAR) AS key FROM documents WHERE n_chars > 0 AND lower(trim(source)) IN (SELECT source FROM g)),
z AS (SELECT source, count(*) AS docs, sum(n)::BIGINT AS size FROM k GROUP BY source),
q AS (SELECT *, least(demand, (max_repeats * size)::DOUBLE) AS supply FROM (SELECT g.*, coalesce(docs, 0) AS docs, coalesce(size, 0) AS size, target_share * (SELECT sum(size) FROM z)::DOUBLE AS demand FROM g LEFT JOIN z USING (source))),
w AS (SELECT *, (sum(n) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS before FROM k),
u AS (SELECT *, repeat * size + before AS done FROM (SELECT doc_id, source, n, before, size, demand, supply, {_TILT} AS tilt, unnest(generate_series(0, ceil(supply / size)::BIGINT - 1)) AS repeat FROM w JOIN q USING (source) WHERE supply > 0)),
o AS (SELECT doc_id, source, repeat, n AS tokens, {_POSITION.format(x="(done / demand)")} AS position, {_POSITION.format(x="least(1, (done + n) / demand)")} AS until FROM u WHERE done < supply)
"""


@llm("p9_order_by_chars", _P9 + "SELECT doc_id, source, repeat, tokens, round(position, 9) AS position, round(until, 9) AS until FROM o")
def p9_order_by_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order with characters for tokens, which SQL can count."""
    rows = _mixed_by_chars(spark, sf_dir)[0]
    return rows.withColumns({"position": F.round("position", 9), "until": F.round("until", 9)})


@llm("p9_report_by_chars", _P9 + """, r AS (SELECT source, sum(tokens)::BIGINT AS tokens, max(repeat) + 1 AS most_repeats, max(until) AS until FROM o GROUP BY source)
SELECT source, target_share, max_repeats, docs, size, round(demand, 6) AS demand, round(supply, 6) AS supply, coalesce(tokens, 0) AS tokens, coalesce(most_repeats, 0) AS most_repeats, round(coalesce(tokens, 0) / sum(tokens) OVER (), 9) AS actual_share,
  round(greatest(0, coalesce(tokens, 0) - demand), 6) AS overshoot, round(CASE WHEN demand <= 0 THEN 1 ELSE coalesce(until, 0) END, 9) AS ends_at FROM q LEFT JOIN r USING (source)""")
def p9_report_by_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _mixed_by_chars(spark, sf_dir)[1]
    return rows.withColumns({**{c: F.round(c, 6) for c in ("demand", "supply", "overshoot")}, **{c: F.round(c, 9) for c in ("actual_share", "ends_at")}})


# --- 10: abusive, hateful or sexual content


#: Models of this session by folder and content of the labels, so that several queries over a table train once.
MODELS: dict[tuple, toxicity.Model] = {}
llm.caches.append(MODELS)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_label")
    content = labels.agg(F.count(F.lit(1)), F.sum(F.xxhash64("doc_id", "toxic", "confidence").cast("decimal(20,0)"))).first()
    key = (spark.sparkContext.applicationId, sf_dir, *content)
    if key not in MODELS:
        MODELS[key] = toxicity.fit(docs, labels)
    model = MODELS[key]
    return docs.select("doc_id", "source", toxicity.score("text", model).alias("score"))


@llm("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where(F.col("score") >= toxicity.THRESHOLD).select("doc_id")


@llm("p10_scores")
def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "score")


@llm("p10_rates")
def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rates(_scored(spark, sf_dir), "source", "score")
