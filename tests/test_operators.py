"""Worked examples, invariants and edge cases of the flow operators."""

from datetime import UTC, datetime

import pytest
from fluxmill.functions import addresses, fields, timerange
from fluxmill.operators import anonymize, bins, cluster, histogram, inventory, labels, lookups, policy
from fluxmill.sources.flows import reverse
from pyspark.sql import functions as F

S = 1_000_000


def test_merging_status_records(make_flows):
    t0 = int(datetime(2013, 9, 1, 12, 23, 7, 268000, UTC).timestamp() * S)
    pkts, starts = (298, 111, 637, 89, 3), (0, 5, 10, 15, 24.915)
    rows = [{"saddr": "10.0.0.1", "daddr": "10.0.0.2", "proto": 6, "sport": 1, "dport": 2, "spkts": p, "dpkts": 0, "stime_us": int(t0 + s * S), "ltime_us": int(t0 + s * S + 10_000), "status": 4 if p > 3 else 8} for p, s in zip(pkts, starts)]
    r = cluster.cluster(make_flows(rows)).withColumn("state", F.expr(fields.state_sql())).collect()
    assert len(r) == 1
    assert (r[0]["trans"], r[0]["spkts"], r[0]["dur"], r[0]["state"]) == (5, 1138, 24.925, "FIN")


def flow(s, d, sp, dp, t, status=0, proto=6, **kw):
    return {"saddr": s, "daddr": d, "sport": sp, "dport": dp, "proto": proto, "stime_us": t, "ltime_us": t + 1, "status": status, "spkts": 1, "dpkts": 2, **kw}


@pytest.mark.parametrize(
    "rows, want",
    [
        ([flow("a", "b", 9, 80, 5), flow("b", "a", 80, 9, 3, 1)], [("b", "a", 2, 3, 3)]),  # the SYN decides
        ([flow("a", "b", 9, 80, 5, 1), flow("b", "a", 80, 9, 3, 1)], [("a", "b", 1, 1, 2), ("b", "a", 1, 1, 2)]),  # two SYNs: two conversations
        ([flow("a", "b", 9, 80, 5), flow("b", "a", 80, 9, 3)], [("b", "a", 2, 3, 3)]),  # the earlier start decides
        ([flow("a", "b", None, None, 5, proto=50), flow("b", "a", None, None, 3, proto=50)], [("a", "b", 1, 1, 2), ("b", "a", 1, 1, 2)]),  # never for ESP
        ([flow(None, "b", 1, 2, 5), flow("a", None, 1, 2, 5)], [("a", None, 1, 1, 2), (None, "b", 1, 1, 2)]),
    ],
)
def test_direction(make_flows, rows, want):
    got = cluster.cluster(make_flows(rows)).collect()
    assert sorted(((r["saddr"], r["daddr"], r["trans"], r["spkts"], r["dpkts"]) for r in got), key=str) == sorted(want, key=str)


def test_reverse_twice_is_nothing(make_flows):
    df = make_flows([flow("10.0.0.1", "10.0.0.2", 1, 2, 3, sttl=4, sbytes=7)])
    assert reverse(reverse(df)).collect() == df.collect()
    assert reverse(df).first()["dbytes"] == 7


def test_split_preserves_sums(make_flows):
    rows = [
        {"stime_us": 55 * S, "ltime_us": 195 * S, "spkts": 7, "dpkts": 2, "sbytes": 1001, "dbytes": 50, "sloss": 1},
        {"stime_us": 0, "ltime_us": 600 * S, "spkts": 2, "dpkts": None, "sbytes": 999, "dbytes": 5},
        {"stime_us": 59 * S, "ltime_us": 60 * S, "spkts": 1, "sbytes": 64},
        {"stime_us": 59 * S, "ltime_us": 61 * S, "spkts": 0, "sbytes": 0},
        {"stime_us": 10 * S, "ltime_us": None, "spkts": 3, "sbytes": 9},
        {"stime_us": 10 * S, "ltime_us": 5 * S, "spkts": 3, "sbytes": 9},
        {"stime_us": None, "spkts": 3},
    ]
    parts = bins.split(make_flows(rows), "1m")
    got = {r["autoid"]: tuple(r)[1:] for r in parts.groupBy("autoid").agg(F.sum("spkts"), F.sum("dpkts"), F.sum("sbytes"), F.sum("dbytes"), F.count(F.lit(1))).collect()}
    assert got[0][:4] == (7, 2, 1001, 50) and got[0][4] == 3  # the first five seconds hold no whole packet
    assert got[1][:4] == (2, None, 999, 5) and got[1][4] == 2
    assert got[2][4] == 1 and got[3] == (0, None, 0, None, 1) and got[4][0] == 3 and got[5][4] == 1 and 6 not in got
    assert parts.where("spkts + dpkts = 0 and autoid = 0").count() == 0
    edges = parts.where("autoid = 0").orderBy("bin_us").select("stime_us", "ltime_us").collect()
    assert [tuple(e) for e in edges] == [(60 * S, 120 * S), (120 * S, 180 * S), (180 * S, 195 * S)]


def test_hard_bins_stand_on_edges(make_flows):
    got = bins.time_bins(make_flows([{"stime_us": 55 * S, "ltime_us": 95 * S, "spkts": 40, "proto": 6}]), "10s", ["proto"], "hard").collect()
    assert len(got) == 5 and all(r["stime_us"] == r["bin_us"] and r["stime_us"] % (10 * S) == 0 and r["dur"] == 10.0 for r in got)


def test_percent_columns(make_flows):
    rows = cluster.percent(cluster.cluster(make_flows([{"proto": 6, "spkts": 3}, {"proto": 6}, {"proto": 17, "spkts": 1}, {"proto": 1, "spkts": 4}]), "proto"), ["trans", "spkts"])
    assert {r["proto"]: (r["pct_trans"], r["pct_spkts"]) for r in rows.collect()} == {6: (50.0, 37.5), 17: (25.0, 12.5), 1: (25.0, 50.0)}


def test_status_timer(make_flows):
    rows = [{"saddr": "a", "daddr": "b", "proto": 6, "stime_us": t * S, "ltime_us": (t + 30) * S} for t in (0, 40, 80, 120, 400, 410)] + [{"saddr": None, "daddr": "b", "stime_us": 5}]
    got = cluster.status_split(make_flows(rows), ["saddr", "daddr", "proto"], 100, 120).orderBy("saddr", "stime_us").collect()
    # the first report spans 110 s with its third record, so the fourth opens the next one; the pause ends that
    assert [(r["saddr"], r["trans"], r["stime_us"] // S) for r in got] == [(None, 1, 0), ("a", 3, 0), ("a", 1, 120), ("a", 2, 400)]


def test_idle_timer_across_slices(make_flows):
    rows = [{"saddr": "a", "stime_us": t * S, "ltime_us": e and e * S} for t, e in ((0, 8000), (100, 120), (7000, 7001), (8059, 8060), (8120, 8121), (8122, None))]
    got = cluster.idle_split(make_flows(rows), ["saddr"], 60).orderBy("stime_us").collect()
    assert [(r["stime_us"] // S, r["trans"]) for r in got] == [(0, 4), (8120, 2)]


@pytest.mark.parametrize("low, high, n, want", [(0, 81.354462, 10, (0, 8.2)), (0, 100, 10, (0, 10.0)), (-5, 5, 10, (-5, 1.0)), (0, 0, 10, (0, 1.0))])
def test_automatic_width(low, high, n, want):
    assert histogram.auto_step(low, high, n) == pytest.approx(want)


def test_histogram_spec_and_edges(spark):
    assert histogram.width(histogram.parse_spec("dur 10:0-75u")) == pytest.approx(7.5e-06)
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.99, 1.0, 9.99, 10.0, 12.0, None)], "dur double")
    got = {r["bin"]: (r["freq"], r["cum"]) for r in histogram.histogram(df, "dur 10:0-10").collect()}
    assert {k: v[0] for k, v in got.items()} == {0: 1, 1: 2, 2: 1, 10: 1, 11: 2} and got[11][1] == pytest.approx(100)
    assert histogram.histogram(df.limit(0), "dur 10").count() == 0


def test_order_statistics(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 2, 2, 3, 4, 4, 4, 100]] + [(None,)], "dur double")
    r = histogram.order_statistics(df, "dur").first()
    assert (r["n"], r["median"], r["p95"], r["mode"], r["min"], r["max"]) == (9, 3.0, 100.0, 2.0, 1.0, 100.0)


def test_port_ranges(make_flows):
    rows = [{"daddr": "x", "proto": 6, "dport": p} for p in (443, 80, 1000, 1001, 1002, 1003, 1004, 1005, 80, None)] + [{"daddr": None, "proto": 6, "dport": 5}]
    assert [tuple(r) for r in inventory.ports(make_flows(rows)).collect()] == [("x", 6, 8, "80,443,1000-1005")]


def test_path_notation(make_flows):
    hops = [(1, "A"), (2, "B"), (3, "D"), (3, "C"), (4, "F")]
    got = inventory.paths(make_flows([{"saddr": "s", "daddr": "t", "sttl": h, "inode": n, "das": {1: 7, 2: 7, 3: 8}.get(h, 9), "dur": 1.0} for h, n in hops])).first()
    assert got["path"] == "A -> B -> {C,D} -> F" and got["as_path"] == "7 -> 8 -> 9" and got["hops"] == 4


def test_longest_prefix(spark, make_flows):
    table = spark.createDataFrame([(*addresses.span(c), int(c.split("/")[1]), n, v) for c, n, v in (("0.0.0.0/0", "all", 1), ("10.0.0.0/8", "client", 1), ("10.0.0.0/25", "lab", 3), ("10.0.0.0/25", "lab2", 2), ("192.168.0.0/30", "core", None))], "lo bigint, hi bigint, masklen int, label string, locality int")
    df = make_flows([{"saddr": a} for a in ("10.0.0.5", "10.0.0.200", "192.168.0.1", "192.168.0.9", "2001:db8::1", None)])
    got = lookups.longest_prefix(df, "saddr_i", table, {"label": "l", "locality": "v"}).orderBy("autoid").select("l", "v").collect()
    assert [tuple(r) for r in got] == [("lab", 3), ("client", 1), ("core", None), ("all", 1), (None, None), (None, None)]
    got = lookups.matching_prefixes(df, "saddr_i", table, "label").orderBy("autoid").first()
    assert got["labels"] == ["all", "client", "lab"]
    assert lookups.longest_prefix(df, "saddr_i", table.limit(0), {"label": "l"}).where("l is null").count() == 6


def test_as_of(spark):
    left = spark.createDataFrame([("k", 5), ("k", 10), ("k", 250), ("k", None), (None, 7), ("z", 3)], "k string, t bigint")
    right = spark.createDataFrame([("k", 7, "a", 1), ("k", 10, "b", None), ("k", 10, "b", 3), ("k", 120, None, 4)], "k string, u bigint, x string, y int")
    got = {(r["k"], r["t"]): (r["x"], r["y"]) for r in lookups.as_of(left, right, "k", "t", "u", ["x", "y"], slice_us=50).collect()}
    assert got == {("k", 5): (None, None), ("k", 10): ("b", 3), ("k", 250): (None, 4), ("k", None): (None, None), (None, 7): (None, None), ("z", 3): (None, None)}


def test_policy_first_match(make_flows):
    lines = policy.parse_policy("permit tcp any host 10.0.0.9 eq http\ndeny ip 10.0.0.0 0.0.0.255 any\npermit udp any gt 1000 any range 50 60\npermit tcp any any established")
    df = make_flows([
        {"proto": 6, "saddr": "10.0.0.1", "daddr": "10.0.0.9", "dport": 80}, {"proto": 6, "saddr": "10.0.0.1", "daddr": "10.0.0.9", "dport": 81}, {"proto": 17, "saddr": "10.1.0.1", "sport": 1001, "dport": 53},
        {"proto": 6, "saddr": "10.1.0.1", "status": 4}, {"proto": 6, "saddr": "10.1.0.1", "status": 1}, {},
    ])
    assert [(r["acl_line"], r["permitted"]) for r in policy.evaluate(df, lines).orderBy("autoid").collect()] == [(1, True), (2, False), (3, True), (4, True), (0, False), (0, False)]


def test_labels(spark):
    rows = ['{"svc":"dns","conf":0.9}', '{"svc":"web","note":["seen","x"]}', '{"svc":null}', '{"svc":', "svc=web:who=lab", "", None, "{}"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, label string")
    got = [r[0] for r in df.orderBy("i").select(labels.text(labels.parsed("label"))).collect()]
    assert got == ['{"conf":["0.9"],"svc":["dns"]}', '{"note":["seen","x"],"svc":["web"]}', None, None, '{"svc":["web"],"who":["lab"]}', None, None, None]
    one = labels.merged_labels(df.withColumn("k", F.lit(1)), ["k"]).first()
    assert one["label"] == '{"conf":["0.9"],"note":["seen","x"],"svc":["dns","web"],"who":["lab"]}'
    u = df.where("i in (0, 1)").selectExpr("max(case when i = 0 then label end) as a", "max(case when i = 1 then label end) as b")
    assert u.select(labels.text(labels.union(labels.parsed("a"), labels.parsed("b")))).first()[0] == '{"conf":["0.9"],"note":["seen","x"],"svc":["dns","web"]}'


def test_grep_sees_all_bytes(make_flows):
    df = make_flows([{"suser": bytearray(b"\x00\xffGET /")}, {"duser": bytearray(b"get")}, {"suser": None}, {"suser": bytearray(b"")}])
    ids = lambda *a, **k: [r[0] for r in labels.grep(df, *a, **k).orderBy("autoid").select("autoid").collect()]
    assert ids(["s:GET"]) == [0] and ids(["get"]) == [1] and ids(["GET"], ignore_case=True) == [0, 1] and ids(["s:GET"], invert=True) == [1, 2, 3] and ids([r"s:^\x00\xff"]) == [0]


def test_anonymised_addresses_keep_their_networks(make_flows):
    df = make_flows([{"saddr": "192.0.2.7", "daddr": "198.51.100.3", "sport": 80, "dport": 50000}, {"saddr": "192.0.2.9", "daddr": "192.0.2.7", "sport": 2000, "dport": None}, {"saddr": "2001:db8::1", "daddr": "224.0.0.1"}, {}])
    got = anonymize.anonymize(df, 5).orderBy("autoid").collect()
    assert [(r["saddr"], r["daddr"]) for r in got[:2]] == [("10.0.0.1", "10.0.1.1"), ("10.0.0.2", "10.0.0.1")]
    assert got[2]["saddr"].startswith("x:") and got[2]["daddr"] == "224.0.0.1" and got[3]["saddr"] is None
    assert (got[0]["sport"], got[0]["dport"], got[1]["sport"]) == (80, 50005, 2005)


NOW = datetime(2011, 9, 23, 15, 30, 20, tzinfo=UTC)


@pytest.mark.parametrize(
    "text, start, end",
    [
        ("14", (2011, 9, 23, 14), (2011, 9, 23, 15)), ("15-23", (2011, 9, 23, 15), (2011, 9, 23, 23)), ("2011", (2011, 1, 1), (2012, 1, 1)), ("2011/08", (2011, 8, 1), (2011, 9, 1)),
        ("2011/08-2011/10", (2011, 8, 1), (2011, 11, 1)), ("1270616652+2s", (2010, 4, 7, 5, 4, 12), (2010, 4, 7, 5, 4, 14)), ("1999y1m23d10h", (1999, 1, 23, 10), (1999, 1, 23, 11)),
        ("23.11:10-14", (2011, 9, 23, 11, 10), (2011, 9, 23, 14)), ("-10m", (2011, 9, 23, 15, 20, 20), (2011, 9, 23, 15, 30, 20)), ("-2h5m+5m", (2011, 9, 23, 13, 25, 20), (2011, 9, 23, 13, 30, 20)),
        ("-0M+1d", (2011, 9, 1), (2011, 9, 2)), ("n14:10:15-14:10:19", (2011, 9, 23, 14, 10, 15), (2011, 9, 23, 14, 10, 19)), ("c14:10-14:10:10", (2011, 9, 23, 14, 10), (2011, 9, 23, 14, 10, 10)),
    ],
)
def test_time_ranges(text, start, end):
    r = timerange.parse(text, NOW)
    assert (r.start, r.end) == (datetime(*start, tzinfo=UTC), datetime(*end, tzinfo=UTC))


def test_time_wildcards_and_relations(make_flows):
    us = lambda *t: int(datetime(*t, tzinfo=UTC).timestamp() * S)
    df = make_flows([{"stime_us": us(2011, 9, 5, 14, 7, 15), "ltime_us": us(2011, 9, 5, 14, 7, 30)}, {"stime_us": us(2011, 9, 10, 3, 9, 15), "ltime_us": us(2011, 9, 10, 5)}, {"stime_us": us(2009, 11, 23, 1), "ltime_us": None}, {}])
    ids = lambda t: [r[0] for r in timerange.within(df, t, NOW).orderBy("autoid").select("autoid").collect()]
    assert ids("**.14") == [0] and ids("10d*h*m15s") == [1] and ids("****/11/23") == [2]
    assert ids("c2011/09/10.03-2011/09/10.06") == [1] and ids("n2011/09/10.04:00-2011/09/10.04:30") == [1] and ids("2011/09/10.04") == [1] and ids("x2011") == [2, 3]


def test_cidr_cover_of_a_range():
    assert addresses.range_to_cidrs(addresses.span("10.0.0.1/32")[0], addresses.span("10.0.0.6/32")[0]) == [(167772161, 32), (167772162, 31), (167772164, 31), (167772166, 32)]


def test_select_list(make_flows):
    df = fields.select_fields(make_flows([{"saddr": "192.168.100.200", "sbytes": 5}]), "saddr:8 bytes sid")
    assert df.columns == ["saddr", "bytes", "sid"] and df.first()["saddr"] == "192.168*"
    assert fields.select_fields(make_flows([{}]), "-proto -state +#1sid").columns == "stime sid saddr sport dir daddr dport pkts bytes".split()


def test_rules_reader():
    rules = cluster.parse_rules('DEFAULT_MODEL=x\nfilter="tcp" model="saddr" status="120" label="a" cont # note\nmodel="all"')
    assert [(r.filter, r.keys, r.label, r.cont) for r in rules] == [("tcp", "saddr", "a", True), ("", "all", "", False)]


def test_operators_on_nothing(make_flows):
    none = make_flows([{}]).limit(0)
    assert cluster.cluster(none).count() == 0 and cluster.idle_split(none, ["saddr"], 5).count() == 0 and bins.split(none, "1m").count() == 0
    assert bins.count_bins(none, 5).count() == 0 and inventory.peers(none).count() == 0 and anonymize.anonymize(none).count() == 0 and inventory.matrix(none, "saddr", "daddr", "sbytes").count() == 0
    assert cluster.cluster_by_rules(none, cluster.parse_rules('filter="tcp" model="saddr"')).count() == 0


# --- ranges by sampled quantiles


def test_ranges_stay_even_and_running_totals_right(spark):
    from fluxmill.operators import ranges

    n = 100_000
    df = spark.range(n).select(F.col("id").alias("a"), (F.lit(1_700_000_000_000_000) + F.pmod(F.col("id") * 7919, F.lit(n))).alias("v"))
    bounds = ranges.split_points(df, "v")
    sizes = [r["count"] for r in ranges.with_range(df, "v", bounds).groupBy("_part").count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 1.5 * ranges.PER_RANGE
    got = ranges.running_total(df, ["v"], F.lit(2)).select(F.sum(F.when(F.col("_upto") != (F.col("v") - 1_700_000_000_000_000 + 1) * 2, 1).otherwise(0))).first()[0]
    assert got == 0
    few = spark.createDataFrame([(3, 1.0), (1, None), (2, float("nan")), (4, -5.0)], "a int, v double")
    assert ranges.split_points(few, "v") == []
    assert {r["a"]: r["_part"] for r in ranges.with_range(few, "v", [0.0]).collect()} == {3: 1, 1: 2, 2: 2, 4: 0}
    assert ranges.split_points(few.limit(0), "v", 1) == [] and ranges.split_points(few.where("v is null"), "v", 1) == []


def test_pauses_of_one_key_in_one_hour(spark, make_flows):
    """Half of all rows are one key's within an hour; every range of time keeps to its share and the pauses are right."""
    from fluxmill.operators import inventory, ranges

    rows = [{"saddr": "10.0.0.1", "stime_us": 10**15 + i * 1000, "ltime_us": 10**15 + i * 1000 + 400} for i in range(2000)]
    rows += [{"saddr": f"10.0.1.{i % 200}", "stime_us": 10**15 + i * 3_600_000_000, "ltime_us": None} for i in range(2000)]
    f = make_flows(rows)
    bounds = ranges.split_points(f, "stime_us", 200)
    parts = ranges.with_range(f, "stime_us", bounds).groupBy("saddr", "_part").count().agg(F.max("count")).first()[0]
    assert parts <= 400
    for per in (200, 10**6):
        got = {r["saddr"]: r for r in inventory.gaps_between(f, ["saddr"], per).collect()}
        hot = got["10.0.0.1"]
        assert hot["n"] == 1999 and abs(hot["intflow"] - 0.0006) < 1e-12 and hot["intflowmin"] == hot["intflowmax"] == 0.0006
        assert got["10.0.1.5"]["n"] == 9 and got["10.0.1.5"]["intflowmin"] == 200 * 3600.0
