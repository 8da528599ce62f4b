"""Operators and queries do the whole job: what an earlier form of them left out."""

import random
from collections import Counter

import pytest
from fluxmill.operators import cluster, lookups
from fluxmill.plans.catalog import core
from fluxmill.plans.filterlang import SWITCHES, FilterError, compile_sql
from fluxmill.plans.reference import sql

S = 1_000_000


def seen(sid, t, **kw):
    return {"saddr": "a", "daddr": "b", "proto": 6, "sport": 1, "dport": None, "sid": sid, "stime_us": int(t * S), "ltime_us": int(t * S), **kw}


def test_two_probes_pair_every_record(make_flows):
    rows = [seen("p", 1), seen("q", 1.1), seen("p", 5), seen("q", 5.2), seen("p", 59.9), seen("q", 60.2), seen("q", 200), seen("p", 261), seen("r", 5.3), seen("q", 5.2, seq=3)]
    got = Counter((r["fsid"], r["sid"], r["dlstime"]) for r in lookups.two_probes(make_flows(rows)).collect())
    # 200 and 261 are too far apart; the copy of (q, 3) counts once; r's one record is also the nearest of the others up to a minute off
    assert {k: n for k, n in got.items() if k[:2] == ("p", "q")} == {("p", "q", 0.1): 1, ("p", "q", 0.2): 1, ("p", "q", 0.3): 1}
    assert sorted(k[2] for k in got if k[:2] == ("p", "r")) == [-54.6, 0.3, 4.3]
    assert sorted(k[2] for k in got if k[:2] == ("q", "r")) == [-54.9, 0.1, 4.2]


NEAREST = sql(
    "SELECT fsid, sid, round(dldur, 6) AS dldur, dlstime, dlspkt FROM (SELECT DISTINCT fa, va, fsid, sid, dldur, dlstime, dlspkt FROM c WHERE rf = 1 OR rv = 1)",
    "r AS (SELECT sid, seq, saddr, daddr, proto, sport, dport, stime_us, dur, spkts, min(autoid) AS a FROM f WHERE stime_us IS NOT NULL AND sid IS NOT NULL AND saddr IS NOT NULL AND daddr IS NOT NULL GROUP BY sid, seq, saddr, daddr, proto, sport, dport, stime_us, dur, spkts, CASE WHEN seq IS NULL THEN autoid END)",
    """c AS (SELECT x.a AS fa, y.a AS va, x.sid AS fsid, y.sid AS sid, y.dur - x.dur AS dldur, (y.stime_us - x.stime_us) / 1e6 AS dlstime, y.spkts - x.spkts AS dlspkt,
  row_number() OVER (PARTITION BY x.a, y.sid ORDER BY abs(y.stime_us - x.stime_us), y.stime_us, y.a) AS rf, row_number() OVER (PARTITION BY y.a, x.sid ORDER BY abs(y.stime_us - x.stime_us), x.stime_us, x.a) AS rv
  FROM r x JOIN r y ON x.saddr = y.saddr AND x.daddr = y.daddr AND x.proto IS NOT DISTINCT FROM y.proto AND x.sport IS NOT DISTINCT FROM y.sport AND x.dport IS NOT DISTINCT FROM y.dport AND x.sid < y.sid AND abs(y.stime_us - x.stime_us) <= 60000000)""",
)


def test_two_probes_like_interval_join(spark, sf, duck):
    plain = lambda r: tuple(None if x is None else round(float(x), 6) if not isinstance(x, str) else x for x in r)
    got = core.queries["a29_two_probes"](spark, sf).select("fsid", "sid", "dldur", "dlstime", "dlspkt").collect()
    want = duck.execute(NEAREST).fetchall()
    assert Counter(map(plain, got)) == Counter(map(plain, want)) and want


def test_score_tries_the_other_direction(make_flows):
    week = 7 * 86400 * S
    base = [seen("p", 0, saddr="c", daddr="d", proto=17, dport=53, ltime_us=2 * week), seen("p", 0, saddr="c", daddr="d", dport=80, ltime_us=2 * week, status=1), seen("p", 0, saddr="c", daddr="d", proto=50, dport=7)]
    far = {"saddr": "d", "daddr": "c"}
    rows = [seen("p", 9, **far, proto=17, sport=53, dport=9), seen("p", 9, **far, sport=80, dport=9, status=4), seen("p", 9, **far, sport=80, dport=9, status=1), seen("p", 9, **far, proto=50, sport=7, dport=9), seen("p", 9, **far, proto=17, sport=54, dport=53), seen("p", 9, saddr="c", daddr="d", proto=17, dport=53)]
    keys = ["saddr", "daddr", "proto", "dport"]
    known = lookups.baseline(make_flows(base), keys)
    got = {r["autoid"]: r["score"] for r in lookups.score(make_flows(rows), known, known, keys).collect()}
    assert got == {0: 3, 1: 3, 2: 0, 3: 0, 4: 0, 5: 3}  # two SYNs and ESP: conversations of their own; 4: another port


def test_sort_keeps_the_whole_table(spark, sf, duck):
    got = [tuple(r) for r in core.queries["o1_sort"](spark, sf).select("autoid", "saddr", "bytes").collect()]
    text = core.sql["o1_sort"]
    want = duck.execute(text.removesuffix(" LIMIT 100")).fetchall()
    assert len(got) == duck.execute("SELECT count(*) FROM argus").fetchone()[0] > 100
    assert got == want and got[:100] == duck.execute(text).fetchall()[:100]


def test_written_sort_keeps_its_order(spark, sf, tmp_path):
    at = str(tmp_path / "sorted")
    core.queries["o1_sort"](spark, sf).write.parquet(at)
    parts = [spark.read.parquet(str(p)).collect() for p in sorted((tmp_path / "sorted").glob("part-*.parquet"))]
    assert [tuple(r) for part in parts for r in part] == [tuple(r) for r in core.queries["o1_sort"](spark, sf).collect()]


def test_idle_timer_null_end_at_a_slice_edge(make_flows):
    rows = [seen("p", 3500, ltime_us=3505 * S), seen("p", 3550, ltime_us=None), seen("p", 3606), seen("p", 3666)]
    got = cluster.idle_split(make_flows(rows), ["saddr"], 60).orderBy("stime_us").collect()
    assert [(r["stime_us"] // S, r["ltime_us"] // S, r["trans"]) for r in got] == [(3500, 3606, 3), (3666, 3666, 1)]


def test_status_reports_hold_every_record(spark, sf, duck):
    rows = duck.execute(sql("SELECT saddr, stime_us, greatest(coalesce(ltime_us, stime_us), stime_us), coalesce(sbytes, 0) + coalesce(dbytes, 0) FROM f WHERE saddr IS NOT NULL AND stime_us IS NOT NULL ORDER BY ALL")).fetchall()
    want, last = [], None
    for k, s, e, b in rows:
        if k != last or want[-1][2] - want[-1][1] >= 300 * S or s - want[-1][2] >= 3600 * S:
            want.append([k, s, e, 0, 0])
        last = k
        want[-1] = [k, min(want[-1][1], s), max(want[-1][2], e), want[-1][3] + 1, want[-1][4] + b]
    got = core.queries["st5_status"](spark, sf).collect()
    assert sum(r["n"] for r in got) == len(rows)
    assert Counter((r["saddr"], r["stime_us"], r["ltime_us"], r["n"], r["bytes"]) for r in got) == Counter(map(tuple, want))
    assert "open" in {r["reason"] for r in got}


def test_status_reports_of_nothing(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/argus.parquet").limit(0).coalesce(1).write.parquet(str(tmp_path / "argus.parquet"))
    assert core.queries["st5_status"](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("word", SWITCHES)
def test_filter_words_without_a_column(word):
    for text in (word, f"not {word}", f"tcp or {word}"):
        with pytest.raises(FilterError):
            compile_sql(text, {"proto"})
    assert word in compile_sql(word, {word})


@pytest.mark.parametrize("idle, slots", [(60, 1024), (7, 2), (0, 3)])
def test_idle_timer_of_a_hot_hour(make_flows, idle, slots):
    rng = random.Random(idle)
    rows = [seen("p", rng.randint(0, 3600), saddr="hot") for _ in range(600)] + [seen("p", rng.randint(-5000, 50_000), saddr=f"k{i % 9}") for i in range(600)]
    rows = [r | {"ltime_us": rng.choice([None, r["stime_us"], r["stime_us"] + rng.choice([1, 5, 4000]) * S])} for r in rows]
    want = Counter()
    for k in {r["saddr"] for r in rows}:
        part = None
        for r in sorted((r for r in rows if r["saddr"] == k), key=lambda r: (r["stime_us"], r["ltime_us"] or -(10**18))):
            end = r["stime_us"] if r["ltime_us"] is None else r["ltime_us"]
            if part and r["stime_us"] - part[1] < idle * S:
                part = [part[0], max(part[1], end), part[2] + 1]
            else:
                if part:
                    want[k, part[0], part[2]] += 1
                part = [r["stime_us"], end, 1]
        want[k, part[0], part[2]] += 1
    got = Counter((r["saddr"], r["stime_us"], r["trans"]) for r in cluster.idle_split(make_flows(rows), ["saddr"], idle, slots).collect())
    assert got == want


def test_status_timer_over_small_batches(spark, make_flows):
    rng = random.Random(4)
    rows = [seen("p", rng.randint(0, 4000), saddr=rng.choice(["a", "b", None]), proto=rng.choice([6, None])) for _ in range(300)]
    whole = Counter(tuple(r) for r in cluster.status_split(make_flows(rows), ["saddr", "proto"], 50, 100).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert Counter(tuple(r) for r in cluster.status_split(make_flows(rows), ["saddr", "proto"], 50, 100).collect()) == whole and len(whole) > 50
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_access_lists_read_or_refuse_every_word(make_flows):
    from fluxmill.operators import policy

    f = make_flows([{"proto": 6, "status": x} for x in (0, 1, 3, 8)])
    got = [r["permitted"] for r in policy.evaluate(f, policy.parse_policy("permit tcp any any syn log")).orderBy("autoid").collect()]
    assert got == [False, True, True, False]
    for text in ("permit tcp any any fragments", "permit udp any any syn", "permit tcp any any eq 80 stateless"):
        with pytest.raises(ValueError):
            policy.parse_policy(text)
    with pytest.raises(ValueError):
        policy.evaluate(f, policy.parse_policy("permit tcp any any psh"))


def test_rules_without_aggregation_and_with_timers():
    rules = cluster.parse_rules('filter="tcp" model="saddr" status="60" idle=5 label="status=9"\nfilter="udp" idle=0 cont')
    assert [(r.status_s, r.idle_s, r.cont) for r in rules] == [(60.0, 5.0, False), (None, None, True)]


def test_sort_keys_masks_and_directions(spark, sf, duck):
    from fluxmill.operators import sorting
    from fluxmill.sources.flows import flows

    got = [r[0] for r in sorting.sort(flows(spark, sf), "saddr/16 -dport autoid").select("autoid").collect()]
    assert got == [r[0] for r in duck.execute(sql("SELECT autoid FROM f ORDER BY saddr_i & 4294901760 NULLS LAST, CASE WHEN saddr_i IS NULL THEN saddr END NULLS LAST, dport DESC NULLS LAST, autoid")).fetchall()]
    turned = [r[0] for r in sorting.sort(flows(spark, sf), "-bytes autoid", reverse=True).select("autoid").collect()]
    assert turned == [r[0] for r in duck.execute(sql("SELECT autoid FROM f ORDER BY coalesce(sbytes, 0) + coalesce(dbytes, 0), autoid DESC")).fetchall()]
    assert sum(len(sorting.order(k, set())) for k in sorting.KEYS) == 91 and len(set(sorting.KEYS)) == 89
    for bad in ("nothing", "dport/8"):
        with pytest.raises((KeyError, ValueError)):
            sorting.order(bad, set())


def test_forms_of_numbers_and_payload(spark):
    import base64

    from fluxmill.functions import fields

    df = spark.createDataFrame([(None,), (0,), (999,), (1000,), (-1_234_567,), (10**15,)], "n bigint")
    assert [r[0] for r in df.select(fields.abbreviated("n")).collect()] == [None, "0", "999", "1.00K", "-1.23M", "1.00P"]
    assert df.select(fields.abbreviated("n", 0)).collect()[4][0] == "-1M"
    data = [None, b"", b"a", b"ab\x00c", b"login: root password: s3cret.", bytes(range(0, 256, 7))]
    rows = spark.createDataFrame([(None if d is None else bytearray(d),) for d in data], "d binary").select(*(fields.payload("d", f).alias(f) for f in ("ascii", "obfuscate", "encode32", "encode64", "hex"))).collect()
    assert [r["encode32"] for r in rows] == [None if d is None else base64.b32encode(d).decode() for d in data]
    assert rows[3]["ascii"] == "ab.c" and rows[4]["obfuscate"] == "login: xxxxx password: xxxxx." and rows[2]["encode64"] == "YQ==" and rows[2]["hex"] == "61"


def test_no_host_becomes_a_broadcast_address(make_flows):
    from fluxmill.operators import anonymize

    f = make_flows([{"saddr": f"10.1.2.{i}", "daddr": "224.0.0.5", "smac": "00:00:5e:00:00:%02x" % i, "dmac": "ff:ff:ff:ff:ff:ff", "sas": i} for i in range(256)])
    got = {r["addr_i"]: r["anon_i"] for r in anonymize.address_map(f).collect()}
    assert len(set(got.values())) == 257 and [a for a, n in got.items() if n & 255 == 255] == [(10 << 24) + (1 << 16) + (2 << 8) + 255]
    rows = anonymize.anonymize(f, keep_vendor=False).collect()
    assert len({r["smac"] for r in rows}) == 256 and all(r["smac"].startswith("02:") and r["dmac"] == "ff:ff:ff:ff:ff:ff" for r in rows)
    assert {r["sas"] for r in rows} == {0, *range(4_200_000_000, 4_200_000_255)}
