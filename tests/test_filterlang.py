"""Filter language: precedence, inheritance, two-valued logic, and random filters against a plain evaluator."""

import itertools

import pytest
from fluxmill.plans.filterlang import FilterError, compile_filter, compile_sql, where
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "a, b",
    [
        ("udp or tcp and port 80", "(udp or tcp) and port 80"),
        ("not host 10.0.0.1 and 10.0.0.2", "not host 10.0.0.1 and host 10.0.0.2"),
        ("tcp dst port ftp or domain or 8080", "tcp dst port 21 or tcp dst port 53 or tcp dst port 8080"),
        ("src or dst pkts gt 5", "pkts gt 5"),
        ("! udp && port 53", "not udp and port 53"),
        ("dst or src net 10.0.0.0/8", "net 10.0.0.0/8"),
        ("bytes > 1k", "bytes gt 1000"),
        ("host 10.1.2.3 mask 255.255.0.0", "net 10.1.0.0/16"),
        ("tcp and not (syn or fin)", "tcp and not syn and not fin"),
    ],
)
def test_same_meaning(make_flows, a, b):
    rows = [
        {"saddr": s, "daddr": d, "proto": p, "sport": 1025, "dport": q, "spkts": k, "sbytes": k and k * 400, "status": f}
        for s, d, p, q, k, f in itertools.product(["10.0.0.1", "10.1.2.3", "2001:db8::1", None], ["10.0.0.2", "192.0.2.1"], [6, 17, 1, None], [21, 53, 80, 8080, None], [None, 3, 9], [0, 9])
    ]
    df = make_flows(rows)
    ids = lambda t: {r[0] for r in df.where(compile_filter(t)).select("autoid").collect()}
    assert ids(a) == ids(b)


@pytest.mark.parametrize("text", ["tcp port", "host nowhere.example", "src", "(tcp", "tcp udp", "port 80 and", "bytes gt many", "443", "tcp[0] = 3"])
def test_rejected(text):
    with pytest.raises(FilterError):
        compile_sql(text)


def test_missing_values_are_two_valued(make_flows):
    df = make_flows([{"saddr": "10.0.0.1", "sttl": None}, {"saddr": "10.0.0.1", "sttl": 3}, {"saddr": "10.0.0.1", "sttl": 9}])
    ids = lambda t: [r[0] for r in df.where(compile_filter(t)).orderBy("autoid").collect()]
    assert ids("src ttl lt 5") == [0, 1]
    assert ids("src ttl gte 5") == [2]
    assert ids("not src ttl gte 5") == [0, 1]
    assert ids("src ttl neq 3") == [0, 2]


def test_filters_reach_the_reader(spark, sf):
    from fluxmill.sources.flows import flows

    plan = flows(spark, sf).where(compile_filter("tcp and dst port 443 and src loss gt 1")).select("autoid")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(proto,6)" in plan and "IsNotNull(sloss)" in plan
    assert "ReadSchema: struct<autoid:bigint,proto:smallint,dport:int,sloss:int>" in plan


def test_empty_filter_passes_all(make_flows):
    assert make_flows([{}, {}]).where(compile_filter("  ")).count() == 2


ATOMS = {
    "tcp": lambda r: r["proto"] == 6, "udp": lambda r: r["proto"] == 17, "src pkts gt 5": lambda r: r["spkts"] is not None and r["spkts"] > 5,
    "src pkts lte 5": lambda r: not (r["spkts"] is not None and r["spkts"] > 5), "dst bytes neq 7": lambda r: not (r["dbytes"] == 7), "syn": lambda r: r["proto"] == 6 and r["status"] & 1 == 1,
    "src host 10.0.0.1": lambda r: r["saddr"] == "10.0.0.1", "pkts eq 7": lambda r: r["spkts"] == 7 or r["dpkts"] == 7,
    "dst port 80": lambda r: r["proto"] in (6, 17) and r["dport"] == 80,
}
trees = st.recursive(st.sampled_from(sorted(ATOMS)), lambda t: st.one_of(st.tuples(st.just("not"), t), st.tuples(st.sampled_from(["and", "or"]), t, t)), max_leaves=7)


def text_of(t):
    return t if isinstance(t, str) else f"not ({text_of(t[1])})" if t[0] == "not" else f"({text_of(t[1])} {t[0]} {text_of(t[2])})"


def value_of(t, r):
    if isinstance(t, str):
        return ATOMS[t](r)
    if t[0] == "not":
        return not value_of(t[1], r)
    a, b = value_of(t[1], r), value_of(t[2], r)
    return a and b if t[0] == "and" else a or b


@pytest.fixture(scope="module")
def grid(make_flows):
    rows = [
        {"saddr": s, "proto": p, "spkts": k, "dpkts": n, "dbytes": b, "status": f, "dport": q}
        for s, p, k, n, b, f, q in itertools.product(["10.0.0.1", None], [6, 17, None], [None, 4, 7], [None, 7], [None, 7], [0, 1], [80, None])
    ]
    df = make_flows(rows).cache()
    df.count()
    return rows, df


@given(st.lists(trees, min_size=12, max_size=12))
@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
def test_random_filters(grid, ts):
    rows, df = grid
    got = df.select("autoid", *(F.coalesce(compile_filter(text_of(t)), F.lit(False)).alias(f"c{i}") for i, t in enumerate(ts))).collect()
    for r in got:
        for i, t in enumerate(ts):
            assert r[f"c{i}"] == value_of(t, rows[r["autoid"]]), text_of(t)


@pytest.mark.parametrize(
    "net, hit, miss",
    [("2001:0::/32", ["2001:0:5::1", "2001::9"], ["2001:1::1", "20.1.0.1"]), ("2001::/16", ["2001:ff::1"], ["2002::1"]), ("fe80::/64", ["fe80::1", "fe80:0:0:0:5::"], ["fe80:1::1", "fe80:0:0:1::1"]), ("::/0", ["::", "::1", "2001::"], ["1.2.3.4", None]), ("2001:db8:fa::/47", ["2001:db8:fb::1"], ["2001:db8:fc::1"]), ("2001:db8::/33", ["2001:db8:7fff::1"], ["2001:db8:8000::1"]), ("::1", ["::1", "0:0:0:0:0:0:0:1"], ["::2"])],
)
def test_v6_prefixes_compare_numbers(spark, make_flows, net, hit, miss):
    f = make_flows([{"saddr": a} for a in [*hit, *miss]])
    assert {r[0] for r in where(f, f"src net {net}").select("saddr").collect()} == set(hit)


def test_words_need_their_columns(make_flows):
    f = make_flows([{"saddr": "1.1.1.1", "proto": 6}])
    for text in ("ack", "not push", "echo", "unrport", "dst urg", "tcp or timexed", "frag"):
        with pytest.raises(FilterError):
            where(f, text)
