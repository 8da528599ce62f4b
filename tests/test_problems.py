"""Interval, rolling, session and skew operators against plain Python on small and random inputs."""

import random
from collections import defaultdict

import numpy as np
import pytest
from fluxmill.operators import intervals, rolling, sessions, skew
from hypothesis import given, settings
from hypothesis import strategies as st


def brute_periods(rows):
    by = defaultdict(list)
    for k, s, e in rows:
        if k is not None and s is not None and e is not None and s <= e:
            by[k].append((s, e))
    out = {}
    for k, spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out[k] = merged
    return out


@given(st.lists(st.tuples(st.integers(0, 200), st.integers(1, 60)), min_size=1, max_size=30))
@settings(max_examples=150, deadline=None)
def test_dyadic_union_is_the_union(spans):
    lo = np.array([a for a, _ in spans], dtype=np.int64)
    hi = np.minimum(lo + np.array([n for _, n in spans]), 256)
    lo, hi = lo[lo < hi], hi[lo < hi]
    starts, ends = intervals.union_of(lo, hi, 8)
    covered = {x for a, b in zip(lo, hi) for x in range(a, b)}
    assert {x for a, b in zip(starts, ends) for x in range(a, b)} == covered
    assert all(e < s for e, s in zip(ends[:-1], starts[1:]))


@given(st.integers(0, 1000), st.integers(1, 1000))
@settings(max_examples=100, deadline=None)
def test_blocks_are_canonical(a, n):
    starts, levels = intervals.dyadic_blocks(np.array([a]), np.array([a + n]), 20)
    assert all(s % (1 << lv) == 0 for s, lv in zip(starts, levels))
    cells = sorted(x for s, lv in zip(starts, levels) for x in range(s, s + (1 << lv)))
    assert cells == list(range(a, a + n))
    assert len(starts) <= 2 * 11


@pytest.mark.parametrize("bits", [4, 33])
def test_gaps_and_periods_match_brute_force(spark, bits):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.choice([None, rng.randint(0, 400)]), 0) for _ in range(150)]
    rows = [(k, s, None if rng.random() < 0.05 else (s or 0) + rng.choice([-1, 0, 0, 1, 3, 40])) for k, s, _ in rows]
    rows += rows[:20] + [("edge", 7, 8), ("edge", 8, 9), ("edge", 10, 10), ("neg", 5, 4)]
    df = spark.createDataFrame(rows, "id string, s bigint, e bigint").selectExpr("*", "1 as lo", "2 as key", "3 as slice")
    want = brute_periods(rows)
    got = intervals.periods(df, "id", "s", "e", bits).collect()
    assert sorted(map(tuple, got)) == sorted((k, s, e) for k, v in want.items() for s, e in v)
    got = intervals.gaps(df, "id", "s", "e", bits).collect()
    assert sorted(map(tuple, got)) == sorted((k, a[1], b[0]) for k, v in want.items() for a, b in zip(v, v[1:]))


@pytest.mark.parametrize("bits, long, cover", [(6, 3, 5), (5, 64, 12)])
def test_long_intervals_become_covers(spark, monkeypatch, bits, long, cover):
    """Small slices and few levels: covers of covers, covered slices with pieces of their own, covers that touch."""
    monkeypatch.setattr(intervals, "LONG", long)
    monkeypatch.setattr(intervals, "COVER_BITS", cover)
    rng = random.Random(bits)
    rows = [(rng.choice("abc"), rng.randint(-3000, 9000), 0) for _ in range(120)]
    rows = [(k, s, s + rng.choice([0, 1, 5, 30, 200, 900])) for k, s, _ in rows] + [("b", 100, 4000), ("c", -2000, 8000), ("c", 8000, 8100), ("d", 16, 320), ("d", 321, 400), ("d", 20, 21)]
    df = spark.createDataFrame(rows, "id string, s bigint, e bigint")
    want = brute_periods(rows)
    assert sorted(map(tuple, intervals.periods(df, "id", "s", "e", bits).collect())) == sorted((k, s, e) for k, v in want.items() for s, e in v)
    assert sorted(map(tuple, intervals.gaps(df, "id", "s", "e", bits).collect())) == sorted((k, a[1], b[0]) for k, v in want.items() for a, b in zip(v, v[1:]))


def test_an_interval_to_the_year_9999(spark):
    """It stays a handful of rows, however long, and the tasks of a hot key stay even beside it."""
    end = 253_402_300_799_000_000
    rows = [("k", 10**15 + i * 10**6, 10**15 + i * 10**6 + 5) for i in range(3000)] + [("k", 10**15 + 2_000 * 10**6, end), ("o", 0, end), ("o", end + 5, end + 6)]
    df = spark.createDataFrame(rows, "id string, s bigint, e bigint")
    pieces, covers = intervals._pieces(intervals._half_open(df, "id", "s", "e"), 20)
    assert pieces.count() <= 3 * len(rows) and covers.count() == 2
    assert pieces.groupBy("key", "slice").count().agg({"count": "max"}).first()[0] < 10
    got = sorted(map(tuple, intervals.periods(df, "id", "s", "e").collect()))
    assert len(got) == 2003 and got[-1] == ("o", end + 5, end + 6) and ("o", 0, end) in got and ("k", 10**15 + 2_000 * 10**6, end) in got
    assert [tuple(r) for r in intervals.gaps(df.where("id = 'o'"), "id", "s", "e").collect()] == [("o", end, end + 5)]


def test_gaps_of_nothing(spark):
    df = spark.createDataFrame([], "id string, s bigint, e bigint")
    assert intervals.gaps(df, "id", "s", "e").count() == 0
    assert intervals.periods(df, "id", "s", "e").count() == 0


def test_periods_across_many_batches(spark):
    n = 25_000  # several Arrow batches of one key in one slice
    df = spark.range(n).selectExpr("'k' as id", "id * 10 as s", "id * 10 + case when id % 1000 = 999 then 5 else 10 end as e")
    got = sorted(map(tuple, intervals.periods(df, "id", "s", "e").collect()))
    assert got == [("k", i * 10_000, i * 10_000 + 9_995) for i in range(25)]


def test_trailing_totals(spark):
    rows = [("a", 10, 5), ("a", 10, None), ("a", 12, 7), ("a", 50, 1), ("b", 3, None), (None, 3, 9), ("c", None, 4)]
    df = spark.createDataFrame(rows, "id string, d int, x bigint").selectExpr("*", "1 as key", "2 as day")
    got = {(r["id"], r["day"]): (r["total_7"], r["total_30"], r["day_no"]) for r in rolling.trailing_totals(df, "id", "d", "x").collect()}
    daily = {10: 5, 12: 7, 50: 1}
    want = {("a", d): (sum(v for k, v in daily.items() if d - 7 < k <= d), sum(v for k, v in daily.items() if d - 30 < k <= d), d - 10) for d in range(10, 51)}
    assert got == want | {("b", 3): (0, 0, 0)}
    assert rolling.trailing_totals(df.limit(0), "id", "d", "x").count() == 0


def brute_sessions(rows, gap_us):
    by = defaultdict(list)
    for k, t, x in rows:
        if k is not None and t is not None:
            by[k].append((t, x or 0))
    out = []
    for k, events in by.items():
        events.sort()
        start = 0
        for i in range(1, len(events) + 1):
            if i == len(events) or events[i][0] - events[i - 1][0] > gap_us:
                part = events[start:i]
                out.append((k, part[0][0], part[-1][0], part[-1][0] - part[0][0], len(part), sum(x for _, x in part)))
                start = i
    return sorted(out)


def test_sessions(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randint(0, 40) * 900_000_000]), rng.choice([None, 1, 2])) for _ in range(80)]
    rows += [("t", 0, 1), ("t", 1_800_000_000, 1), ("u", 0, 1), ("u", 1_800_000_001, 1), ("t", 0, 1)]
    df = spark.createDataFrame(rows, "id string, t bigint, x bigint").selectExpr("*", "'z' as key", "1 as n", "2 as us")
    got = sorted(map(tuple, sessions.sessions(df, "id", "t", 1800, ("x",)).collect()))
    assert got == brute_sessions(rows, 1_800_000_000)
    assert sessions.sessions(df.limit(0), "id", "t", 1800, ("x",)).count() == 0


def test_keyed_fold_splits_and_stitches(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None, ""]), rng.choice([None, rng.randint(0, 50), rng.randint(0, 5000)]), rng.choice([None, 3])) for _ in range(400)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, t bigint, x bigint").selectExpr("*", "1 as key", "2 as at", "3 as n")
    want = {}
    for k in {r[0] for r in rows}:
        t = sorted(r[1] for r in rows if r[0] == k and r[1] is not None)
        own = [r for r in rows if r[0] == k]
        step = max((b - a for a, b in zip(t, t[1:])), default=None) if t and t[0] < t[-1] else None
        want[k] = (len(own), t[0] if t else None, t[-1] if t else None, step, sum(r[2] or 0 for r in own))
    got = {r[0]: tuple(r)[1:] for r in skew.keyed_fold(df, "k", "t", {"total": "x"}, ("i",), partitions=7).collect()}
    assert got == want
    states = skew.partial_states(df, "k", "t", {"total": "x"}, ("i",), partitions=7)
    assert states.where("k = 'hot'" if "k" in states.columns else "key = 'hot'").count() > 1
    assert skew.keyed_fold(df.limit(0), "k", "t", {"total": "x"}).count() == 0


@pytest.mark.parametrize("gap, slots", [(1, 4), (0.5, 4096), (0, 8), (30, 2)])
def test_sessions_of_a_hot_hour(spark, gap, slots):
    """One key with half of all rows in one hour: its rows shrink to its slots before they are sorted."""
    rng = random.Random(int(gap * 10) + slots)
    rows = [("hot", 10**15 + rng.randint(0, 3_600_000) * 1000, 1) for _ in range(1500)] + [(f"k{i % 40}", rng.choice([None, -5_000_000, rng.randint(-(10**8), 10**8)]), 1) for i in range(1500)]
    df = spark.createDataFrame(rows, "id string, t bigint, x bigint")
    by = defaultdict(list)
    for k, t, _ in rows:
        if t is not None:
            by[k].append(t)
    want = []
    for k, ts in by.items():
        ts.sort()
        open_ = [ts[0], ts[0], 0]
        for t in ts:
            if t - open_[1] > gap * 1_000_000:
                want.append((k, *open_))
                open_ = [t, t, 0]
            open_[1], open_[2] = t, open_[2] + 1
        want.append((k, *open_))
    got = [(r["id"], r["start_us"], r["end_us"], r["n"]) for r in sessions.sessions(df, "id", "t", gap, ("x",), slots).collect()]
    assert sorted(got) == sorted(want)
