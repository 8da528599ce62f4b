"""Training-data operators against plain Python, invariants, and the SQL of their queries."""

import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
from compare import canon  # noqa: E402
from fluxmill.llm import membership, mixture, packing, percentiles, tokens, toxicity, votes  # noqa: E402
from fluxmill.llm.queries import llm  # noqa: E402


@pytest.mark.parametrize("name", sorted(llm.queries))
def test_query(spark, sf, duck, name):
    df = llm.queries[name](spark, sf)
    got = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns, dtype=object)
    if name in llm.sql:
        cur = duck.execute(llm.sql[name])
        want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description], dtype=object)
        assert canon(got) == canon(want)


# --- percentiles


def test_percentiles(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 0, 1, 5, rng.randint(-50, 50), rng.randint(0, 10**12)])) for _ in range(400)] + [("one", 7), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v bigint").selectExpr("*", "1 as value", "2 as n", "3 as part")
    by = defaultdict(list)
    for g, v in rows:
        if v is not None:
            by[g].append(v)
    qs = (0, 12.5, 50, 90, 99.9, 100)
    want = {}
    for g, vs in by.items():
        vs.sort()
        for q in qs:
            k = max(1, -(-int(q * 1000) * len(vs) // 100_000))
            want[g, q] = (vs[k - 1], len(vs))
    counts = percentiles.value_counts(df, ["g"], "v")
    got = {(r["g"], r["q"]): (r["value"], r["n"]) for r in percentiles.percentiles(counts, ["g"], qs).collect()}
    assert got == want
    halves = [percentiles.value_counts(df.where(c), ["g"], "v") for c in ("v % 2 = 0", "v % 2 <> 0")]
    merged = percentiles.merged(halves[0].unionByName(halves[1]), ["g"])
    assert {(r["g"], r["q"]): (r["value"], r["n"]) for r in percentiles.percentiles(merged, ["g"], qs).collect()} == want
    assert percentiles.percentiles(percentiles.value_counts(df.limit(0), ["g"], "v"), ["g"], qs).count() == 0


def test_close_values_are_range_sorted(spark):
    """100,000 values around 1.7e15 and a hot group: many even ranges, the same percentiles for any bounds."""
    n, base = 100_000, 1_700_000_000_000_000
    df = spark.range(n).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g"), (F.lit(base) + F.pmod(F.col("id") * 7919, F.lit(n))).alias("v"))
    bounds = percentiles.split_points(df, "v")
    counts = percentiles.value_counts(df, ["g"], "v")
    parts = percentiles.with_range(counts, "value", bounds, "part").groupBy("g", "part").count().toPandas()
    assert parts[parts.g == "a"].part.nunique() > 8 and parts["count"].max() < 0.2 * n
    per = defaultdict(list)
    for r in df.collect():
        per[r["g"]].append(r["v"])
    want = {(g, float(q)): sorted(vs)[max(1, -(-q * len(vs) // 100)) - 1] for g, vs in per.items() for q in (0, 1, 50, 99, 100)}
    for cuts in (bounds, [], None, [float(base + 5)]):
        assert {(r["g"], r["q"]): r["value"] for r in percentiles.percentiles(counts, ["g"], (0, 1, 50, 99, 100), cuts).collect()} == want


def test_rounded_values_keep_their_error_bound(spark):
    df = spark.range(0, 100_000, 37).select(F.col("id"), percentiles.rounded(F.col("id"), 5).alias("r")).toPandas()
    assert (df.r <= df.id).all() and ((df.id - df.r) <= df.id / 32).all()
    assert df.r.nunique() < 450


# --- membership patterns


def test_membership(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([None, *map(str, range(25))]), rng.choice([None, *range(0, 200, 7)])) for _ in range(500)]
    df = spark.createDataFrame(rows, "s string, x string, d int").selectExpr("*", "1 as ident", "2 as word", "3 as bits")
    half = [membership.bitmaps(df.where(c), ["s"], "x", "d") for c in ("d < 90", "d >= 90")]
    totals = membership.patterns(membership.members(membership.merge(*half), ["s"]), ["s"])
    sets = defaultdict(set)
    for s, x, d in rows:
        if x is not None and d is not None:
            sets[s, d].add(x)
    assert {(r["s"], r["group_no"]): r["n"] for r in membership.per_group(totals, ["s"]).collect()} == {k: len(v) for k, v in sets.items()}
    early, late = F.exists("groups", lambda g: g < 50), F.exists("groups", lambda g: g >= 150)
    got = {r["s"]: (r["both"], r["either"]) for r in membership.answers(totals, ["s"], {"both": early & late, "either": early | late}).collect()}
    for s in "ab":
        a = set().union(*(v for (k, d), v in sets.items() if k == s and d < 50))
        b = set().union(*(v for (k, d), v in sets.items() if k == s and d >= 150))
        assert got[s] == (len(a & b), len(a | b))
    assert membership.per_group(membership.patterns(membership.members(membership.bitmaps(df.limit(0), ["s"], "x", "d"), ["s"]), ["s"]), ["s"]).count() == 0


def test_membership_below_zero(spark):
    df = spark.range(-200, 200).selectExpr("'x' as ident", "id as d")
    rows = membership.per_group(membership.patterns(membership.members(membership.bitmaps(df, [], "ident", "d"), []), []), []).collect()
    assert sorted(tuple(r) for r in rows) == [(d, 1) for d in range(-200, 200)]


@pytest.mark.parametrize("name", ["p5_across", "p5_combinations", "p5_merged"])
def test_records_before_1970_count(spark, tmp_path, name):
    import duckdb

    rng = random.Random(6)
    rows = [(i, rng.randint(-40, 10) * 86_400_000_000, f"h{rng.randint(0, 7)}", f"d{rng.randint(0, 40)}") for i in range(400)]
    rows += [(400 + i, -4 * 86_400_000_000, "busy", f"own{i}") for i in range(50)]  # a Sunday
    spark.createDataFrame(rows, "autoid bigint, stime_us bigint, saddr string, daddr string").coalesce(1).write.parquet(str(tmp_path / "argus.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW argus AS SELECT * FROM read_parquet('{tmp_path}/argus.parquet/*.parquet')")
    df = llm.queries[name](spark, str(tmp_path))
    got = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns, dtype=object)
    cur = con.execute(llm.sql[name])
    want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description], dtype=object)
    assert canon(got) == canon(want) and len(want)


# --- majority votes


def test_bounds_hold_and_heavy_values_are_found(spark):
    rng = random.Random(4)
    values = [f"h{i}" for i in range(20) for _ in range(60)] + [f"x{rng.randint(0, 5000)}" for _ in range(3000)] + [None] * 500
    rng.shuffle(values)
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)], "a string, b int").repartition(6).selectExpr("*", "1 as fld", "2 as item")
    count = Counter(v for v in values if v is not None)
    cells = votes.merge(votes.sketch(df, ["a"], rows=2, bits=6))
    for r in votes.bounds(cells).where("item is not null").collect():
        assert r["lower"] <= count[r["item"]] <= r["upper"] and r["n"] == 4200
    # tiny sketches collide a lot: what they cannot exclude is counted exactly
    for bits in (1, 3, 8):
        got = {(r["fld"], r["item"]): r["count"] for r in votes.frequent(df, ["a", "b"], 10_000, rows=2, bits=bits).collect()}
        want = {(0, v): n for v, n in count.items() if n * 100 >= 4200} | {(1, str(i)): sum(1 for j in range(len(values)) if j % 3 == i) for i in range(3)}
        assert got == want
    rare = {(r["fld"], r["item"]): r["count"] for r in votes.frequent(df, ["a", "b"], 300, rows=2, bits=9).collect()}
    assert rare == {(0, v): n for v, n in count.items() if n * 1_000_000 >= 300 * 4200} | {(1, str(i)): sum(1 for j in range(len(values)) if j % 3 == i) for i in range(3)}
    assert votes.bits_for(10_000) == 10 and votes.bits_for(100) == 16
    assert votes.frequent(df.limit(0), ["a"], 10_000).count() == 0


def test_merging_is_vote_cancellation():
    cell, at, left = votes._votes(np.array([1, 1, 1, 2, 2]), np.array([7, 8, 9, 7, 7]), np.array([10, 3, 2, 1, 1]))
    assert list(cell) == [1, 2] and list(left) == [5, 2] and at[0] == 0


# --- tokens and packing


def test_tokens_count_whole_texts(spark):
    texts = [None, "", "hello world", "<|endoftext|>", "naïve 日本語\r\n" * 50, "x" * 30_000]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(tokens.count_tokens("t")).collect()]
    encode = tokens._encoding(tokens.RANKS).encode_ordinary
    assert got == [len(encode(t)) if t else 0 for t in texts]
    assert got[2] == 2 and got[3] > 1


def brute_place(open_gaps, size, capacity):
    """The documented rule by trying every choice: least sum of squared counts, an open container first, tightest first."""
    def total(gaps):
        return sum(n * n for n in Counter(g for g in gaps if 0 < g < capacity).values())

    options = []
    for g in sorted({g for g in open_gaps if g >= size}):
        rest = list(open_gaps)
        rest.remove(g)
        options.append((total([*rest, g - size]), 0, g))
    options.append((total([*open_gaps, capacity - size]), 1, capacity))
    return min(options)[2]


@given(st.lists(st.integers(1, 12), min_size=1, max_size=60))
@settings(max_examples=80, deadline=None)
def test_placing_follows_the_sum_of_squares(sizes):
    packer, gaps = packing.Packer(12), {}
    for s in sizes:
        chosen = brute_place([g for g in gaps.values() if g > 0], s, 12)
        no = packer.place(s)
        assert gaps.get(no, 12) == chosen
        gaps[no] = gaps.get(no, 12) - s
        assert gaps[no] >= 0


def test_packing_keeps_every_item(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, 0, -3, rng.randint(1, 100), 100, 250, 300])) for i in range(800)] + [(5, 30), (5, 30), (None, 40)]
    df = spark.createDataFrame(rows, "doc bigint, n bigint").selectExpr("*", "1 as id", "2 as size", "3 as container")
    packed = packing.pack(df, "doc", "n", 100)
    got = packed.toPandas()
    sums = got.groupby("container").n.sum()
    assert sums.max() <= 100
    want = Counter()
    for d, n in rows:
        want[d] += max(n or 0, 0)
    have = Counter()
    for d, n in zip(got.doc, got.n):
        have[None if pd.isna(d) else int(d)] += int(n)
    assert have == want
    split = {int(d) for d in got[got.piece > 0].doc}
    assert split == {d for d, n in rows if n and n > 100}
    assert sums[sums > 0].mean() > 85
    assert packing.pack(df.limit(0), "doc", "n", 100).count() == 0
    assert {r[0] for r in packing.in_several(packed.where("doc is not null"), "doc").collect()} == {d for d, n in rows if d is not None and d != 5 and n and n > 100}
    order = ["doc", "piece", "n", "container"]
    other = packing.pack(df.repartition(7, "n"), "doc", "n", 100).toPandas()
    assert sorted(map(str, got[order].values.tolist())) == sorted(map(str, other[order].values.tolist()))


def test_shards_follow_the_number_of_items(spark, monkeypatch):
    df = spark.createDataFrame([(i, 1 + (i * 7919) % 90) for i in range(3000)], "doc bigint, n bigint")
    few = packing.pack(df, "doc", "n", 100, per_shard=500)
    assert few.rdd.getNumPartitions() == 6
    want = sorted(map(tuple, few.collect()))
    assert len({r[3] >> 32 for r in want}) == 6
    monkeypatch.setattr(packing, "MOST_TASKS", 2)
    several = packing.pack(df, "doc", "n", 100, per_shard=500)
    assert several.rdd.getNumPartitions() == 2 and sorted(map(tuple, several.collect())) == want


def test_whole_table_fill(spark):
    df = spark.createDataFrame([(i, 1 + (i * 7919) % 4000) for i in range(4000)], "doc bigint, n bigint")
    used = packing.fill(packing.pack(df, "doc", "n"), "n").first()["used"]
    assert used > 0.95


# --- mixture


def test_mixture(spark):
    rng = random.Random(8)
    docs = [(i, rng.choice(["A ", "a", "b", " B", "c", None, "other"]), rng.choice([None, 0, rng.randint(1, 500)])) for i in range(600)]
    targets = [("a", 0.5, 2), ("B", 0.3, 3), ("c", 0.15, 9), ("gone", 0.05, 4)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint").selectExpr("*", "1 as size", "2 as range", "3 as key", "4 as until")
    goal = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    order, report = mixture.mix(df, goal, {"a": -0.8, "b": 0.8}, digits=1)
    rows, rep = order.toPandas(), {r["source"]: r for r in report.collect()}
    size = Counter()
    for _, s, n in docs:
        if s and s.strip().lower() in ("a", "b", "c"):
            size[s.strip().lower()] += n or 0
    total = sum(size.values())
    for s, share, most in targets:
        s = s.lower()
        supply = min(share * total, most * size[s])
        used = rows[rows.source == s].tokens.sum()
        assert rep[s]["tokens"] == used and abs(rep[s]["demand"] - share * total) < 1e-6
        assert (rep[s]["ends_at"] < 1) == (share * total > most * size[s]) and abs(rep[s]["overshoot"] - max(0, used - share * total)) < 1e-6
        assert supply <= used < supply + 500 or used == 0 == size[s]
        assert rows[rows.source == s].groupby("doc_id").size().max() <= most if size[s] else True
    assert (np.diff(rows.position) >= 0).all() and rows.position.between(0, 1).all()
    assert (rows.until >= rows.position).all() and list(rows[["position", "source", "doc_id", "repeat"]].itertuples(index=False)) == sorted(rows[["position", "source", "doc_id", "repeat"]].itertuples(index=False))
    middle = {s: np.average(rows[rows.source == s].position / rep[s]["ends_at"]) for s in "ab"}
    assert middle["a"] < 0.5 < middle["b"]
    assert abs(sum(r["actual_share"] for r in rep.values()) - 1) < 1e-9
    order, report = mixture.mix(df.limit(0), goal)
    assert order.count() == 0 and report.count() == 4


def test_found_sources_come_from_sorted_positions(spark, sf):
    plan = llm.queries["p9_found"](spark, sf)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "rangepartitioning(position" in physical and "AS until" in physical


@pytest.mark.parametrize("tilt", [-1.0, -0.3, 0.0, 0.5, 1.0])
def test_position_inverts_the_integral(spark, tilt):
    df = spark.range(0, 1000).select((F.col("id") / 1000).alias("u")).withColumn("t", mixture.position(F.col("u"), F.lit(tilt))).toPandas()
    assert np.allclose((1 - tilt) * df.t + tilt * df.t**2, df.u)


# --- abusive content


@pytest.mark.parametrize(
    "disguised, word",
    [("іdіоt", "idiot"), ("i-d-i-o-t", "idiot"), ("id​iot", "idiot"), ("ïdïôt", "idiot"), ("1d10t", "idiot"), ("IDIOT", "idiot"), ("idiooooot", "idiot"), ("ｉｄｉｏｔ", "idiot"), ("$cumb4g", "scumbag")],
)
def test_disguises_are_undone(disguised, word):
    codes = toxicity._Codes()
    words = toxicity._WORD.findall(toxicity.plain(f"you {disguised} there"))
    assert codes[words[1]] == codes[word]


def _corpus(n, seed):
    rng = random.Random(seed)
    insults = [f"you {a} {b}" for a in ("worthless", "pathetic", "lying") for b in ("idiot", "bastard", "parasite")]
    neutral = ["kill the child process", "this damn parser", "my stupid mistake", "return the idiot_check value", "free the slave node"]
    texts, labels = [], []
    for _ in range(n):
        lines = [f"{rng.choice(['fix', 'add', 'drop'])} {rng.choice('abcdefgh')}{rng.randint(0, 99)} in parser" for _ in range(rng.randint(1, 12))] + [rng.choice(neutral)]
        case = rng.random() < 0.25
        if case:
            lines.insert(rng.randint(0, len(lines)), rng.choice(["# ", "+ ", ""]) + rng.choice(insults))
        texts.append("\n".join(lines))
        labels.append(case)
    return texts, np.array(labels)


def test_held_out_accuracy():
    texts, y = _corpus(900, 1)
    noisy = y ^ (np.random.default_rng(0).random(len(y)) < 0.05)
    weights, bias = toxicity.train(texts, noisy.astype(float), np.ones(len(y)))
    held, truth = _corpus(500, 2)
    p = toxicity.worst_passages([*held, None, "", "\n\n"], weights, bias, toxicity._Codes())
    assert (p[-3:] == 0).all()
    found = p[:-3] >= toxicity.THRESHOLD
    assert (found & truth).sum() / truth.sum() > 0.97 and (found & truth).sum() / found.sum() > 0.97
    assert np.count_nonzero(weights) < 2000


def test_long_texts_are_read_to_the_end():
    texts, y = _corpus(400, 3)
    weights, bias = toxicity.train(texts, y.astype(float), np.ones(len(y)))
    filler = "fix a1 in parser\n" * 60_000
    p = toxicity.worst_passages([filler, filler + "you worthless idiot"], weights, bias, toxicity._Codes())
    assert p[0] < toxicity.THRESHOLD <= p[1]


def test_nothing_is_passed_over_but_binary_patches():
    """Unbroken lines of any length are scored; encoded lines are only known below the head of a binary patch."""
    for n in range(21, 67):
        line = "kill-yourself-stupid!" + "x" * (n - 21)
        assert line[:16] in toxicity.plain(line) and toxicity._WORD.findall(toxicity.plain(line))
    assert "idiot" in toxicity.plain("diff --git a/idiot.c b/idiot.c")
    encoded = "z" + "aB3$x" * 13
    block = f"GIT binary patch\nliteral 104\n{encoded}\n{encoded}\n\nyou idiot\n{encoded}\n"
    assert toxicity.plain(block) == f"git binary patch\nyou idiot\n{encoded.lower()}\n"
    assert toxicity.plain(f"GIT binary patch\r\nliteral 52\r\n{encoded}") == "git binary patch\n"
    assert "stay" in toxicity.plain(f"GIT binary patch\nliteral 52\n{encoded}\nstay")


def test_passages_over_a_cut_count_whole(monkeypatch):
    texts, y = _corpus(400, 3)
    weights, bias = toxicity.train(texts, y.astype(float), np.ones(len(y)))
    text = ("fix a1 in parser, you worthless idiot and drop b2 in parser " * 40 + "\n") * 3 + "kill the child process. " * 50 + "you lying bastard"
    whole = toxicity.worst_passages([text, "you lying bastard", "x" * 500], weights, bias, toxicity._Codes())
    for size in (7, 20, 64, 300):
        monkeypatch.setattr(toxicity, "PIECE_CHARS", size)
        assert np.allclose(toxicity.worst_passages([text, "you lying bastard", "x" * 500], weights, bias, toxicity._Codes()), whole, atol=1e-9)


def test_few_labels_still_give_weights():
    texts, y = _corpus(60, 5)
    weights, bias = toxicity.train(texts, y.astype(float), np.ones(len(y)))
    held, truth = _corpus(300, 6)
    p = toxicity.worst_passages(held, weights, bias, toxicity._Codes())
    assert p.std() > 0.05 and (p[truth] >= toxicity.THRESHOLD).mean() > 0.9 and (p[~truth] >= toxicity.THRESHOLD).mean() < 0.05


def test_masked_letters():
    codes = toxicity._Codes()
    codes.weights = np.zeros(toxicity.MASK + 1)
    for word in ("bastard", "idiot"):
        codes.weights[toxicity._mix(np.array([codes[word]]), 1)] = 3.0
    assert codes["b*stard"] == codes["b*st*rd"] == codes["bastard"] and codes["id**t"] == codes["idiot"]
    assert codes["b**t**d"] not in (codes["bastard"], codes["idiot"])


def test_one_training_for_a_table(spark, sf, monkeypatch):
    from fluxmill.llm import queries as q

    q.MODELS.clear()
    calls, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *a: calls.append(1) or fit(*a))
    for name in ("p10_found", "p10_scores", "p10_rates"):
        llm.queries[name](spark, sf)
    assert len(calls) == 1


def test_fit_and_score(spark):
    texts, y = _corpus(500, 4)
    docs = spark.createDataFrame([(i, t, "S ") for i, t in enumerate(texts)] + [(None, None, None)], "doc_id bigint, text string, source string")
    marks = [(i, "r", int(v), random.Random(i).choice([None, 1, 2, 3])) for i, v in enumerate(y)] + [(3, "q", None, 1), (None, "q", 1, 1), (9, "q", int(y[9]), 2)]
    labels = spark.createDataFrame(marks, "doc_id bigint, rater string, toxic int, confidence int")
    model = toxicity.fit(docs, labels)
    scored = docs.select("doc_id", "source", toxicity.score("text", model).alias("score"))
    found = {r[0] for r in scored.where(F.col("score") >= toxicity.THRESHOLD).collect()}
    truth = {i for i, v in enumerate(y) if v}
    assert len(found & truth) > 0.95 * len(truth) and len(found - truth) < 0.05 * len(truth)
    rates = {r["source"]: r for r in toxicity.rates(scored, "source", "score").collect()}
    assert rates["s"]["docs"] == 500 and rates[None]["cases"] == 0
    empty = toxicity.fit(docs, labels.limit(0))
    assert docs.select(toxicity.score("text", empty).alias("s")).where(F.col("s") >= toxicity.THRESHOLD).count() == 0
