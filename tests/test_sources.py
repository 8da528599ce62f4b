"""Readers, writers and the streaming forms against their batch results."""

import struct

import pytest
from fluxmill.operators import bins, cluster
from fluxmill.operators import sessions as S
from fluxmill.sources import formats, sinks
from fluxmill.sources.flows import clean, flows
from fluxmill.streaming import flows as live
from pyspark.sql import functions as F


def test_text_with_titles(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("StartTime|Dur|Proto|SrcAddr|Sport|DstAddr|Dport|SrcPkts|Unknown\n1378080000.5|1.25|tcp|10.0.0.1|1024|192.0.2.1|https|3|x\n2013/09/02.00:00:01|bad|17|2001:db8::1|0x0035||99999x|-1|\n")
    a, b = formats.read_text(spark, str(p), "|").orderBy("stime_us").collect()
    assert (a["stime_us"], a["ltime_us"], a["proto"], a["saddr_i"], a["dport"], a["spkts"]) == (1378080000500000, 1378080001750000, 6, 167772161, 443, 3)
    assert (b["stime_us"], b["dur"], b["proto"], b["saddr_i"], b["sport"], b["dport"]) == (1378080001000000, None, 17, None, 53, None)
    assert [f.name for f in formats.FLOW_SCHEMA] == formats.read_text(spark, str(p), "|").columns


def test_json_and_compressed_text(spark, tmp_path):
    import gzip

    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"saddr":"10.0.0.1","spkts":7,"stime":"1378080000"}\nbroken\n')
    rows = formats.read_json(spark, str(tmp_path / "j")).where("saddr is not null").collect()
    assert len(rows) == 1 and rows[0]["spkts"] == 7 and rows[0]["stime_us"] == 1378080000000000
    with gzip.open(tmp_path / "t.csv.gz", "wt") as f:
        f.write("SrcAddr,DstBytes\n10.0.0.2,5\n")
    assert formats.read_text(spark, str(tmp_path / "t.csv.gz")).first()["dbytes"] == 5


def test_connection_log(spark, tmp_path):
    p = tmp_path / "conn.log"
    p.write_text("#separator \\x09\n#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tservice\tduration\torig_pkts\n#types\ttime\tstring\n1378080000.000001\tC1\t10.0.0.1\t55\t10.0.0.2\t53\tudp\tdns\t-\t2\n")
    r = formats.read_conn_log(spark, str(p)).first()
    assert (r["stime_us"], r["proto"], r["dport"], r["spkts"], r["dur"], r["label"]) == (1378080000000001, 17, 53, 2, None, '{"uid":"C1","service":"dns"}')


def test_router_export(spark, tmp_path):
    head = formats.V5_HEADER.pack(5, 2, 60_000, 1_378_080_000, 500_000_000, 77, 0, 0, 0)
    rec = lambda s, p: formats.V5_RECORD.pack(s, 0xC0000201, 0, 0, 0, p, p * 100, 10_000, 20_000, 1024, 443, 0, 0x12, 6, 0, 64512, 0, 24, 24, 0)
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.bin").write_bytes(head + rec(0x0A000001, 3) + rec(0x0A000002, 4) + head[:10])
    got = formats.read_export(spark, str(tmp_path / "x")).orderBy("saddr").collect()
    assert [(r["saddr"], r["daddr"], r["spkts"], r["sbytes"], r["status"], r["sas"]) for r in got] == [("10.0.0.1", "192.0.2.1", 3, 300, 5, 64512), ("10.0.0.2", "192.0.2.1", 4, 400, 5, 64512)]
    assert got[0]["ltime_us"] - got[0]["stime_us"] == 10_000_000 and got[0]["stime_us"] == 1_378_080_000_500_000 - 50_000_000


def test_dns(spark):
    q = b"\x03www\x07example\x03com\x00"
    msg = struct.pack("!HHHHHH", 9, 0x8180, 1, 2, 0, 0) + q + struct.pack("!HH", 1, 1) + b"\xc0\x0c" + struct.pack("!HHIH", 5, 1, 60, 6) + b"\x03web\xc0\x10" + b"\xc0\x2d" + struct.pack("!HHIH", 1, 1, 30, 4) + b"\xc0\x00\x02\x01"
    df = spark.createDataFrame([(0, bytearray(msg)), (1, bytearray(b"junk")), (2, None), (3, bytearray(msg[:-6]))], "i int, m binary")
    got = [r[0] for r in df.orderBy("i").select(formats.dns("m")).collect()]
    assert got[0]["qname"] == "www.example.com" and [(a["type"], a["value"]) for a in got[0]["answers"]] == [(5, "web.example.com"), (1, "192.0.2.1")]
    assert all(g is None or g["qname"] is None for g in got[1:])
    parts = spark.createDataFrame([("WWW.Example.com.",), ("local",)], "n string").select(formats.domain_parts("n").alias("p")).select("p.*").collect()
    assert [tuple(p) for p in parts] == [("www.example.com", "example.com", "com"), ("local", None, "local")]


@pytest.mark.parametrize("form", ["csv", "json", "parquet", "xml"])
def test_writers(spark, make_flows, tmp_path, form):
    df = make_flows([{"saddr": "10.0.0.1", "suser": bytearray(b"x")}, {}]).select("autoid", "saddr")
    sinks.write_text(df, str(tmp_path / form), form)
    reader = spark.read.option("rowTag", "record").format(form) if form == "xml" else spark.read.option("header", True).format(form)
    assert reader.load(str(tmp_path / form)).count() == 2


def test_split_and_filtered_outputs(spark, sf, tmp_path):
    f = flows(spark, sf)
    sinks.write_split(f, str(tmp_path / "s"), "hour", ("proto",), max_records=500)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == f.count() and {"date", "hour", "proto"} <= set(back.columns)
    sinks.write_filtered(f, {str(tmp_path / "tcp"): "tcp", str(tmp_path / "dns"): "port domain"}, str(tmp_path / "rest"))
    n = {k: spark.read.parquet(str(tmp_path / k)).count() for k in ("tcp", "dns", "rest")}
    assert n["tcp"] == f.where("proto = 6").count() and n["rest"] == f.where("not coalesce(proto = 6, false) and not (coalesce(proto in (6, 17), false) and (coalesce(sport = 53, false) or coalesce(dport = 53, false)))").count()


def test_upsert_and_delete(spark, tmp_path):
    path, combine = str(tmp_path / "t"), {"n": F.sum, "last": F.max}
    sinks.write_upsert(spark, path, spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "k string, n bigint, last int"), ["k"], combine)
    sinks.write_upsert(spark, path, spark.createDataFrame([("a", 10, 4), ("c", 3, 1)], "k string, n bigint, last int"), ["k"], combine)
    now = sinks.read_upserted(spark, path)
    assert sorted(map(tuple, now.collect())) == [("a", 11, 5), ("b", 2, 6), ("c", 3, 1)]
    assert sinks.delete(now, now.where("k = 'b'"), ["k"]).count() == 2


def test_time_index(spark, sf):
    f = flows(spark, sf)
    index = sinks.time_index(f)
    assert index.agg(F.sum("n")).first()[0] == f.where("stime_us is not null").count()
    s = index.agg(F.min("second")).first()[0]
    assert sinks.files_between(index, s, s).count() == 1 and sinks.files_between(index, 0, 1).count() == 0
    assert sinks.read_indexed(index, s, s + 60).count() == f.where(f"stime_us between {s * 1_000_000} and {s * 1_000_000 + 60_999_999}").count() > 0 == sinks.read_indexed(index, 0, 1).count()
    with pytest.raises(ValueError):
        sinks.read_indexed(index, s, s, most=0)


def test_keyed_table(spark, sf, tmp_path):
    f = flows(spark, sf).repartition(4)
    sinks.write_keyed(f, str(tmp_path / "k"), ["saddr", "daddr"])
    back = spark.read.parquet(str(tmp_path / "k"))
    assert back.columns == ["autoid", "saddr", "daddr", "record"] and back.count() == f.count() == back.select("autoid").distinct().count()
    assert back.select(F.get_json_object("record", "$.sid")).distinct().count() == f.select("sid").distinct().count()


def test_logs_with_different_columns(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.log").write_text("#fields\tts\tid.orig_h\tproto\tid.resp_p\n1378080000.5\t10.0.0.1\ttcp\t443\n")
    (tmp_path / "l" / "b.log").write_text("#fields\tid.resp_p\tproto\tts\tuid\tid.orig_h\n53\tudp\t1378080001\tC2\t10.0.0.2\n-\t-\t1378080002\tC3\t-\n")
    got = formats.read_conn_log(spark, str(tmp_path / "l")).orderBy("stime_us").collect()
    assert [(r["saddr"], r["proto"], r["dport"], r["label"]) for r in got] == [("10.0.0.1", 6, 443, None), ("10.0.0.2", 17, 53, '{"uid":"C2"}'), (None, None, None, '{"uid":"C3"}')]


def test_exports_are_read_to_the_end_or_refused():
    head = formats.V5_HEADER.pack(5, 0, 0, 0, 0, 1, 0, 0, 0)
    assert list(formats.decode_export(head + bytes(40))) == [] and list(formats.decode_templates(bytes(64))) == []
    for bad in (head + struct.pack("!HH", 4, 1) + bytes(30), formats.V8_HEADER.pack(8, 1, 0, 0, 0, 0, 0, 0, 99, 0, 0) + bytes(40)):
        with pytest.raises(ValueError):
            list(formats.decode_export(bad))
    with pytest.raises(ValueError):
        list(formats.decode_templates(struct.pack("!HH", 5, 1) + bytes(40)))


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from fluxmill.session import shared_folder

    conf = SimpleNamespace(get=lambda k, d=None: d)
    with pytest.raises(RuntimeError):
        shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x")))
    assert shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]", applicationId="x"))).endswith("/x")
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


# --- streams


def run(q_df, name, mode="append"):
    q = q_df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return q_df.sparkSession.table(name)


@pytest.fixture(scope="module")
def stream_dir(spark, sf, tmp_path_factory):
    """The stored flows in order of start, in several files, and one far later record that lets every watermark pass."""
    at = str(tmp_path_factory.mktemp("stream"))
    f = spark.read.parquet(f"{sf}/argus.parquet").where("stime is not null").orderBy("stime").limit(1500)
    f.coalesce(1).write.mode("append").parquet(at)
    last = f.orderBy(F.desc("stime")).limit(1).withColumns({"stime": F.col("stime") + F.expr("interval 90 days"), "stime_us": F.col("stime_us") + 90 * 86_400_000_000, "ltime_us": F.lit(None).cast("bigint"), "saddr": F.lit("late"), "sid": F.lit("late")})
    import time

    time.sleep(1.1)
    last.coalesce(1).write.mode("append").parquet(at)
    return at, clean(f)


def test_streaming_bins_equal_batch(spark, stream_dir):
    at, f = stream_dir
    got = run(live.time_bins(live.read_stream(spark, at, 1), "1 hour", "10 minutes", ["proto"]), "bins")
    want = bins.time_bins(f, "1h", ["proto"], "nomodify").select("bin_us", "proto", F.col("trans").alias("n"), "spkts", "dpkts", "sbytes", "dbytes")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_streaming_sessions_equal_batch(spark, stream_dir):
    at, f = stream_dir
    got = run(live.stream_sessions(live.read_stream(spark, at, 1), "saddr", "stime", 1800, "1 hour", ("spkts",)), "sessions")
    want = S.sessions(f, "saddr", "stime_us", 1800, ("spkts",))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_streaming_distinct_and_reports(spark, stream_dir):
    at, f = stream_dir
    assert run(live.distinct_records(live.read_stream(spark, at, 1), "60 days"), "distincts").count() == f.select("sid", "seq").distinct().count() + 1
    got = run(live.status_reports(live.read_stream(spark, at, 1), ["saddr", "daddr"], 300, 600), "reports")
    keyed = f.where("saddr is not null and daddr is not null")
    assert got.agg(F.sum("n")).first()[0] == keyed.count()
    assert {r[0] for r in got.select("reason").distinct().collect()} == {"status", "idle"}


def test_streaming_outputs(spark, stream_dir, tmp_path):
    at, f = stream_dir
    closed = []
    live.run_available(live.split_files(live.read_stream(spark, at), str(tmp_path / "o"), str(tmp_path / "c1"), lambda p, n: closed.append(p)))
    assert sum(spark.read.parquet(p).count() for p in closed) == 1501
    live.run_available(live.fan_out(live.read_stream(spark, at), {"tcp": "tcp", "rest": "not tcp"}, str(tmp_path / "f"), str(tmp_path / "c2")))
    assert spark.read.parquet(str(tmp_path / "f/tcp")).count() == f.where("proto = 6").count() + spark.read.parquet(at).where("saddr = 'late' and proto = 6").count()
    seen = []
    live.run_available(live.top_k(live.read_stream(spark, at), "saddr", 3, "30 days", lambda b, n: seen.append(b.count()), str(tmp_path / "lists")).option("checkpointLocation", str(tmp_path / "c3")))
    assert 3 in seen and max(seen) == 3


def test_an_idle_heavy_key_stays_in_the_top_list(spark, make_flows, tmp_path):
    import time

    at, lists = str(tmp_path / "in"), []
    for batch in ([("heavy", 1000), ("a", 5), ("b", 4)], [("a", 1), ("b", 9)], [("c", 2)]):
        make_flows([{"saddr": k, "sbytes": n, "stime_us": 10**15} for k, n in batch]).coalesce(1).write.mode("append").parquet(at)
        time.sleep(0.05)
    live.run_available(live.top_k(live.read_stream(spark, at, 1), "saddr", 2, "1 day", lambda b, n: lists.append([(r["saddr"], r["bytes"]) for r in b.collect()]), str(tmp_path / "l")).option("checkpointLocation", str(tmp_path / "c")))
    assert lists[:3] == [[("heavy", 1000), ("a", 5)], [("heavy", 1000), ("b", 13)], [("heavy", 1000), ("b", 13)]]


def test_polling(spark):
    import time

    got = []
    q = live.poll(spark, lambda: spark.range(3), "1 second", lambda df, n: got.append((n, df.count())), times=2).start()
    until = time.time() + 40
    while len(got) < 2 and time.time() < until:
        time.sleep(0.2)
    q.stop()
    assert got == [(0, 3), (1, 3)]


def test_stream_join(spark, stream_dir, tmp_path):
    at, f = stream_dir
    ev = f.where("dport is not null").limit(5).select("sid", F.col("stime").alias("ts"), "proto", F.col("dport").alias("port"), F.lit("prog").alias("prog"))
    ev.write.parquet(str(tmp_path / "ev"))
    events = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    got = run(live.events_with_flows(live.read_stream(spark, at), events, "5 minutes"), "joined")
    assert got.count() >= 5 and got.where("abs(unix_micros(stime) - unix_micros(ts)) > 300000000").count() == 0


def test_empty_bins_of_a_batch(spark):
    df = spark.createDataFrame([(0, 1), (30, 2)], "bin_us bigint, n bigint")
    assert [tuple(r) for r in live.with_empty_bins(df, 10).orderBy("bin_us").collect()] == [(0, 1), (10, 0), (20, 0), (30, 2)]


def test_one_pass_per_file(spark, sf):
    assert cluster.cluster(flows(spark, sf), "all").count() == 1
