"""Template exports, packet samples, xz text, time-named tables, payload decoders and Python helpers."""

import json
import lzma
import struct
from datetime import UTC, datetime

import numpy as np
from fluxmill.functions import decoders, interop
from fluxmill.sources import formats
from pyspark.sql import functions as F


def v9_packet(sets, count, uptime=60_000, sec=1_378_080_000):
    return struct.pack("!HHIIII", 9, count, uptime, sec, 5, 1) + b"".join(struct.pack("!HH", k, 4 + len(b)) + b for k, b in sets)


def test_template_export(spark, tmp_path):
    fields = [(8, 4), (12, 4), (7, 2), (11, 2), (4, 1), (6, 1), (2, 4), (1, 4), (22, 4), (21, 4), (99, 2)]
    template = struct.pack("!HH", 256, len(fields)) + b"".join(struct.pack("!HH", *f) for f in fields)
    row = struct.pack("!IIHHBBIIIIH", 0x0A000001, 0x0A000002, 1024, 443, 6, 2, 3, 300, 10_000, 20_000, 7)
    six = struct.pack("!HH", 257, 3) + b"".join(struct.pack("!HH", *f) for f in [(27, 16), (4, 1), (2, 2)])
    data = v9_packet([(256, row)], 1) + v9_packet([(0, template + six), (256, row + row)], 4) + v9_packet([(257, b"\x20\x01\x0d\xb8" + bytes(11) + b"\x01" + b"\x11" + b"\x00\x09")], 1)
    (tmp_path / "a.v9").write_bytes(data + b"\x00\x09\x00")
    got = formats.read_decoded(spark, str(tmp_path / "a.v9"), "templates").orderBy("saddr").collect()
    assert [(r["saddr"], r["proto"], r["dport"], r["spkts"]) for r in got] == [("10.0.0.1", 6, 443, 3)] * 2 + [("2001:db8::1", 17, None, 9)]
    assert got[0]["dur"] == 10.0 and got[0]["status"] == 1 and got[2]["stime_us"] is None


def test_packet_samples(spark, tmp_path):
    frame = bytes(12) + b"\x81\x00\x00\x05\x08\x00" + bytes([0x45, 0, 0, 40]) + bytes(5) + bytes([6]) + bytes(2) + struct.pack("!II", 0x0A000001, 0xC0000201) + struct.pack("!HH", 1234, 80) + bytes(9) + b"\x02" + bytes(6)
    record = struct.pack("!IIII", 1, 1500, 4, len(frame)) + frame
    sample = struct.pack("!IIIIIIII", 1, 0, 512, 0, 0, 0, 0, 1) + struct.pack("!II", 1, len(record)) + record
    pkt = struct.pack("!II", 5, 1) + bytes(4) + struct.pack("!IIII", 0, 7, 90_000, 2) + struct.pack("!II", 2, 4) + bytes(4) + struct.pack("!II", 1, len(sample)) + sample
    (tmp_path / "s").write_bytes(struct.pack("!I", len(pkt)) + pkt + struct.pack("!I", 500) + pkt[:30])
    got = formats.read_decoded(spark, str(tmp_path / "s"), "samples").collect()
    assert [(r["saddr"], r["daddr"], r["sport"], r["dport"], r["spkts"], r["sbytes"], r["status"]) for r in got] == [("10.0.0.1", "192.0.2.1", 1234, 80, 512, 768_000, 1)]


def test_xz_text(spark, tmp_path):
    with lzma.open(tmp_path / "a.csv.xz", "wt") as f:
        f.write("SrcAddr,SrcPkts\n10.0.0.1,4\n10.0.0.2,x\n")
    assert [(r["saddr"], r["spkts"]) for r in formats.read_xz_text(spark, str(tmp_path / "a.csv.xz")).orderBy("saddr").collect()] == [("10.0.0.1", 4), ("10.0.0.2", None)]


def test_time_named_tables(spark, make_flows, tmp_path):
    us = lambda d, h: int(datetime(2013, 9, d, h, tzinfo=UTC).timestamp() * 1_000_000)
    for d in (1, 2, 4):
        make_flows([{"stime_us": us(d, h), "proto": 6 if h else 17} for h in (0, 5, 20)]).write.parquet(str(tmp_path / f"day_2013_09_{d:02d}"))
    got = formats.read_named_tables(spark, str(tmp_path / "day_%Y_%m_%d"), datetime(2013, 9, 1, 3, tzinfo=UTC), datetime(2013, 9, 4, 4, tzinfo=UTC), "proto = 6")
    assert got.count() == 4
    assert formats.read_named_tables(spark, str(tmp_path / "none_%Y"), datetime(2013, 9, 1, tzinfo=UTC), datetime(2013, 9, 2, tzinfo=UTC)).count() == 0


def test_decoders(spark):
    @decoders.decoder("fails")
    def _(data):
        raise RuntimeError

    rows = [b"GET /a b HTTP/1.1\r\nHost: x\r\n", b"HTTP/1.1 404 Not Found\r\n", b"SSH-2.0-thing\r\n", b"\x16\x03\x01\x00\x05\x01", b"noise", None, b""]
    df = spark.createDataFrame([(i, r and bytearray(r)) for i, r in enumerate(rows)], "i int, p binary")
    got = [r[0] and json.loads(r[0]) for r in df.orderBy("i").select(decoders.decode("p")).collect()]
    assert got[0] == {"decoder": "http", "method": "GET", "target": "/a b"} and got[1]["status"] == 404 and got[2]["banner"] == "SSH-2.0-thing" and got[3] == {"decoder": "tls", "version": "3.1", "handshake": 1}
    assert got[4:] == [None] * 3
    del decoders.DECODERS["fails"]


def test_interop(spark, make_flows):
    assert interop.seconds("2013/09/02", datetime(2013, 9, 9, tzinfo=UTC)) == (1378080000.0, 1378166400.0)
    a, b = make_flows([{"saddr": "x"}, {"saddr": "y"}, {}]), make_flows([{"saddr": "y"}])
    assert list(interop.match(a, b, ["saddr"])) == [-2, 2, -2]
    assert interop.critic(np.ones((2, 3)), np.zeros((2, 3))) == 1.0
    got = spark.createDataFrame([(1378080000123456,)], "t bigint").select(interop.strftime("t", "%Y%%/%m at %T.%f %s"), F.lit(1)).first()[0]
    assert got == "2013%/09 at 00:00:00.123456 1378080000"


def test_older_exports(spark, tmp_path):
    head = lambda v, n, last: struct.pack("!HHIIII", v, n, 60_000, 1_378_080_000, 0, 9) + last
    v6 = head(6, 1, bytes(4)) + formats.V6_RECORD.pack(0x0A000001, 0x0A000002, 0, 0, 0, 3, 300, 1000, 2000, 5, 6, 0, 2, 6, 1, 7, 8, 24, 24, 0, 0, 0)
    v8 = b"".join(
        head(8, 1, bytes([0, 0, method, 2]) + bytes(4)) + formats.V8_RECORDS[method][0].pack(2, 10, 999, 1000, 3000, *rest)
        for method, rest in ((1, (64500, 64501, 0, 0)), (2, (17, 0, 0, 53, 99)), (3, (0x0A000000, 8, 0, 64500, 0, 0)), (4, (0xC0000200, 24, 0, 64501, 0, 0)), (5, (0x0A000000, 0xC0000200, 24, 8, 0, 1, 2, 0, 0)))
    )
    (tmp_path / "x").write_bytes(v6 + v8 + head(8, 1, bytes([0, 0, 99, 2]) + bytes(4)))
    got = formats.read_export(spark, str(tmp_path / "x")).collect()
    seen = [(r["saddr"], r["daddr"], r["proto"], r["sport"], r["dport"], r["spkts"], r["sbytes"], r["sas"], r["das"]) for r in got]
    assert seen == [
        ("10.0.0.1", "10.0.0.2", 6, 5, 6, 3, 300, 7, 8), (None, None, None, None, None, 10, 999, 64500, 64501), (None, None, 17, 53, 99, 10, 999, None, None),
        ("10.0.0.0", None, None, None, None, 10, 999, 64500, None), (None, "192.0.2.0", None, None, None, 10, 999, None, 64501), ("10.0.0.0", "192.0.2.0", None, None, None, 10, 999, 1, 2),
    ]
    assert got[0]["status"] == 1 and got[0]["dur"] == 1.0 and got[1]["dur"] == 2.0


def test_archive_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("#:unix_secs,unix_nsecs,sysuptime,exaddr,dpkts,doctets,first,last,srcaddr,dstaddr,nexthop,srcport,dstport,prot,tos,tcp_flags,src_as,dst_as\n1378080000,5000,1,192.0.2.9,3,300,1000,2500,10.0.0.1,10.0.0.2,0.0.0.0,5,443,6,0,2,7,8\n")
    r = formats.read_archive_text(spark, str(tmp_path / "a.csv")).first()
    assert (r["stime_us"], r["dur"], r["ltime_us"], r["sid"], r["spkts"], r["saddr"], r["dport"], r["das"]) == (1378080000000005, 1.5, 1378080001500005, "192.0.2.9", 3, "10.0.0.1", 443, 8)


def test_more_payload_decoders(spark):
    import json

    from fluxmill.functions import decoders

    dhcp = bytes([1, 1, 6, 0]) + bytes(12) + bytes([10, 0, 0, 9]) + bytes(8) + bytes([2, 0, 0, 0, 0, 7]) + bytes(202) + b"\x63\x82\x53\x63"
    samples = {
        b"INVITE sip:a@b SIP/2.0\r\n": ("sip", "INVITE"), b"SIP/2.0 200 OK\r\n": ("sip", 200), b"DESCRIBE rtsp://x RTSP/1.0\r\n": ("rtsp", "DESCRIBE"), b"EHLO me\r\n": ("mail", "smtp"), b"220 ready\r\n": ("mail", 220), b"<34>Oct": ("syslog", 4),
        bytes([0x23, 2]) + bytes(46): ("ntp", 4), dhcp: ("dhcp", "10.0.0.9"), b"\x30\x20\x02\x01\x01\x04\x06public\xa0": ("snmp", "public"), b"\0\x01boot.img\0octet\0": ("tftp", "boot.img"), bytes(4) + b"\xfeSMB": ("smb", 2), b"\xff" * 16 + b"\0\x1d\x01": ("bgp", 1),
    }
    rows = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(samples)], "i int, d binary").orderBy("i").select(decoders.decode("d")).collect()
    for (name, value), row in zip(samples.values(), rows):
        got = json.loads(row[0])
        assert got["decoder"] == name and value in got.values()
    junk = spark.createDataFrame([(bytearray(b"hello-0d"),), (bytearray(b"0\x00\xcf\x07\r"),), (bytearray(),), (None,)], "d binary")
    assert [r[0] for r in junk.select(decoders.decode("d")).collect()] == [None] * 4
