"""Capture files decoded range by range equal the plain reading from the first byte to the last."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from flowloom.sources import capture
from flowloom.sources import ranges as RG
from tests.test_flows_and_capture import FRAMES, IP, arp, blocks, classic, client_hello, dns_query, ether, tcp, udp, write

SHOWN = ["seq", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "payload_len", "header_len", "tcp_flags", "win", "first_byte", "is_request",
         "sni", "http_host", "user_agent", "dns_qnames", "icmp_type", "arp_op", "sender_mac", "frame_len", "skipped"]


def _frames(n, seed):
    rng = random.Random(seed)
    kinds = [
        lambda: tcp(IP["a"], IP["b"], rng.randrange(65536), 80, rng.randrange(64), rng.randbytes(rng.randrange(300))),
        lambda: udp(IP["a"], IP["x"], 999, 53, dns_query(f"q{rng.randrange(9)}.example.net")),
        lambda: tcp(IP["a"], IP["x"], 5555, 443, 0x18, client_hello("www.example.org")), lambda: arp(rng.randrange(1, 3)),
        lambda: b"\x00" * rng.randrange(20), lambda: ether(b"\x45"), lambda: ether(b"\x45" + bytes(19) + b"\x01", 0x8100),
        # a capture inside a payload: its records must not be taken for the outer ones
        lambda: udp(IP["a"], IP["b"], 1, 2, classic(FRAMES[:4])[24:] * 3)]
    return [(1000 + i * 0.25, rng.choice(kinds)()) for i in range(n)]


def _swapped(frames):
    """A section in big-endian order with a resolution of 2^-10 s."""
    def block(kind, body):
        body += b"\x00" * (-len(body) % 4)
        return struct.pack(">II", kind, len(body) + 12) + body + struct.pack(">I", len(body) + 12)

    out = block(0x0A0D0D0A, struct.pack(">IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack(">HHI", 1, 0, 65535) + struct.pack(">HHB3xHH", 9, 1, 0x8A, 0, 0))
    for ts, frame in frames:
        t = round(ts * 1024)
        out += block(6, struct.pack(">IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(frame), len(frame)) + frame)
    return out


def _rows(decoded):
    return sorted((tuple(map(str, r)) for r in decoded.select("file", *SHOWN).collect()))


@pytest.fixture
def files(spark, tmp_path):
    frames = _frames(240, 3)
    nested = [(1000 + i, udp(IP["a"], IP["b"], 1, 2, classic(_frames(60, i))[24:])) for i in range(5)]
    # more sections with interfaces of their own, one of them in the other byte order
    two = blocks(frames[:100]) + blocks(frames[100:170]) + _swapped(frames[170:])
    path = write(tmp_path, little=classic(frames), big=classic(frames, ">"), nano=classic(frames, "<", 0xA1B23C4D), blocks=two, nested=classic(nested),
                 cut=classic(frames)[:-30], empty=classic([]), junk=b"not a capture at all" * 30)
    return capture.read_files(spark, path)


@pytest.mark.parametrize("size", [900, 7777])
def test_ranges_equal_the_whole_file(files, size):
    whole = _rows(capture.decode_files(files, 1 << 30))
    assert len(whole) > 1100
    assert [r[1:3] for r in whole if "blocks" in r[0] and r[1] == "239"] == [("239", "1059.75")]
    assert _rows(capture.decode_files(files, size)) == whole


def test_every_range_begins_where_the_one_before_leads(files):
    rows = RG.index(files, 2048).orderBy("path", "lo").collect()
    for path in {r.path for r in rows}:
        own = [r for r in rows if r.path == path]
        if own[0].start < 0:
            assert all(r.start < 0 for r in own)  # no capture
            continue
        at = own[0].start
        for r in own:
            assert r.start == (at if at < r.hi else -1)
            at = r.stop if r.start >= 0 else at


def test_wrong_guesses_are_repaired(spark, files, monkeypatch):
    """A guess that is always wrong costs passes, not rows."""
    import flowloom.sources.ranges as ranges

    small = files.where(F.col("path").contains("little"))
    whole = _rows(capture.decode_files(small, 1 << 30))
    found = RG.index(small, 4096)
    wrong = found.withColumn("start", F.when(F.col("lo") > 0, F.col("start") + 1).otherwise(F.col("start"))).withColumn(
        "stop", F.when(F.col("lo") > 0, F.col("stop") + 5).otherwise(F.col("stop")))
    real, calls = ranges._indexed, []

    def indexed(rows):
        calls.append(1)
        return wrong if len(calls) == 1 else real(rows)

    monkeypatch.setattr(ranges, "_indexed", indexed)
    assert _rows(capture.decode_files(small, 4096)) == whole and len(calls) > 1


def test_skipped_packets_are_counted_by_reason(spark, tmp_path):
    frames = [(1.0, b"\x00" * 5), (2.0, ether(b"\x45")), (3.0, ether(b"x" * 40, 0x86DD)), (4.0, arp(1)[:30]), (5.0, tcp(IP["a"], IP["b"], 1, 2, 2)[:40]),
              (6.0, tcp(IP["a"], IP["b"], 1, 2, 2)), (7.0, ether(b"\x00\x01", 0x8100))]
    decoded = capture.decode_files(capture.read_files(spark, write(tmp_path, one=classic(frames))))
    assert {r.reason: r.frames for r in capture.skipped_packets(decoded).collect()} == {
        "short_frame": 2, "short_ip": 1, "not_ip": 1, "short_arp": 1, "short_transport": 1}
    assert decoded.where("skipped is null").count() == 1


def test_tables_of_frames(spark):
    rows = [("t", i, ts, len(f), f) for i, (ts, f) in enumerate(_frames(200, 9))] + [("t", 900, 1.0, 0, None), ("t", None, None, None, b"")]
    table = spark.createDataFrame(rows, "file string, seq int, ts double, frame_len int, frame binary")
    assert capture.decode_frames(table.repartition(4)).count() == 202
    assert capture.decode_frames(table.limit(0)).count() == 0
    assert capture.decode_frames(table.where("seq = 900")).first().skipped == "short_frame"


def test_vlan_tags_and_addresses(spark):
    tagged = b"\x00" * 12 + struct.pack("!HHHH", 0x88A8, 1, 0x8100, 2) + udp(IP["a"], IP["x"], 999, 4, b"abc")[12:]
    row = capture.decode_frames(spark.createDataFrame([("t", 1, 1.0, 9, tagged)], "file string, seq int, ts double, frame_len int, frame binary")).first()
    assert (row.src_ip, row.dst_ip, row.src_port, row.dst_port, row.payload_len, row.protocol) == ("192.168.1.1", "8.8.8.8", 999, 4, 3, "UDP")
