import struct
import time

from pyspark.sql import functions as F

from flowloom.operators import flows as FL
from flowloom.sources import capture

IP = {"a": b"\xc0\xa8\x01\x01", "b": b"\xc0\xa8\x01\x02", "x": b"\x08\x08\x08\x08"}


def ether(payload, kind=0x0800):
    return b"\x00" * 12 + struct.pack("!H", kind) + payload


def ipv4(src, dst, proto, body):
    return ether(struct.pack("!BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0) + src + dst + body)


def tcp(src, dst, sport, dport, flags, payload=b"", win=1000):
    return ipv4(src, dst, 6, struct.pack("!HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, win, 0, 0) + payload)


def udp(src, dst, sport, dport, payload=b""):
    return ipv4(src, dst, 17, struct.pack("!HHHH", sport, dport, 8 + len(payload), 0) + payload)


def dns_query(name):
    q = b"".join(bytes([len(p)]) + p.encode() for p in name.split(".")) + b"\x00"
    return struct.pack("!HHHHHH", 1, 0, 1, 0, 0, 0) + q + struct.pack("!HH", 1, 1)


def client_hello(name):
    host = name.encode()
    sni = struct.pack("!HBH", len(host) + 3, 0, len(host)) + host
    ext = struct.pack("!HH", 0, len(sni)) + sni + struct.pack("!HHHHH", 10, 6, 4, 29, 23) + struct.pack("!HHBB", 11, 2, 1, 0)
    body = struct.pack("!H", 771) + b"\x01" * 32 + b"\x00" + struct.pack("!HHH", 4, 4865, 4866) + b"\x01\x00" + struct.pack("!H", len(ext)) + ext
    hello = b"\x01" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack("!H", len(hello)) + hello


def arp(op):
    return ether(struct.pack("!HHBBH", 1, 0x0800, 6, 4, op) + b"\xaa" * 6 + IP["a"] + b"\xbb" * 6 + IP["b"], 0x0806)


def classic(frames, order="<", magic=0xA1B2C3D4):
    out = struct.pack(order + "IHHIIII", magic, 2, 4, 0, 0, 65535, 1)
    for ts, frame in frames:
        sec = int(ts)
        out += struct.pack(order + "IIII", sec, round((ts - sec) * (1e9 if magic == 0xA1B23C4D else 1e6)), len(frame), len(frame)) + frame
    return out


def blocks(frames):
    def block(kind, body):
        body += b"\x00" * (-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535))
    for ts, frame in frames:
        t = round(ts * 1e6)
        out += block(6, struct.pack("<IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(frame), len(frame)) + frame)
    return out


GET = b"GET / HTTP/1.1\r\nHost: example.com:8080\r\nUser-Agent: probe\r\n\r\n"
FRAMES = [
    (100.0, tcp(IP["a"], IP["b"], 12345, 80, 0x02)), (100.5, tcp(IP["b"], IP["a"], 80, 12345, 0x12, win=500)),
    (101.5, tcp(IP["a"], IP["b"], 12345, 80, 0x18, GET)), (101.25, tcp(IP["b"], IP["a"], 80, 12345, 0x11, b"ok")),
    (102.0, tcp(IP["a"], IP["x"], 5555, 443, 0x18, client_hello("www.example.org"))), (103.0, udp(IP["a"], IP["x"], 999, 53, dns_query("q.example.net"))),
    (104.0, arp(1)), (104.5, ipv4(IP["a"], IP["b"], 1, b"\x08\x00\x00\x00abcd")), (104.75, ipv4(IP["b"], IP["a"], 1, b"\x00\x00\x00\x00abcdef")), (105.0, b"\x00" * 14), (105.5, ether(b"\x45")),
]


def write(tmp_path, **files):
    for name, data in files.items():
        (tmp_path / f"{name}.pcap").write_bytes(data)
    return str(tmp_path)


def test_decode_all_formats(spark, tmp_path):
    path = write(tmp_path, little=classic(FRAMES), big=classic(FRAMES, ">"), nano=classic(FRAMES, "<", 0xA1B23C4D), blocks=blocks(FRAMES), junk=b"not a capture", tiny=b"\xd4")
    rows = capture.read_packets(spark, path)
    per_file = {r.file.rsplit("/", 1)[1]: r["count"] for r in rows.groupBy("file").count().collect()}
    assert per_file == {f"{n}.pcap": 9 for n in ("little", "big", "nano", "blocks")}
    assert rows.select("seq", F.round("ts", 4), "src_ip", "dst_port", "payload_len", "sni", "http_host", "arp_op").distinct().count() == 9
    hello = rows.where("sni is not null").first()
    assert (hello.sni, hello.tls_version, hello.tls_ciphers, hello.tls_extensions, hello.tls_groups, hello.tls_formats) == (
        "www.example.org", 771, [4865, 4866], [0, 10, 11], [29, 23], [0])
    assert rows.where("http_host = 'example.com:8080' and user_agent = 'probe' and is_request").count() == 4
    assert capture.arp_events(rows).first().sender_mac == "aa:aa:aa:aa:aa:aa"


def test_flows_from_capture(spark, tmp_path):
    rows = capture.ip_packets(capture.read_packets(spark, write(tmp_path, one=classic(FRAMES))))
    for size in (1, 2, 1000):
        flows = {r.protocol + str(r.dst_port): r for r in FL.build_flows(rows, rows_per_slice=size).collect()}
        assert set(flows) == {"TCP80", "TCP443", "UDP53", "ICMP0"}
        web = flows["TCP80"]
        assert (web.src_ip, web.src_port, web.packets_sent, web.packets_recv, web.bytes_sent, web.bytes_recv) == (
            "192.168.1.1", 12345, 2, 2, len(GET), 2)
        assert web.duration_ms == 1250 and web.application_layer == "HTTP" and web.http_hosts == ["example.com:8080"]
        # file order: gaps .5, 1.0, -.25; the answer's own gap is .75
        assert abs(web.iat_mean - 1.25 / 3) < 1e-6 and abs(web.iat_min + 0.25) < 1e-6 and abs(web.bwd_iat_total - 0.75) < 1e-6
        assert (web.syn_count, web.ack_count, web.psh_count, web.fin_count, web.init_win_fwd, web.init_win_bwd) == (2, 3, 1, 1, 1000, 500)
        assert (web.act_data_pkt_fwd, web.min_seg_size_fwd, web.fwd_header_len) == (1, 20, 40)
        tls = flows["TCP443"]
        assert tls.tls_sni == "www.example.org" and tls.application_layer == "TLS" and tls.is_external_dst
        import hashlib
        assert tls.ja3_hash == hashlib.md5(b"771,4865-4866,0-10-11,29-23,0").hexdigest()
        assert flows["UDP53"].dns_queries == ["q.example.net"] and flows["ICMP0"].application_layer == "ICMP"
        ping = flows["ICMP0"]  # requests and answers all count as sent
        assert (ping.packets_sent, ping.packets_recv, ping.bytes_sent, ping.bytes_recv, ping.fwd_iat_total) == (2, 0, 10, 0, 0.25)


def test_observables_and_display(spark, tmp_path):
    decoded = capture.read_packets(spark, write(tmp_path, one=classic(FRAMES)))
    seen = {(r.type, r.value): r.occurrence_count for r in FL.build_observables(capture.ip_packets(decoded)).collect()}
    assert seen[("domain", "example.com")] == 1 and seen[("ip", "192.168.1.1")] == 8 and seen[("user_agent", "probe")] == 1
    shown = {r.info: r for r in capture.display_rows(decoded).collect()}
    assert "HTTP TCP [SYN] len=0" in shown and "DNS query/response" in shown and "ICMP type=8" in shown
    assert shown["DNS query/response"].protocol == "DNS"


def test_flow_key_is_symmetric(spark):
    data = [("f", 1, "1.1.1.1", "2.2.2.2", 10, 20, "TCP"), ("f", 2, "2.2.2.2", "1.1.1.1", 20, 10, "TCP"), ("f", 3, "1.1.1.1", "1.1.1.1", 9, 5, "UDP"),
            ("f", 4, "1.1.1.1", "1.1.1.1", 5, 9, "UDP"), ("f", 5, "3.3.3.3", "1.1.1.1", 7, 8, "ICMP")]
    df = spark.createDataFrame(data, "file string, seq int, src_ip string, dst_ip string, src_port int, dst_port int, protocol string")
    keys = {r.seq: (r.lo_ip, r.lo_port, r.hi_ip, r.hi_port) for r in FL.with_flow_key(df).collect()}
    assert keys[1] == keys[2] and keys[3] == keys[4] and keys[5] == ("1.1.1.1", 0, "3.3.3.3", 0)


def test_chunks_and_inventory(spark, tmp_path):
    path = write(tmp_path, done=b"x" * 5, fresh=b"x" * 6, ready=b"x" * 7, empty=b"")
    import os
    old = time.time() - 100
    for name in ("done", "ready", "empty"):
        os.utime(tmp_path / f"{name}.pcap", (old, old))
    files = capture.read_files(spark, path)
    done = files.select("path").where("path like '%done%'")
    assert [r.path.rsplit("/", 1)[1] for r in capture.closed_chunks(files, done).collect()] == ["ready.pcap"]
    assert capture.inventory(files, 2).count() == 2 and capture.inventory_stats(files).first().files == 3  # Spark lists no empty files


def test_idle_sessions(spark):
    import datetime as dt
    t = dt.datetime(2026, 1, 1)
    rows = [("1.1.1.1", "2.2.2.2", 1, 443, "TCP", 100, t), ("1.1.1.1", "2.2.2.2", 1, 443, "TCP", 50, t + dt.timedelta(milliseconds=10)),
            ("1.1.1.1", "2.2.2.2", 1, 443, "TCP", 5, t + dt.timedelta(seconds=20))]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, src_port int, dst_port int, protocol string, length bigint, time timestamp")
    first = FL.idle_flows(df).orderBy("start_time").first()
    assert (first.bytes_sent, first.packets_sent, first.bytes_recv, first.duration_ms, FL.idle_flows(df).count()) == (150, 2, 150, 10, 2)
