"""Rules over all flows: one pass where several rules need the same, and the same rows as each rule alone."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowloom.functions import net, text
from flowloom.operators import findings as FI
from flowloom.operators import rules as R

FLOW = ("flow_id bigint, src_ip string, dst_ip string, dst_port bigint, protocol string, start_time timestamp, duration_ms bigint, "
        "bytes_sent bigint, bytes_recv bigint, application_layer string, dns_queries array<string>, http_hosts array<string>, tls_sni string")


def _flow(n, at, dst="45.33.1.2", port=443, src="10.0.0.7", app=None, **more):
    start = None if at is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=at)
    row = {"flow_id": n, "src_ip": src, "dst_ip": dst, "dst_port": port, "protocol": "TCP", "start_time": start, "duration_ms": 10,
           "bytes_sent": 100, "bytes_recv": 5, "application_layer": app, "dns_queries": [], "http_hosts": [], "tls_sni": None}
    return tuple((row | more).values())


@pytest.fixture()
def flows(spark):
    rows = [_flow(i, i * 60) for i in range(12)]  # fast
    rows += [_flow(100 + i, i * 7200, dst="45.33.1.9") for i in range(8)]  # slow
    rows += [_flow(200 + i, i * 3000, dst="45.33.1.8") for i in range(12)]  # both
    rows += [_flow(300 + i, i * 60, dst="192.168.1.5") for i in range(12)]  # inside
    rows += [_flow(400, None), _flow(401, 5, dst=None), _flow(402, 5, src=None, port=None), _flow(402, 5, src=None, port=None)]
    rows += [_flow(500 + i, i, port=2000 + i, dst="45.33.7.7") for i in range(60)]
    rows += [_flow(600 + i, i, port=22, dst=f"45.33.8.{i}") for i in range(40)]
    rows += [_flow(700, 1, app="DNS", port=99, bytes_sent=900, dns_queries=["a.b.example.com"]), _flow(701, 1, app="TLS"),
             _flow(702, 1, app="HTTP", port=80, http_hosts=["login.example.com"]), _flow(703, 1, duration_ms=9 * 3_600_000)]
    return spark.createDataFrame(rows, FLOW)


def test_both_paces_in_one_sort_find_what_each_finds_alone(flows):
    paces = {"BEACON-001": R.Pace(), "BEACON-002": R.SLOW}
    together = R.paced_connections(flows, paces)
    alone = R.beacons(flows).withColumn("rule_id", F.lit("BEACON-001")).unionByName(
        R.slow_beacons(flows).withColumn("rule_id", F.lit("BEACON-002")))
    found = sorted(together.select(*alone.columns).collect())
    assert found == sorted(alone.collect())
    assert {(r.rule_id, r.dst_ip, r.connections, r.gaps) for r in found} == {
        ("BEACON-001", "45.33.1.2", 15, 11), ("BEACON-001", "45.33.1.8", 12, 11), ("BEACON-002", "45.33.1.9", 8, 7),
        ("BEACON-002", "45.33.1.8", 12, 11)}


def test_all_rules_sort_the_connections_once(flows):
    plan = FI.rule_findings(flows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lag(") == 1


def test_scans_count_distinct_ports_and_hosts(flows):
    ports = {(r.dst_ip, r.flow_count, r.ports_scanned, r.span_s, r.flow_id) for r in R.horizontal_scan(flows, 50, 100).collect()}
    assert ports == {("45.33.7.7", 60, 60, 59.0, 500)}
    hosts = {(r.src_ip, r.dst_port, r.hosts_scanned, r.span_s, r.flow_id) for r in R.host_sweep(flows, 30, 100).collect()}
    assert hosts == {("10.0.0.7", 22, 40, 39.0, 600)}


def test_single_flow_evidence(flows):
    got = {(r.flow_id, r.rule_id, r.evidence) for r in R.single_flow_hits(flows).collect()}
    assert got == {
        (700, "DNSTUNNEL-001", '{"dns_queries":["a.b.example.com"],"payload_bytes":905}'), (700, "PORTMISMATCH-001", '{"app":"DNS","port":99}'),
        (701, "TLSNONSNI-001", '{"dst_ip":"45.33.1.2","dst_port":443}'), (702, "CLEARTEXT-001", '{"hosts":["login.example.com"],"port":80}'),
        (703, "LONGCONN-001", '{"duration_hours":9.0,"dst_ip":"45.33.1.2"}')}


def test_classes_of_text_that_is_nearly_an_address(spark):
    inside = [None, "", " ", " 10.0.0.1 ", "10.0.0.1\n", "10.0.0.1\r\n", "192.0.0.8", "192.0.0.90", "239.1.1.1", "255.255.255.255", "172.31.255.255"]
    outside = ["10.0.0.1\n\n", "10.0.0.1\u0085", "010.0.0.1", "10.0.0", "10.0.0.256", "192.0.0.9", "192.0.0.10\n", "172.32.0.0", "100.64.0.1", "host"]
    df = spark.createDataFrame([(v,) for v in inside + outside], "ip string")
    rows = df.select(net.is_internal_ip(F.col("ip")).alias("i"), net.address_class(F.col("ip")).alias("c")).collect()
    assert [r.i for r in rows] == [True] * len(inside) + [False] * len(outside)
    assert [r.c & net.INTERNAL != 0 for r in rows] == [r.i for r in rows]


def test_an_array_is_sorted_once_for_its_entropy(spark):
    df = spark.createDataFrame([("abab",)], "t string").select(text.shannon_entropy(F.col("t")).alias("e"))
    assert df._jdf.queryExecution().analyzed().toString().count("sort_array") == 1
    assert df.first().e == 1.0
