import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowloom.operators import findings as FI
from flowloom.operators import rules as R
from flowloom.operators import whitelist as W

BASE = dt.datetime(2026, 1, 1, 14, 0, 0)
SCHEMA = ("flow_id bigint, src_ip string, dst_ip string, src_port bigint, dst_port bigint, protocol string, start_time timestamp, "
          "duration_ms bigint, bytes_sent bigint, bytes_recv bigint, application_layer string, dns_queries array<string>, "
          "http_hosts array<string>, tls_sni string, anomaly_score double")


def flow(i, src="10.0.0.1", dst="45.1.1.1", port=443, at=0.0, proto="TCP", ms=10, sent=10, recv=10, app=None, dns=(), hosts=(),
         sni=None, score=0.0):
    return (i, src, dst, 40000, port, proto, BASE + dt.timedelta(seconds=at), ms, sent, recv, app, list(dns), list(hosts), sni, score)


def frame(spark, *flows):
    return spark.createDataFrame(list(flows), SCHEMA)


def ids(df, col="flow_id"):
    return sorted(r[col] for r in df.collect())


def test_horizontal_scan(spark):
    scan = [flow(p, dst="10.0.0.2", port=p) for p in range(1, 60)]
    assert R.horizontal_scan(frame(spark, *scan)).count() == 1
    slow = [flow(p, dst="10.0.0.2", port=p, at=p) for p in range(1, 60)]
    assert R.horizontal_scan(frame(spark, *slow)).count() == 0


def test_host_sweep(spark):
    sweep = [flow(i, dst=f"10.0.1.{i}", port=22) for i in range(30)]
    assert R.host_sweep(frame(spark, *sweep)).first().hosts_scanned == 30
    assert R.host_sweep(frame(spark, *sweep[:29])).count() == 0


def test_beacons(spark):
    regular = [flow(i, at=60 * i) for i in range(12)]
    hit = R.beacons(frame(spark, *regular)).first()
    assert (hit.connections, hit.gaps, hit.mean_interval_s, hit.jitter_pct) == (12, 11, 60.0, 0.0)
    jitter = [flow(i, at=60 * i + (50 if i % 2 else 0)) for i in range(12)]
    assert R.beacons(frame(spark, *jitter)).count() == 0
    inside = [flow(i, dst="10.0.0.9", at=60 * i) for i in range(12)]
    assert R.beacons(frame(spark, *inside)).count() == 0
    slow = [flow(i, at=3600 * 5 * i) for i in range(6)]
    assert R.slow_beacons(frame(spark, *slow)).count() == 1
    assert R.beacons(frame(spark, *slow)).count() == 0


def test_single_flow_rules(spark):
    flows = frame(
        spark, flow(1, app="DNS", port=53, sent=150, recv=60), flow(2, app="DNS", port=53, sent=100, recv=100),
        flow(3, app="SSH", port=2222), flow(4, app="HTTP", port=8080), flow(5, app="TLS"), flow(6, app="TLS", sni="a.b"),
        flow(7, app="HTTP", port=80, hosts=["Login.example"]), flow(8, app="HTTP", port=443, hosts=["login.example"]),
        flow(9, ms=8 * 3_600_000), flow(10, ms=8 * 3_600_000, proto="UDP"), flow(11, app="TLS", dst="10.0.0.3"))
    got = {(r.rule_id, r.flow_id) for r in R.single_flow_hits(flows).collect()}
    assert got == {("DNSTUNNEL-001", 1), ("PORTMISMATCH-001", 3), ("TLSNONSNI-001", 5), ("CLEARTEXT-001", 7), ("LONGCONN-001", 9)}
    assert ids(R.large_dns(flows)) == [1] and ids(R.port_mismatch(flows)) == [3] and ids(R.tls_without_sni(flows)) == [5]
    assert ids(R.cleartext_logins(flows)) == [7] and ids(R.long_connections(flows)) == [9]


def test_dns_rules(spark):
    flows = frame(spark, flow(1, dns=["aGVsbG8gd29ybGQxz45kqmWTuv.t.example.com"]), flow(2, dns=["www.example.com"]), flow(3, dns=["xkcdqwrtz.com"]))
    assert ids(R.entropic_labels(flows)) == [1]
    assert 3 in ids(R.generated_domains(flows)) and 2 in ids(R.generated_domains(flows, 2.9))
    many = frame(spark, *[flow(i, at=i / 10, dns=[f"q{i}.evil.com"]) for i in range(120)])
    hit = R.dns_rate(many).first()
    assert (hit.apex, hit.queries, hit.queries_per_minute) == ("evil.com", 120, 120.0)
    assert R.dns_rate(many.limit(99)).count() == 0


def test_lateral_and_exfiltration(spark):
    flows = frame(spark, *[flow(i, dst=f"10.0.0.{i}", port=445) for i in range(2, 5)], *[flow(10 + i, sent=100) for i in range(20)],
                  flow(99, sent=100_000), flow(98, src="8.8.8.8", sent=100_000))
    hit = R.lateral_movement(flows).first()
    assert (hit.targets, hit.ports) == (3, [445])
    assert R.lateral_movement(flows, min_targets=4).count() == 0
    assert ids(R.exfiltration(flows, 5)) == [99]


def test_arp(spark):
    quiet = [(2, "m1", "a", "b", float(i)) for i in range(49)]
    storm = [(2, "m2", "a", "b", 100 + i * 0.1) for i in range(60)] + [(2, "m2", "a", "b", 1.0)]
    arp = spark.createDataFrame(quiet + storm + [(1, f"r{i}", "a", "b", float(i)) for i in range(9)],
                                "op int, sender_mac string, sender_ip string, target_ip string, ts double")
    assert [(r.sender_mac, r.window_start, r.reply_count) for r in R.arp_storm(arp).collect()] == [("m2", 100.0, 60)]
    assert R.arp_requests(arp).count() == 9 and R.arp_requests(arp, 5).count() == 5


def test_whitelist_and_suppression(spark):
    flows = frame(
        spark, flow(1, dst="8.8.8.8", port=53, proto="UDP"), flow(2, dst="8.8.8.8", port=9), flow(3, dst="45.1.1.1", port=9),
        flow(4, dst="45.1.1.1", port=9, dns=["a.google.com"]), flow(5, dst="45.1.1.1", port=9, sni="google.com"),
        flow(6, dst="10.0.0.2", port=9), flow(7, dst="142.251.3.4", port=443, proto="UDP"), flow(8, src="8.8.4.4", dst="10.0.0.2", port=9),
        flow(9, dst="239.255.255.250", port=1900, proto="UDP"), flow(10, dst="1.1.1.1", port=853))
    out = {r.flow_id: (r.is_whitelisted, r.suppress_reason) for r in W.with_suppression(W.mark_whitelisted(flows)).collect()}
    assert [i for i in out if out[i][0]] == [1, 2, 4, 5, 9]
    assert out[3] == (False, None) and out[10] == (False, None)
    assert out[6][1].startswith("local-only") and out[7][1] == "known CDN endpoint" and out[8][1] == "internal destination"
    lab = W.with_suppression(W.mark_whitelisted(flows), strict=False)
    assert {r.flow_id for r in lab.where("suppress_reason is null").collect()} == {3, 6, 7, 8, 10}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(8, 32)), min_size=1, max_size=12),
       st.lists(st.integers(0, 2**32 - 1), min_size=30, max_size=30))
def test_network_join_equals_literal_test(spark, nets, numbers):
    import ipaddress

    cidrs = [str(ipaddress.ip_network((n, p), strict=False)) for n, p in nets]
    probes = numbers + [int(ipaddress.ip_network(x)[0]) for x in cidrs] + [int(ipaddress.ip_network(x)[-1]) for x in cidrs]
    df = spark.createDataFrame([(str(ipaddress.ip_address(n)),) for n in probes], "ip string")
    marked = W.mark_networks(df, "ip", W.networks_frame(spark, cidrs))
    shuffled = W.mark_networks(df, "ip", W.networks_frame(spark, cidrs), max_broadcast=0)
    want = sorted((a, any(ipaddress.ip_address(a) in ipaddress.ip_network(x) for x in cidrs)) for a in [r.ip for r in df.collect()])
    assert sorted((r.ip, r.in_network) for r in marked.collect()) == want
    assert sorted((r.ip, r.in_network) for r in shuffled.collect()) == want


def test_hybrid_severity_and_risk(spark):
    flows = spark.createDataFrame([(1, 8.0), (2, 7.5), (3, 4.0), (4, 7.5)], "flow_id bigint, anomaly_score double")
    found = spark.createDataFrame([(2, "rule", 8.0), (3, "rule", 8.0), (4, "ml", 9.9)], "flow_id bigint, source string, severity_score double")
    got = {r.flow_id: r.severity_score for r in FI.hybrid_severity(flows, found).collect()}
    assert got == {1: 8.0, 2: 8.75, 3: 8.0, 4: 8.25}
    risk = spark.createDataFrame([("a", 9.0, False), ("a", 8.0, False), ("a", 10.0, True), ("b", 1.0, False)]
                                 + [("c", float(i), False) for i in range(10)], "analysis_id string, severity_score double, is_false_positive boolean")
    assert {r.analysis_id: r.risk_score for r in FI.risk_score(risk).collect()} == {"a": 8.5, "b": 1.0, "c": 7.0}


def test_signature_threshold_and_findings(spark):
    syn = spark.createDataFrame([("10.0.0.1", BASE + dt.timedelta(seconds=i), "TCP", 22, 2) for i in range(20)]
                                + [("10.0.0.2", BASE, "TCP", 22, 16)] * 30, "src_ip string, time timestamp, protocol string, dst_port int, tcp_flags int")
    assert [(r.src_ip, r.hits) for r in R.signature_threshold(syn, 22, 20).collect()] == [("10.0.0.1", 20)]
    alerts = spark.createDataFrame([(1, "s", "c", 1, f"10.0.0.{i}", "45.1.1.1") for i in range(8)],
                                   "signature_id bigint, signature string, category string, severity int, src_ip string, dst_ip string")
    f = FI.signature_findings(alerts).first()
    assert (f.hit_count, len(f.host_pairs), f.severity, f.severity_score) == (8, 5, "high", 8.0) and '"pair_count":8' in f.evidence
    assert FI.signature_pairs(alerts).count() == 8


def test_finding_ids_are_stable(spark):
    flows = frame(spark, *[flow(p, dst="10.0.0.2", port=p) for p in range(1, 60)])
    first, second = FI.rule_findings(flows), FI.rule_findings(flows)
    assert ids(first, "finding_id") == ids(second, "finding_id") and first.count() == first.select("finding_id").distinct().count()


def test_targets_order_and_limit(spark):
    found = spark.createDataFrame([("f", 1, '{"src_ip":"10.0.0.9","dst_ip":"203.0.113.5","ip":"bad","domain":"evil.example.com","hostname":"no dot"}')],
                                  "finding_id string, flow_id bigint, evidence string")
    flows = spark.createDataFrame([(1, "10.0.0.9", "9.9.9.9", "s.example.com", ["a.example", "b.example", "c.example"])],
                                  "flow_id bigint, src_ip string, dst_ip string, tls_sni string, dns_queries array<string>")
    out = [(r.kind, r.value, r.public) for r in FI.finding_targets(found, flows).orderBy("position").collect()]
    assert out == [("ip", "10.0.0.9", False), ("ip", "203.0.113.5", False), ("domain", "evil.example.com", True), ("ip", "9.9.9.9", True),
                   ("domain", "s.example.com", True), ("domain", "a.example", True), ("domain", "b.example", True), ("domain", "c.example", True)]
    assert FI.finding_targets(found, flows, 2).count() == 2


def test_analysis_end_to_end(spark):
    from flowloom.plans.analysis import analyse_flows

    flows = frame(spark, *[flow(p, dst="10.0.0.2", port=p) for p in range(1, 60)], flow(100, dst="9.9.9.9", port=4444, score=8.0),
                  flow(101, dst="8.8.8.8", port=53, proto="UDP", score=9.0))
    obs = spark.createDataFrame([("ip", "9.9.9.9", True, False, "complete", True)],
                                "type string, value string, is_malicious boolean, newly_registered boolean, status string, has_intel boolean")
    out = analyse_flows(flows, obs)
    got = sorted((r.rule_id, r.flow_id) for r in out.findings.collect())
    assert ("ML-ANOMALY-001", 100) in got and ("TI-CORR-001", 100) in got and any(r == "PORTSCAN-001" for r, _ in got)
    assert all(f != 101 for _, f in got)
    severity = {r.flow_id: r.severity_score for r in out.flows.where("flow_id in (100, 101)").collect()}
    assert severity == {100: 9.8, 101: 9.0}
    report = out.report(obs, "a1").select(F.get_json_object("report", "$.flow_metrics.total_flows"), F.get_json_object("report", "$.risk_score")).first()
    assert report[0] == "61" and float(report[1]) > 0


def test_analyses_do_not_mix(spark):
    half = [(f"a{i % 2}", flow(i, dst="10.0.0.2", port=i)) for i in range(1, 80)]
    flows = frame(spark, *[f for _, f in half]).withColumn("analysis_id", F.concat(F.lit("a"), (F.col("flow_id") % 2).cast("string")))
    assert R.horizontal_scan(flows).count() == 1 and R.horizontal_scan(flows, by=["analysis_id"]).count() == 0
    found = FI.rule_findings(flows, by=["analysis_id"], horizontal_scan={"min_ports": 30}).where("rule_id = 'PORTSCAN-001'").collect()
    assert sorted(r.analysis_id for r in found) == ["a0", "a1"] and all("analysis_id" not in r.evidence for r in found)


def test_beacons_count_connections_without_start(spark):
    lost = list(flow(99))
    lost[6] = None
    flows = frame(spark, *[flow(i, at=60 * i) for i in range(10)], tuple(lost))
    assert R.beacons(flows).first().connections == 11
