import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowloom import constants as K
from flowloom.operators import alerts as A
from flowloom.operators import correlate as C
from flowloom.operators import heuristics as H
from flowloom.operators import incidents as I
from flowloom.operators import slices as S
from flowloom.operators import report as RP
from flowloom.sources import sensor
from flowloom.streaming import live, rolling

EVENT = "seq bigint, ts_us bigint, src_ip string, dst_ip string, dst_port bigint, protocol string, info string"


def events(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], EVENT)


def at(second, port, src="10.0.0.1", info="", proto="TCP"):
    return (int(second * 1e6), src, "45.1.1.1", port, proto, info)


def test_bursts(spark):
    ssh = H.triage(events(spark, *[at(i, 22) for i in range(8)])).collect()
    assert [(r.seq, r.attack_type, r.confidence, r.indicators) for r in ssh] == [(7, "SSH-Patator", 0.82, "ssh_syn_burst,count=8")]
    ports = H.triage(events(spark, *[at(i / 10, 1000 + i) for i in range(16)])).orderBy("seq").collect()
    assert [(r.seq, r.attack_type, r.severity) for r in ports] == [(14, "PortScan", "medium"), (15, "PortScan", "medium")]
    assert H.triage(events(spark, at(0, 22))).count() == 0
    spread_out = H.triage(events(spark, *[at(i * 10, 22) for i in range(20)]))
    assert spread_out.count() == 0
    words = H.triage(events(spark, at(0, 80, info="Nmap probe"), at(1, 22, info="hydra run"), at(2, 80, info="hydra run"))).orderBy("seq").collect()
    assert [(r.seq, r.confidence) for r in words] == [(0, 0.85), (1, 0.88)]


def reference_triage(rows, window=60.0):
    """The precedence rule event by event, as a plain loop."""
    ssh, auth, ports, out = {}, {}, {}, []
    for i, (us, src, _, port, proto, info) in enumerate(rows):
        now, low = us / 1e6, info.lower()

        def push(store, key, value):
            kept = [e for e in store.get(key, []) if e[0] >= now - window] + [(now, value)]
            store[key] = kept
            return kept

        if any(k in low for k in H.K.SCAN_KEYWORDS):
            out.append((i, "scan"))
            continue
        if port in H.K.BRUTE_PORTS and any(k in low for k in H.K.BRUTE_KEYWORDS):
            out.append((i, "brute"))
            continue
        if (port == 22 or "ssh" in low or ":22" in low) and len(push(ssh, src, port)) >= 8:
            out.append((i, "ssh"))
            continue
        if port in H.K.BRUTE_PORTS and len(push(auth, (src, port), port)) >= 10:
            out.append((i, "auth"))
            continue
        if proto == "TCP" and port > 0 and len({p for _, p in push(ports, src, port)}) >= 15:
            out.append((i, "ports"))
    return out


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3_000_000), st.sampled_from([22, 22, 21, 3389, *range(1000, 1025)]), st.sampled_from(["a", "b"]),
                          st.sampled_from(["", "", "ssh x", "nmap", "hydra"])), min_size=120, max_size=200))
def test_precedence_equals_the_loop(spark, steps):
    rows, clock = [], 0
    for gap, port, src, info in steps:
        clock += gap
        rows.append((clock, src, "d", port, "TCP", info))
    got = H.triage(events(spark, *rows))
    kinds = {"nmap": "scan", "ssh_syn": "ssh", "port_scan": "ports"}
    named = sorted((r.seq, next((v for k, v in kinds.items() if r.indicators.startswith(k)), "brute" if "tool" in r.indicators else "auth"))
                   for r in got.collect())
    assert named == sorted((r.seq, r.rule) for r in got.collect())
    assert named == reference_triage(rows)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 4), st.sampled_from("ab")), min_size=1, max_size=80), st.sampled_from([1, 7, 50]))
def test_rolling_operators_equal_brute_force(spark, points, span):
    import math
    rows = [(i, t, v, k) for i, (t, v, k) in enumerate(sorted(points))]
    df = spark.createDataFrame(rows, "id bigint, t bigint, v bigint, k string")

    def window(row):
        return [r for r in rows if r[3] == row[3] and row[1] - span <= r[1] and (r[1], r[0]) <= (row[1], row[0])]

    def entropy(values):
        return -sum(values.count(x) / len(values) * math.log2(values.count(x) / len(values)) for x in set(values))

    def got(df, name):
        return {r.id: r[name] for r in df.collect()}

    assert got(S.rolling_count(df, "k", "t", span, "n", "id"), "n") == {r[0]: len(window(r)) for r in rows}
    assert got(S.rolling_distinct(df, "k", "t", "v", span, "n", "id"), "n") == {r[0]: len({x[2] for x in window(r)}) for r in rows}
    ent = got(S.rolling_entropy(df, "k", "t", "v", span, "e", "id"), "e")
    assert all(abs(ent[r[0]] - entropy([x[2] for x in window(r)])) < 1e-9 for r in rows)
    ahead = {r[0]: sum(1 for x in rows if x[3] == r[3] and x[1] <= r[1] + span and (x[1], x[0]) >= (r[1], r[0])) for r in rows}
    assert got(S.forward_count(df, "k", "t", span, "n", "id"), "n") == ahead
    gaps = {}
    for r in rows:
        before = [x for x in rows if x[3] == r[3] and (x[1], x[0]) < (r[1], r[0])]
        gap = r[1] - max(before, key=lambda x: (x[1], x[0]))[1] if before else None
        gaps[r[0]] = gap if gap is not None and gap <= span else None
    assert got(S.recent_gap(df, "k", "t", span, "g", "id"), "g") == gaps


def feeds(spark, sig, ano):
    s = spark.createDataFrame([(int(t * 1e6), a, b, "s1") for t, a, b in sig], "ts_us bigint, src_ip string, dst_ip string, signature string")
    n = spark.createDataFrame([(int(t * 1e6), a, b, i, 7.0, f) for i, (t, a, b, f) in enumerate(ano)],
                              "ts_us bigint, src_ip string, dst_ip string, flow_id bigint, anomaly_score double, flagged boolean")
    return s, n


def test_correlation(spark):
    a, b = "10.0.0.9", "203.0.113.5"
    hit = C.correlate(*feeds(spark, [(0, a, b)], [(5, b, a, True)])).first()
    assert (hit.signature, hit.flow_id, hit.src_ip, hit.ts_us) == ("s1", 0, b, 5_000_000)
    assert C.correlate(*feeds(spark, [(0, a, b)], [(200, a, b, True)]), window_us=60_000_000).count() == 0
    assert C.correlate(*feeds(spark, [(0, a, b)], [(5, a, b, False)])).count() == 0
    assert C.correlate(*feeds(spark, [(5, a, b)], [(0, a, b, True)])).count() == 1
    oldest = C.correlate(*feeds(spark, [(100, a, b)], [(0, a, b, True), (50, a, b, True)])).first()
    assert oldest.flow_id == 0
    crowd = C.correlate(*feeds(spark, [(i / 100, a, b) for i in range(300)], [(i / 100, a, b, True) for i in range(300)]), once=False)
    assert crowd.count() <= 600  # one look-up per event, never the product


def test_coverage(spark):
    w = spark.createDataFrame([("dns", 0, 100), ("bot", 100, 200), ("mine", 200, 300)], "pattern string, start_us bigint, end_us bigint")
    al = spark.createDataFrame([(50, "ml"), (150, "Suricata"), (500, "ml")], "ts_us bigint, type string")
    got = {r.pattern: (r.alerted_ml, r.alerted_signature, r.label) for r in C.coverage(w, al, 64).collect()}
    assert got == {"dns": (True, False, "DNS tunnel"), "bot": (False, True, "Bot"), "mine": (False, False, "mine")}


ALERT = ("id string, finding_id string, type string, ts_us bigint, severity string, anomaly_score double, confidence double, signature string, "
         "attack_type string, explanation string, models string, ai_status string, src_ip string, dst_ip string, src_port bigint, dst_port bigint, protocol string")


def alert(i, kind="ml", ts=0, sev="medium", score=None, conf=None, sig=None, attack=None, text="", models=None, status=None, src="10.0.0.1"):
    return (str(i), str(i), kind, ts, sev, score, conf, sig, attack, text, models, status, src, "45.1.1.1", 5, 443, "TCP")


def test_incident_merge_and_filters(spark):
    al = spark.createDataFrame([alert(1, "heuristic", 1, "medium", conf=0.8, attack="SSH-Patator", text="burst"), alert(2, "llm", 2, "high", conf=0.6, attack="Brute", models="heuristic+llm"),
                                alert(3, "ml", 3, "low", score=9.0, src="10.0.0.2")], ALERT)
    rows = I.incident_from_alert(al)
    inc = I.merge_incidents(rows)
    got = {r.src_ip: r for r in inc.collect()}
    one = got["10.0.0.1"]
    assert (sorted(one.sources), one.severity, one.confidence, one.alerts, one.attack_type, one.summary, one.from_ai, one.disposition) == (
        ["heuristic", "llm"], "high", 0.8, 2, "Brute", "burst", True, "open")
    assert (got["10.0.0.2"].severity, got["10.0.0.2"].confidence, got["10.0.0.2"].attack_type) == ("info", 0.9, "ML anomaly (9.0)")
    assert I.search_incidents(inc, source="llm").count() == 1 and I.search_incidents(inc, text="BRUTE").count() == 1
    assert I.search_incidents(inc, since_us=2).count() == 1 and I.search_incidents(inc).first().src_ip == "10.0.0.2" and I.search_incidents(inc, disposition="benign").count() == 0
    counts = {r.disposition: r.n for r in I.disposition_counts(inc).collect()}
    assert counts["open"] == 2 and len(counts) == 6
    parts = I.merge_incidents(rows.where("ts_us = 1")).unionByName(I.merge_incidents(rows.where("ts_us > 1")))
    order = sorted(inc.columns)
    assert sorted(map(str, I.fold_incidents(parts).select(order).collect())) == sorted(map(str, inc.select(order).collect()))
    assert sorted(map(str, I.fold_incidents(inc).select(order).collect())) == sorted(map(str, inc.select(order).collect()))


def test_verdict_merge_and_batches(spark):
    schema = "item string, model string, suspicious boolean, severity string, confidence double, ai_status string"
    rows = [("weak", "m1", True, "high", .4, "true_positive"), ("sure", "m1", True, "high", .8, "true_positive"),
            ("pair", "m1", True, "medium", .5, "true_positive"), ("pair", "m2", True, "high", .52, "true_positive"), ("clean", "m1", False, "high", .9, "benign")]
    got = {r.item: (r.severity, r.models) for r in I.merge_verdicts(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"sure": ("high", "m1"), "pair": ("high", "m1, m2")}
    full = json.dumps({"results": [{"index": 0, "ai_status": "TRUE_POSITIVE", "confidence": 0.9}, {"index": 1, "ai_status": "benign"}]})
    half = json.dumps({"results": [{"index": 0, "ai_status": "benign"}]})
    df = spark.createDataFrame([("a", full, 2), ("b", half, 2), ("c", "nonsense", 1)], "batch string, body string, batch_size bigint")
    assert [(r.batch, r.suspicious) for r in I.complete_batches(df).orderBy("index").collect()] == [("a", True), ("a", False)]


def test_alert_filters_and_patches(spark):
    al = spark.createDataFrame([alert(1, ts=10), alert(2, "suricata", ts=20, sev="HIGH", sig="x")], ALERT)
    assert [r.id for r in A.filter_alerts(al, 15).collect()] == ["2"] and A.filter_alerts(al, severities=["high"]).count() == 1
    log = spark.createDataFrame([("f", 1, "medium", None), ("f", 2, "high", '{"a":1}'), ("f", 3, None, None)], "finding_id string, v int, severity string, enhanced string")
    assert tuple(A.patched(log, ["finding_id"], "v", ["severity", "enhanced"]).first()) == ("f", "high", '{"a":1}')
    body = json.loads(A.push_payloads(al, ["high"], ["suricata"]).first().payload)
    assert body["content"] == "**HIGH** — Rule matched: x" and body["connection"] == "10.0.0.1:5 → 45.1.1.1:443 (TCP)"
    assert RP.expired(al, 1, "ts_us", "id").first().id == "1" and RP.expired(al, 5, "ts_us", "id").count() == 0


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.sampled_from("st")), min_size=1, max_size=90))
def test_greedy_limit_equals_the_loop(spark, steps):
    clock, rows = 0, []
    for i, (gap, session) in enumerate(steps):
        clock += gap
        rows.append((f"{i:03}", session, clock))
    want = []
    for s in "st":
        verdicts, _ = A.greedy_admit([r[2] for r in rows if r[1] == s], 3, 60)
        want += [r[0] for r, ok in zip([r for r in rows if r[1] == s], verdicts) if ok]
    df = spark.createDataFrame(rows, "id string, session string, ts_us bigint")
    assert sorted(r.id for r in A.greedy_cap(df, "session", "ts_us", 3, 60, slice_us=1).collect()) == sorted(want)


def test_greedy_limit_without_any_silence(spark, monkeypatch):
    """Steady traffic: every slice depends on the one before it, and bursts fill one instant."""
    monkeypatch.setattr(A, "WINDOWS_PER_SLICE", 1)
    rows = [(f"{i:04}", s, 7 * (i // 3)) for s in ("s", "t", None) for i in range(150 if s == "s" else 40)] + [(f"b{i}", "s", 200) for i in range(30)]
    want = []
    for s in ("s", "t", None):
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[0]))
        verdicts, _ = A.greedy_admit([r[2] for r in own], 4, 60)
        want += [r[0] for r, ok in zip(own, verdicts) if ok]
    df = spark.createDataFrame(rows, "id string, session string, ts_us bigint")
    assert sorted(r.id for r in A.greedy_cap(df, "session", "ts_us", 4, 60, slice_us=1).collect()) == sorted(want)
    assert A.greedy_cap(df.limit(0), "session", "ts_us", 4, 60).count() == 0


LINE = {"timestamp": "2026-01-01T12:00:05.000000+0000", "event_type": "flow", "src_ip": "10.0.0.1", "dest_ip": "8.8.8.8", "src_port": 5, "dest_port": 443, "proto": "tcp",
        "flow_id": 7, "flow": {"pkts_toserver": 12, "pkts_toclient": 10, "bytes_toserver": 2400, "bytes_toclient": 8000,
                               "start": "2026-01-01T12:00:00.000000+0000", "end": "2026-01-01T12:00:05.000000+0000"}, "tcp": {"syn": True, "fin": False}}


def test_sensor_lines(spark, tmp_path):
    alert_line = {**LINE, "event_type": "alert", "alert": {"signature": "sig", "signature_id": 9, "severity": 1}}
    no_name = {**LINE, "event_type": "alert", "alert": {"severity": 1}}
    lines = ["[", json.dumps(LINE) + ",", "  " + json.dumps(alert_line) + " ]", json.dumps(json.dumps(no_name)), "{broken", json.dumps(LINE) + "}{", "", "],",
             "[" + json.dumps(LINE) + "," + json.dumps(LINE) + "]"]
    (tmp_path / "log.json").write_text("\n".join(lines))
    ev = sensor.read_events(spark, str(tmp_path))
    assert tuple(sensor.event_type_counts(ev).first()) == (3, 2, 0)
    f = sensor.to_flows(ev).first()
    assert (f.flow_id, f.duration_ms, f.is_external_dst, f.protocol, f.bytes_recv, f.syn_count, f.fin_count, f.rst_count) == (7, 5000, True, "TCP", 8000, 1, 0, None)
    assert [(r.signature, r.severity) for r in sensor.to_alerts(ev).collect()] == [("sig", "high")]
    shown = sensor.to_display(ev).where("event_type = 'alert' and info = 'sig'").first()
    assert shown.severity == "critical"
    web = {**LINE, "event_type": "http", "dest_ip": "10.0.0.9", "dest_port": 9, "http": {"hostname": "h", "url": "/" + "a" * 200 + K.CLASSIFY_KEYWORDS[0]}}
    (tmp_path / "web.json").write_text(json.dumps(web))
    late = sensor.to_display(sensor.read_events(spark, str(tmp_path / "web.json"))).first()
    assert (late.severity, len(late.info)) == ("high", 120)
    (tmp_path / "pretty").mkdir()
    (tmp_path / "pretty" / "a.json").write_text(json.dumps([LINE, alert_line], indent=2))
    assert sensor.read_events(spark, str(tmp_path / "pretty"), multi_line=True).count() == 2


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def chunked(spark, df, tmp_path, parts):
    """The rows as a stream of files in time order."""
    edges = df.selectExpr(f"percentile(ts_us, array({','.join(str(i / parts) for i in range(parts + 1))}))").first()[0]
    for i in range(parts):
        last = F.lit(True) if i == parts - 1 else F.col("ts_us") < edges[i + 1]
        df.where((F.col("ts_us") >= edges[i]) & last).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def test_streams_equal_batch_over_many_micro_batches(spark, tmp_path):
    rows = [at(i * 7 % 900 + i / 1000, [22, 21, 443, 1000 + i % 40][i % 4], f"10.0.0.{i % 3}") for i in range(400)]
    df = events(spark, *sorted(rows))
    stream = chunked(spark, df, tmp_path, 4)
    out = str(tmp_path / "e")
    run(rolling.rolling_entropy_stream(f"{out}/rows", f"{out}/ctx").start(stream, f"{out}/cp"))
    got = {r.seq: round(r.dst_port_entropy, 9) for r in spark.read.parquet(f"{out}/rows").collect()}
    assert got == {r.seq: round(r.dst_port_entropy, 9) for r in H.rolling_port_entropy(df).collect()} and len(got) == 400
    out = str(tmp_path / "t")
    run(rolling.triage_stream(f"{out}/rows", f"{out}/ctx", min_ssh=3, min_auth=3, min_ports=5).start(stream, f"{out}/cp"))
    assert len(list((tmp_path / "t" / "rows").glob("batch=*"))) == 4
    stream_hits = {(r.seq, r.indicators) for r in spark.read.parquet(f"{out}/rows").collect()}
    batch_hits = {(r.seq, r.indicators) for r in H.triage(df, min_ssh=3, min_auth=3, min_ports=5).collect()}
    assert len(batch_hits) > 20 and stream_hits == batch_hits
    caps = df.select(F.col("seq").cast("string").alias("id"), F.col("src_ip").alias("session"), "ts_us")
    (tmp_path / "c").mkdir()
    out = str(tmp_path / "c")
    run(rolling.rate_limit_stream(f"{out}/rows", f"{out}/ctx", "session", 4).start(chunked(spark, caps, tmp_path / "c", 3), f"{out}/cp"))
    assert {r.id for r in spark.read.parquet(f"{out}/rows").collect()} == {r.id for r in A.greedy_cap(caps, "session", "ts_us", 4).collect()}


def test_live_query_and_chunk_analysis(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    hit = {**LINE, "dest_ip": "9.9.9.9", "dest_port": 4444, "event_type": "alert", "alert": {"signature": "sig", "signature_id": 9, "severity": 1}}
    flagged = {**LINE, "dest_ip": "9.9.9.9", "dest_port": 4444}
    for i in range(3):
        (src / f"{i}.json").write_text("\n".join(json.dumps({**x, "src_port": 5 + i % 2}) for x in (hit, flagged)))
    out = str(tmp_path / "out")
    run(live.run_live(spark, sensor.stream_events(spark, str(src), 1), lambda f: f.withColumn("anomaly_score", F.lit(7.5)), out, str(tmp_path / "cp"),
                      trigger={"availableNow": True}))
    assert live.read_alerts(spark, out).count() == 6
    inc = {r.src_port: (r.alerts, sorted(r.sources), r.severity) for r in live.read_incidents(spark, out).collect()}
    assert inc == {5: (4, ["ml", "suricata"], "critical"), 6: (2, ["ml", "suricata"], "critical")}

    from tests.test_flows_and_capture import FRAMES, classic
    caps = tmp_path / "caps"
    caps.mkdir()
    for i in range(2):
        (caps / f"{i}.pcap").write_bytes(classic(FRAMES))
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(str(caps))
    seen = str(tmp_path / "seen")
    run(live.analyse_chunks(files, lambda packets, batch: packets.groupBy("analysis_id").count().write.mode("append").parquet(seen), str(tmp_path / "cp2")))
    assert [r["count"] for r in spark.read.parquet(seen).collect()] == [9, 9]


def test_sinks(spark, tmp_path):
    from flowloom.operators.sinks import persist_analysis, write_export
    flows = spark.createDataFrame([(1, "x")], "flow_id bigint, src_ip string")
    for _ in range(2):
        persist_analysis(str(tmp_path / "db"), "a1", flows=flows)
    persist_analysis(str(tmp_path / "db"), "a2", flows=flows)
    back = spark.read.parquet(str(tmp_path / "db/flows"))
    assert sorted(r.analysis_id for r in back.collect()) == ["a1", "a2"]
    write_export(flows, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).first().src_ip == "x"


def test_persisted_flows_of_all_analyses(spark):
    from flowloom.plans.adapter_sql import with_views
    from flowloom.plans.adapters import Tables
    from flowloom.plans.catalog.live import persisted
    from tests.oracle import compare, connect, duck_rows, spark_rows

    sf = "/root/testdata/sf0.001"
    sql = with_views("SELECT analysis_id, count(*) AS flows, sum(bytes_sent)::bigint AS bytes FROM x_flows GROUP BY 1")
    found = persisted(Tables(spark, sf)).persist()
    assert found.count() > 2
    assert compare(spark_rows(found), duck_rows(connect(sf), sql)) is None


def test_lookup_plugin(spark):
    import pandas as pd
    from flowloom.operators.intel import enrich_with, upsert_observables

    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "value string")
    out = enrich_with(df, "value", lambda keys: pd.DataFrame({"value": keys, "n": [len(k) for k in keys]}), "value string, n bigint")
    assert sorted(tuple(r) for r in out.collect()) == [("a", 1), ("b", 1)]
    schema = "type string, value string, occurrence_count bigint, is_malicious boolean, confidence double, status string, intel map<string,string>"
    old = spark.createDataFrame([("ip", "1", 4, False, .5, "pending", {"geo": "x", "vt": "old"})], schema)
    new = spark.createDataFrame([("ip", "1", True, .2, {"vt": "new"}), ("ip", "2", False, .1, {})], "type string, value string, is_malicious boolean, confidence double, intel map<string,string>")
    got = {r.value: r for r in upsert_observables(old, new).collect()}
    assert (got["1"].is_malicious, got["1"].confidence, got["1"].occurrence_count, got["1"].intel, got["2"].status) == (True, .5, 4, {"geo": "x", "vt": "new"}, "complete")


def test_context_is_written_once_and_expires(spark, tmp_path):
    """Batches add their own rows; only slices in reach are read, those out of reach go, a repeated batch replaces itself."""
    run = rolling.rolling_entropy_stream(str(tmp_path / "rows"), str(tmp_path / "ctx"), 1000)

    def batch(start):
        return spark.createDataFrame([("a", 443 + i % 3, start + 10 * i) for i in range(50)], "src_ip string, dst_port int, ts_us bigint").withColumn("seq", F.col("ts_us"))

    def held():
        return {(p.parent.parent.name, p.parent.name, p.name): p.stat().st_mtime_ns for p in (tmp_path / "ctx").rglob("*.parquet")}

    run.process(batch(0), 0)
    first = held()
    run.process(batch(600), 1)
    second = held()
    assert first.items() <= second.items() and {b for _, b, _ in set(second) - set(first)} == {"batch=1"}
    rows = spark.read.parquet(str(tmp_path / "ctx"))
    assert {(r.batch, r["count"]) for r in rows.groupBy("batch").count().collect()} == {(0, 50), (1, 50)}
    once = spark.read.parquet(str(tmp_path / "rows" / "batch=1")).orderBy("ts_us").collect()
    run.process(batch(600), 1)
    assert spark.read.parquet(str(tmp_path / "rows" / "batch=1")).orderBy("ts_us").collect() == once
    assert spark.read.parquet(str(tmp_path / "ctx")).count() == 100
    run.process(batch(50_000), 2)
    assert {b for _, b, _ in held()} == {"batch=2"}


def test_compact_intel_always_parses(spark):
    from flowloom.operators.intel import compact_intel

    long = "x" * 300
    df = spark.createDataFrame([("vt", json.dumps({"score": 3, "extra": long})), ("otx", json.dumps({"note": long})),
                                ("abuse", json.dumps({"error": long})), ("otx", None)], "provider string, payload string")

    def shown(budget):
        out = df.select(compact_intel(F.col("provider"), F.col("payload"), {"vt": ["score"]}, budget).alias("j")).collect()
        return [r.j and json.loads(r.j) for r in out]

    assert shown(None) == [{"score": "3"}, {"note": long}, {"error": long}, None]
    assert shown(100) == [{"score": "3"}, {"omitted_chars": 312}, {"omitted_chars": 312}, None]
