"""Joins of findings, flows, observables, intel, alerts and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.operators import alerts as A
from flowloom.operators import correlate as C
from flowloom.operators import features as FT
from flowloom.operators import findings as FI
from flowloom.operators import intel as TI
from flowloom.plans.catalog import query
from flowloom.sources import capture

c = F.col
HOUR6 = 6 * 3_600_000_000


@query("join_06_finding_to_flow", """
SELECT finding_id, src_ip, dst_ip FROM x_findings f LEFT JOIN (SELECT * FROM x_order_flows WHERE protocol = 'TCP') o ON f.flow_id=o.flow_id""")
def _(t):
    return FI.with_flow(t.findings, t.order_flows.where("protocol = 'TCP'")).select("finding_id", "src_ip", "dst_ip")


@query("join_07_evidence_observables", """
WITH o AS (SELECT DISTINCT dst_ip AS value FROM x_order_flows)
SELECT finding_id, count(*) AS observables, string_agg(DISTINCT value, ',' ORDER BY value) AS "values" FROM (SELECT finding_id, ev_src AS ip FROM x_findings UNION ALL SELECT finding_id, ev_dst FROM x_findings) JOIN o ON ip=value GROUP BY 1""")
def _(t):
    obs = t.order_flows.select(c("dst_ip").alias("value")).distinct().withColumn("type", F.lit("ip"))
    return FI.evidence_observables(t.findings, obs)


BAD = "('45.33.0.1','45.33.1.20','45.33.2.3','10.0.1.7')"


@query("join_08_intel_correlation", f"""
WITH m AS (SELECT DISTINCT flow_id FROM x_findings WHERE source='ml' AND NOT is_false_positive)
SELECT flow_id, anomaly_score, array_to_string(list_sort([x FOR x IN [src_ip, dst_ip] IF x IN {BAD}]), ',') AS indicators, 9.0::double AS severity_score
FROM x_order_flows JOIN m USING (flow_id) WHERE src_ip IN {BAD} OR dst_ip IN {BAD}""")
def _(t):
    bad = t.order_flows.select(F.explode(F.array("src_ip", "dst_ip")).alias("value")).distinct().withColumn(
        "is_malicious", c("value").isin("45.33.0.1", "45.33.1.20", "45.33.2.3", "10.0.1.7"))
    return FI.intel_correlation(t.findings, t.order_flows, bad).select(
        "flow_id", "anomaly_score", F.array_join("indicators", ",").alias("indicators"), "severity_score")


_SIG = "SELECT least(src_ip,dst_ip) || '|' || greatest(src_ip,dst_ip) AS pair, ts_us, seq, 'sig ' || (k % 9) AS signature FROM x_events WHERE kind='error'"
_ANO = "SELECT least(src_ip,dst_ip) || '|' || greatest(src_ip,dst_ip) AS pair, ts_us, seq, value AS anomaly_score FROM x_events WHERE kind='view' AND value>20"
_MATCH = f"""a AS ({_SIG}), b AS ({_ANO}), m AS (
 SELECT a.pair, a.ts_us, arg_min(b.ts_us, b.ts_us) AS partner_ts_us, arg_min(a.signature, b.ts_us) AS signature, arg_min(b.seq, b.ts_us) AS flow_id, arg_min(b.anomaly_score, b.ts_us) AS anomaly_score
  FROM a JOIN b ON a.pair=b.pair AND b.ts_us BETWEEN a.ts_us-{HOUR6} AND a.ts_us GROUP BY a.pair, a.ts_us
 UNION ALL SELECT b.pair, b.ts_us, arg_min(a.ts_us, a.ts_us), arg_min(a.signature, a.ts_us), arg_min(b.seq, a.ts_us), arg_min(b.anomaly_score, a.ts_us)
  FROM b JOIN a ON a.pair=b.pair AND a.ts_us BETWEEN b.ts_us-{HOUR6} AND b.ts_us GROUP BY b.pair, b.ts_us)"""


def feeds(t):
    sig = t.events.where("kind='error'").withColumn("signature", F.concat(F.lit("sig "), (c("k") % 9).cast("string")))
    ano = t.events.where("kind='view'").withColumns({"flow_id": c("seq"), "anomaly_score": c("value"), "flagged": c("value") > 20})
    return sig, ano


@query("join_09_signature_anomaly_correlation", f"WITH {_MATCH} SELECT pair, ts_us, partner_ts_us, signature, flow_id, anomaly_score FROM m")
def _(t):
    return C.correlate(*feeds(t), window_us=HOUR6, once=False).select(
        "pair", "ts_us", "partner_ts_us", "signature", "flow_id", "anomaly_score")


@query("prj_07_alerts_of_correlated_pairs", f"""
WITH {_MATCH} SELECT ts_us, flow_id, signature, anomaly_score, 'correlation' AS type, 'critical' AS severity, true AS named FROM m""")
def _(t):
    """Correlation matches as alerts, end to end."""
    found = A.correlation_alerts(C.correlate(*feeds(t), window_us=HOUR6, once=False))
    return found.select("ts_us", "flow_id", "signature", "anomaly_score", "type", "severity", c("id").rlike("^corr-[0-9a-f]{20}$").alias("named"))


@query("join_09_correlation_once_per_window", f"""
WITH {_MATCH} SELECT pair, min(ts_us) AS ts_us, arg_min(flow_id, ts_us) AS flow_id FROM m GROUP BY pair, ts_us//{HOUR6}""")
def _(t):
    return C.correlate(*feeds(t), window_us=HOUR6).select("pair", "ts_us", "flow_id")


@query("join_10_score_to_flow", """
SELECT o.flow_id, o.anomaly_score, count(f.finding_id) AS ml_findings FROM x_order_flows o JOIN x_findings f ON o.flow_id=f.flow_id AND f.source='ml' GROUP BY 1,2""")
def _(t):
    return FI.scores_with_findings(t.order_flows, t.findings).withColumnRenamed("findings", "ml_findings")


@query("join_11_intel_lookup", """
WITH y AS (SELECT * FROM x_intel WHERE fetched_us > epoch_us(timestamp '2000-06-01') - 720*3600000000),
n AS (SELECT type, value, provider, max(struct_pack(f := fetched_us, s := score)).s AS score FROM y GROUP BY 1,2,3),
p AS (SELECT type, value, max(score) FILTER (WHERE provider='vt') AS vt, max(score) FILTER (WHERE provider='abuse') AS abuse, max(score) FILTER (WHERE provider='otx') AS otx FROM n GROUP BY 1,2)
SELECT o.type, o.value, vt, abuse, otx FROM x_obs o LEFT JOIN p ON o.type=p.type AND o.value=p.value""")
def _(t):
    intel = TI.fresh_intel(t.intel, F.lit("2000-06-01").cast("timestamp"), ttl_hours=720)
    return TI.enrich(t.observables.select("type", "value"), intel, ["vt", "abuse", "otx"]).select("type", "value", "vt", "abuse", "otx")


@query("join_12_unprocessed_files", """
SELECT page_id FROM x_hosts WHERE host NOT IN (SELECT host FROM x_hosts WHERE host LIKE 't%')""")
def _(t):
    return capture.unprocessed(t.hosts, t.hosts.where("host LIKE 't%'"), "host").select("page_id")


@query("join_13_attack_window_coverage", """
WITH w AS (SELECT CASE (l_suppkey % 6) WHEN 0 THEN 'portscan' WHEN 1 THEN 'bot' WHEN 2 THEN 'ddos' WHEN 3 THEN 'dns' WHEN 4 THEN 'arp' ELSE 'custom' END AS pattern,
  1704067200000000 + (s*1800000000) AS start_us, 1704067200000000 + (s*1800000000) + CASE WHEN l_suppkey % 6 = 4 THEN 1000 ELSE 1800000000 END AS end_us FROM (SELECT s_suppkey AS l_suppkey, s_suppkey AS s FROM supplier)),
h AS (SELECT w.pattern, bool_or(a.type='ml') AS ml, bool_or(a.type='suricata') AS sig FROM w JOIN x_alerts a ON a.ts_us > w.start_us AND a.ts_us <= w.end_us AND a.type IN ('ml','suricata') GROUP BY 1)
SELECT DISTINCT w.pattern, coalesce(ml,false) AS alerted_ml, coalesce(sig,false) AS alerted_signature,
 CASE w.pattern WHEN 'portscan' THEN 'PortScan' WHEN 'bot' THEN 'Bot' WHEN 'ddos' THEN 'DDoS' WHEN 'dns' THEN 'DNS tunnel' WHEN 'arp' THEN 'ARP activity' ELSE 'custom' END AS label
FROM w LEFT JOIN h USING (pattern)""")
def _(t):
    s = c("s_suppkey").cast("bigint")
    start = s * 1_800_000_000 + 1_704_067_200_000_000
    pattern = F.element_at(F.array(*map(F.lit, ["portscan", "bot", "ddos", "dns", "arp", "custom"])), (s % 6 + 1).cast("int"))
    windows = t.read("supplier").select(pattern.alias("pattern"), start.alias("start_us"),
                                        (start + F.when(s % 6 == 4, 1000).otherwise(1_800_000_000)).alias("end_us"))
    return C.coverage(windows, t.alerts).drop("completed")


@query("join_14_median_fill", """
SELECT flow_id, coalesce(CASE WHEN application_layer='DNS' THEN NULL ELSE packets_recv::double END, (SELECT median(packets_recv) FROM x_flows)) AS init_win_bytes_forward,
 (SELECT median(duration_ms) FROM x_flows)::double AS idle_mean FROM x_flows""")
def _(t):
    medians = FT.feature_medians(t.flows.select(c("packets_recv").alias("init_win_bytes_forward"), c("duration_ms").alias("idle_mean")),
                                 ["init_win_bytes_forward", "idle_mean"])
    measured = t.flows.withColumn("init_win_fwd", F.when(F.coalesce("application_layer", F.lit("")) != "DNS", c("packets_recv")))
    return FT.full_features(measured, medians).select("flow_id", "init_win_bytes_forward", "idle_mean")


@query("join_15_observable_upsert", """
WITH a AS (SELECT type, value, n AS occurrence_count, is_malicious, confidence, status FROM x_obs WHERE status = 'pending'),
b AS (SELECT type, value, n % 5 = 0 AS is_malicious, least(1.0, confidence*1.5) AS confidence FROM x_obs WHERE has_intel)
SELECT coalesce(a.type,b.type) AS type, coalesce(a.value,b.value) AS value, coalesce(a.occurrence_count,1) AS occurrence_count, coalesce(b.is_malicious,a.is_malicious) AS is_malicious,
 greatest(coalesce(a.confidence,0.0),coalesce(b.confidence,0.0)) AS confidence, CASE WHEN b.value IS NOT NULL THEN 'complete' ELSE a.status END AS status,
 CASE WHEN a.value IS NULL THEN 'vt' WHEN b.value IS NULL THEN 'geo' ELSE 'geo,vt' END AS providers FROM a FULL JOIN b ON a.type=b.type AND a.value=b.value""")
def _(t):
    old = t.observables.where("status = 'pending'").select("type", "value", c("n").alias("occurrence_count"), "is_malicious", "confidence", "status",
                                                   F.create_map(F.lit("geo"), F.lit("old")).alias("intel"))
    new = t.observables.where("has_intel").select("type", "value", (c("n") % 5 == 0).alias("is_malicious"),
                                                  F.least(F.lit(1.0), c("confidence") * 1.5).alias("confidence"),
                                                  F.create_map(F.lit("vt"), F.lit("new")).alias("intel"))
    out = TI.upsert_observables(old, new)
    return out.withColumn("providers", F.array_join(F.array_sort(F.map_keys("intel")), ",")).drop("intel")


@query("join_16_point_lookup", "SELECT id, finding_id, ts_us FROM x_alerts WHERE id='al77' OR finding_id='al77'")
def _(t):
    return A.find_alert(t.alerts, "al77").select("id", "finding_id", "ts_us")


@query("flt_14_false_positive_feedback", """
SELECT source, count(*) AS n FROM x_findings WHERE NOT (CASE severity WHEN 'low' THEN true WHEN 'info' THEN false ELSE is_false_positive END) GROUP BY 1""")
def _(t):
    marks = t.findings.where("severity in ('low', 'info')").select("finding_id", (c("severity") == "low").alias("is_false_positive"))
    return FI.apply_feedback(t.findings, marks).where(~c("is_false_positive")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("set_01_union_of_sources", """
SELECT source, count(*) AS n FROM (SELECT source FROM x_findings WHERE source='rule' UNION ALL SELECT source FROM x_findings WHERE source='ml' UNION ALL SELECT 'suricata' FROM (SELECT DISTINCT k % 20 FROM x_events WHERE kind IN ('error','click'))) GROUP BY 1""")
def _(t):
    from flowloom.plans.catalog.aggregates import as_signatures

    f = t.findings
    both = FI.union_findings(f.where("source='rule'"), f.where("source='ml'"), FI.signature_findings(as_signatures(t)))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("set_03_malicious_endpoints", f"""
SELECT flow_id, array_to_string(list_sort([x FOR x IN [src_ip, dst_ip] IF x IN {BAD}]), ',') AS hits FROM x_order_flows""")
def _(t):
    bad = F.array(*map(F.lit, ["45.33.0.1", "45.33.1.20", "45.33.2.3", "10.0.1.7"]))
    return t.order_flows.select("flow_id", F.array_join(F.array_sort(F.array_intersect(F.array("src_ip", "dst_ip"), bad)), ",").alias("hits"))
