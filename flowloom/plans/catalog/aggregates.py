"""Report aggregates, top lists, risk and verdict merges, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.operators import alerts as A
from flowloom.operators import features as FT
from flowloom.operators import findings as FI
from flowloom.operators import incidents as I
from flowloom.operators import intel as TI
from flowloom.operators import report as RP
from flowloom.plans.adapter_sql import INTERNAL
from flowloom.plans.catalog import query
from flowloom.plans.catalog.detection import WL_FLAG, white

c = F.col
DST_IN = INTERNAL.format(c="dst_ip")


def as_signatures(t):
    return t.events.where("kind in ('error','click')").withColumns({
        "signature_id": c("k") % 20, "signature": F.concat(F.lit("sig "), (c("k") % 20).cast("string")),
        "category": F.lit("cat"), "severity": (c("k") % 4).cast("int")})


@query("agg_07_signature_findings", """
WITH s AS (SELECT k % 20 AS sid, src_ip || ' → ' || dst_ip AS pair, k % 4 AS lev FROM x_events WHERE kind IN ('error','click')),
d AS (SELECT sid, pair, row_number() OVER (PARTITION BY sid ORDER BY pair) AS n FROM (SELECT DISTINCT sid, pair FROM s)),
g AS (SELECT sid, count(*) AS hit_count, min(lev) AS lev FROM s GROUP BY 1),
p AS (SELECT sid, string_agg(pair, ',' ORDER BY pair) AS pairs FROM d WHERE n<=5 GROUP BY 1)
SELECT 'SIGNATURE-' || sid AS rule_id, hit_count, pairs, CASE lev WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
 CASE lev WHEN 1 THEN 8.0 WHEN 2 THEN 5.5 ELSE 3.0 END::double AS severity_score FROM g JOIN p USING (sid)""")
def _(t):
    return FI.signature_findings(as_signatures(t)).select(
        "rule_id", "hit_count", F.array_join("host_pairs", ",").alias("pairs"), "severity", "severity_score")


@query("agg_08_event_type_counts", """
SELECT count(*) FILTER (WHERE kind='view') AS flow_events, count(*) FILTER (WHERE kind='error') AS alert_events,
 count(*) FILTER (WHERE kind NOT IN ('view','error')) AS other_events FROM x_events""")
def _(t):
    from flowloom.sources.sensor import event_type_counts

    kind = F.when(c("kind") == "view", "flow").when(c("kind") == "error", "alert").otherwise(c("kind"))
    return event_type_counts(t.events.select(kind.alias("event_type")))


@query("agg_09_findings_by_severity_and_source", """
SELECT 'severity' AS dim, severity AS name, count(*) AS n FROM x_findings WHERE NOT is_false_positive GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FROM x_findings WHERE NOT is_false_positive GROUP BY 2""")
def _(t):
    def by(key):
        return RP.findings_by(t.findings, key).select(F.lit(key).alias("dim"), c(key).alias("name"), "n")

    return by("severity").unionByName(by("source"))


@query("agg_10_protocol_distribution", """
SELECT coalesce(application_layer, protocol) AS name, count(*) AS n FROM x_flows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(t):
    return RP.protocol_distribution(t.flows)


@query("agg_11_top_talkers", """
SELECT src_ip, cast(sum(bytes_sent+bytes_recv) AS bigint) AS bytes FROM x_flows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(t):
    return RP.top_talkers(t.flows)


@query("agg_12_dns_top_domains", """
SELECT dns_query AS domain, count(*) AS n FROM x_flows WHERE dns_query IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def _(t):
    return RP.top_domains(t.flows)


@query("agg_13_port_heatmap", "SELECT dst_port, count(*) AS n FROM x_flows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(t):
    return RP.top_ports(t.flows)


@query("agg_14_traffic_timeline", """
SELECT strftime(make_timestamp(start_us), '%Y-%m-%d %H:%M') AS minute, cast(sum(bytes_sent+bytes_recv) AS bigint) AS bytes FROM x_flows GROUP BY 1""")
def _(t):
    return RP.traffic_timeline(t.flows)


@query("agg_15_report_metrics", f"""
SELECT count(*) AS total_flows, count(*) FILTER (WHERE {WL_FLAG}) AS whitelisted_flows, count(DISTINCT dst_ip) FILTER (WHERE NOT {DST_IN}) AS unique_external_ips,
 (SELECT count(*) FROM x_obs WHERE is_malicious) AS malicious_observables, (SELECT count(*) FROM x_obs WHERE status='complete' AND has_intel) AS investigated_count FROM x_flows""")
def _(t):
    return RP.flow_metrics(white(t)).crossJoin(F.broadcast(RP.observable_metrics(t.observables)))  # one row each


@query("agg_16_overview", """
SELECT count(*) AS total_analyses, count(*) FILTER (WHERE status='complete') AS complete, count(*) FILTER (WHERE status='failed') AS failed,
 count(*) FILTER (WHERE status NOT IN ('complete','failed')) AS in_progress, count(*) FILTER (WHERE source<>'live') AS pcap_count,
 count(*) FILTER (WHERE source='live') AS live_count, round(avg(risk_score) FILTER (WHERE status='complete'),2) AS avg_risk_score,
 cast(sum(total_flows) AS bigint) AS total_flows, cast(sum(total_findings) AS bigint) AS total_findings FROM x_analyses""")
def _(t):
    return RP.overview(t.analyses)


INCIDENT_SQL = """
i AS (SELECT src_ip || '|' || dst_ip || '|' || src_port || '|' || dst_port || '|' || protocol AS connection, ts_us, src_ip, dst_ip, src_port, dst_port, protocol,
 lower(type) AS src1, CASE WHEN lower(type)='llm' AND models LIKE '%heuristic%' THEN 'heuristic' END AS src2, lower(severity) AS severity,
 CASE lower(type) WHEN 'ml' THEN 'ML anomaly (' || coalesce(anomaly_score::varchar,'?') || ')' ELSE coalesce(attack_type, signature, explanation) END AS attack_type,
 round(CASE WHEN coalesce(anomaly_score,0)<>0 AND coalesce(confidence,0)=0 THEN anomaly_score/10 WHEN coalesce(confidence,0)=0 THEN 0.5 ELSE confidence END,3)::double AS confidence,
 CASE WHEN lower(type)='llm' THEN 'true_positive' ELSE 'open' END AS disposition, explanation AS summary FROM x_alerts),
m AS (SELECT connection, min(ts_us) AS first_ts_us, max(ts_us) AS last_ts_us, arg_min(disposition, ts_us) AS disposition, max(confidence) AS confidence, count(*) AS alerts,
 max(CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS r, arg_max(attack_type, ts_us) AS attack_type, arg_max(summary, ts_us) AS summary,
 arg_min(src_ip, ts_us) AS src_ip, arg_min(dst_ip, ts_us) AS dst_ip, arg_min(protocol, ts_us) AS protocol FROM i GROUP BY 1),
u AS (SELECT connection, string_agg(DISTINCT s, ',' ORDER BY s) AS sources FROM (SELECT connection, src1 AS s FROM i UNION ALL SELECT connection, src2 FROM i WHERE src2 IS NOT NULL) GROUP BY 1),
inc AS (SELECT m.*, sources, CASE r WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'info' END AS severity FROM m JOIN u USING (connection))"""


def incidents(t):
    return I.merge_incidents(I.incident_from_alert(t.alerts))


@query("str_07_incident_merge", f"""
WITH {INCIDENT_SQL} SELECT connection, first_ts_us, last_ts_us, disposition, confidence, alerts, severity, sources, attack_type, summary FROM inc""")
def _(t):
    return incidents(t).select("connection", "first_ts_us", "last_ts_us", "disposition", "confidence", "alerts", "severity",
                               F.array_join("sources", ",").alias("sources"), "attack_type", "summary")


@query("set_05_distinct_union_of_sources", f"""
WITH {INCIDENT_SQL} SELECT connection, sources FROM inc""")
def _(t):
    return incidents(t).select("connection", F.array_join("sources", ",").alias("sources"))


@query("str_08_incident_verdicts", f"""
WITH {INCIDENT_SQL}, v AS (SELECT connection, arg_max(CASE WHEN confidence>0.5 THEN 'false_positive' ELSE 'open' END, ts_us) AS d FROM i WHERE src_ip<>'10.0.0.1' GROUP BY 1)
SELECT connection, coalesce(d, disposition) AS disposition FROM inc LEFT JOIN v USING (connection)""")
def _(t):
    rows = I.incident_from_alert(t.alerts)
    verdicts = rows.where("src_ip <> '10.0.0.1'").select(
        "connection", "ts_us", F.when(c("confidence") > 0.5, "FALSE_POSITIVE").otherwise("nonsense").alias("disposition"),
        F.lit("note").alias("analyst_note"))
    return I.apply_verdicts(I.merge_incidents(rows), verdicts).select("connection", "disposition")


@query("agg_17_incident_summary", f"""
WITH {INCIDENT_SQL}, d(name) AS (VALUES ('open'),('true_positive'),('false_positive'),('true_negative'),('benign'),('error'))
SELECT 'disposition' AS dim, name, count(connection) AS n FROM d LEFT JOIN inc ON name=disposition GROUP BY 2
UNION ALL SELECT 'source', s, count(*) FROM (SELECT unnest(string_split(sources,',')) AS s FROM inc) GROUP BY 2""")
def _(t):
    inc = incidents(t)
    a = I.disposition_counts(inc).select(F.lit("disposition").alias("dim"), c("disposition").alias("name"), "n")
    b = I.source_counts(inc).select(F.lit("source").alias("dim"), c("source").alias("name"), "n")
    return a.unionByName(b)


@query("flt_05_incident_search", f"""
WITH {INCIDENT_SQL} SELECT connection, attack_type FROM inc WHERE first_ts_us > 1704844800000000 AND disposition='open' AND contains(sources,'suricata')
 AND contains(lower(concat_ws(' ',src_ip,dst_ip,attack_type,summary,protocol,disposition)), 'sig 3') ORDER BY first_ts_us DESC, connection LIMIT 200""")
def _(t):
    return I.search_incidents(incidents(t), 1704844800 * 1_000_000, "open", "suricata", " SIG 3 ").select("connection", "attack_type")


@query("agg_18_alert_counts", """
SELECT lower(severity) AS severity, count(*) AS total, count(*) FILTER (WHERE type='ml') AS ml, count(*) FILTER (WHERE type='suricata') AS signature
FROM x_alerts WHERE ts_us>1704844800000000 GROUP BY 1""")
def _(t):
    return A.alert_counts(t.alerts, 1704844800 * 1_000_000)


@query("agg_19_analysis_risk", """
SELECT analysis_id, least(10.0, round(avg(severity_score),2)) AS risk_score FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY severity_score DESC) AS r
 FROM x_findings WHERE NOT is_false_positive) WHERE r<=5 GROUP BY 1""")
def _(t):
    return FI.risk_score(t.findings)


_HYBRID = """WITH g AS (SELECT flow_id, max(CASE WHEN source IN ('rule','ti_correlation','suricata','suricata_ml_correlation') THEN severity_score END) AS top FROM x_findings GROUP BY 1)
SELECT o.flow_id, least(10.0, round(CASE WHEN g.flow_id IS NULL THEN anomaly_score ELSE greatest(anomaly_score, coalesce(top, anomaly_score))
 + CASE WHEN anomaly_score>=5 THEN anomaly_score*0.4*0.25 ELSE 0 END END, 2)) AS severity_score FROM x_order_flows o LEFT JOIN g ON o.flow_id=g.flow_id"""


@query("agg_20_hybrid_severity", _HYBRID)
def _(t):
    return FI.hybrid_severity(t.order_flows, t.findings).select("flow_id", "severity_score")


@query("agg_21_port_entropy", """
SELECT src_ip, round(-sum(n/t*log2(n/t)),6) AS port_entropy FROM (SELECT src_ip, count(*)::double AS n, sum(count(*)) OVER (PARTITION BY src_ip)::double AS t FROM x_flows GROUP BY src_ip, dst_port) GROUP BY 1""")
def _(t):
    return FT.port_entropy(t.flows).select("src_ip", F.round("port_entropy", 6).alias("port_entropy"))


@query("agg_28_geo_markers", "SELECT value, lat::double AS lat, lon::double AS lon FROM x_obs WHERE type='ip' AND lat<>0 AND lon<>0")
def _(t):
    return RP.geo_markers(t.observables).select("value", "lat", "lon")


@query("win_11_threat_map", """
WITH a AS (SELECT analysis_id, max(s_acctbal) AS created_at FROM (SELECT 'a' || (s_suppkey % 20) AS analysis_id, s_acctbal FROM supplier) GROUP BY 1),
n AS (SELECT * FROM a ORDER BY created_at DESC, analysis_id LIMIT 10),
r AS (SELECT o.*, created_at, row_number() OVER (PARTITION BY o.analysis_id ORDER BY type, value) AS rn FROM x_obs o JOIN n USING (analysis_id))
SELECT analysis_id, value FROM r WHERE rn<=90 AND type='ip' AND lat<>0 AND lon<>0 ORDER BY created_at DESC, analysis_id, rn LIMIT 400""")
def _(t):
    analyses = t.observables.where("type='ip'").groupBy("analysis_id").agg(F.max("bal").alias("created_at"))
    return RP.threat_map(analyses, t.observables, newest=10, per_analysis=90, total=400).select("analysis_id", "value")


@query("agg_29_finding_targets", """
WITH f AS (SELECT finding_id, ev_src, ev_dst, ev_domain, o.src_ip, o.dst_ip, o.tls_sni, o.dns_query FROM x_findings x LEFT JOIN x_order_flows o ON x.flow_id=o.flow_id),
e AS (SELECT finding_id, unnest(['ip','ip','domain','ip','ip','domain','domain']) AS kind, unnest([ev_src, ev_dst, ev_domain, src_ip, dst_ip, tls_sni, dns_query]) AS value, unnest([1,2,3,4,5,6,7]) AS p FROM f),
d AS (SELECT finding_id, kind, value, min(p) AS p FROM e WHERE value IS NOT NULL GROUP BY 1,2,3),
r AS (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY p) AS position FROM d)
SELECT finding_id, position, kind, value, NOT (kind='ip' AND value LIKE '10.%') AS public FROM r""")
def _(t):
    return FI.finding_targets(t.wide.findings, t.order_flows)


@query("agg_30_verdict_merge", """
WITH b AS (SELECT * FROM x_models WHERE suspicious)
SELECT item, count(*) AS votes, max(confidence) AS confidence, CASE max(CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END)
 WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'info' END AS severity, string_agg(DISTINCT model, ', ' ORDER BY model) AS models
FROM b GROUP BY 1 HAVING max(confidence)>=0.55 OR count(*)>=2""")
def _(t):
    return I.merge_verdicts(t.models).drop("ai_status")


@query("agg_30_preferred_models", """
SELECT item, coalesce(max(ai_status) FILTER (WHERE model='m2'), max(ai_status) FILTER (WHERE model='m0')) AS "primary", max(ai_status) FILTER (WHERE model='m1') AS secondary FROM x_models GROUP BY 1""")
def _(t):
    return I.preferred_models(t.models, {"primary": ["m2", "m0"], "secondary": ["m1"]})


@query("agg_31_complete_batches", """
WITH d AS (SELECT conv_id AS batch, turn AS idx, length(text) AS n FROM conversations WHERE NOT (conv_id % 3 = 0 AND turn = 1)),
g AS (SELECT conv_id, count(*) AS size FROM conversations GROUP BY 1)
SELECT batch, idx AS index, n%2=0 AS suspicious, n%100/100 AS confidence FROM d JOIN g ON batch=conv_id WHERE batch NOT IN (SELECT conv_id FROM conversations WHERE conv_id%3=0 AND turn=1)""")
def _(t):
    n = F.length("text")
    row = F.struct(c("turn").cast("int").alias("index"), F.when(n % 2 == 0, "TRUE_POSITIVE").otherwise("benign").alias("ai_status"),
                   (n % 100 / 100).alias("confidence"))
    lost = (c("conv_id") % 3 == 0) & (c("turn") == 1)
    answers = t.read("conversations").groupBy(c("conv_id").alias("batch")).agg(
        F.to_json(F.struct(F.collect_list(F.when(~lost, row)).alias("results"))).alias("body"),
        F.count(F.lit(1)).alias("batch_size"))
    return I.complete_batches(answers).select("batch", "index", "suspicious", "confidence")


@query("agg_32_feature_explanation", """
WITH m AS (SELECT avg(bytes_sent) AS m1, avg(bytes_recv) AS m2, avg(packets_sent) AS m3 FROM x_flows),
d AS (SELECT flow_id, abs(bytes_sent-m1)/(abs(m1)+1e-6) AS d1, abs(bytes_recv-m2)/(abs(m2)+1e-6) AS d2, abs(packets_sent-m3)/(abs(m3)+1e-6) AS d3 FROM x_flows, m)
SELECT flow_id, CASE WHEN greatest(d1,d2,d3)<=2 THEN NULL WHEN d1>=greatest(d2,d3) THEN 'bytes_sent' WHEN d2>=d3 THEN 'bytes_recv' ELSE 'packets_sent' END AS top_feature,
 CASE WHEN greatest(d1,d2,d3)>2 THEN round(greatest(d1,d2,d3),4) END AS deviation FROM d""")
def _(t):
    return FT.explain_scores(t.flows, ["bytes_sent", "bytes_recv", "packets_sent"]).drop("explanation")


# ---- top lists -----------------------------------------------------------------------------

@query("topk_02_context_flows", """
SELECT flow_id, anomaly_score FROM x_flows ORDER BY anomaly_score DESC, duration_ms DESC, flow_id LIMIT 25""")
def _(t):
    return RP.context_flows(t.flows.withColumn("severity_score", c("duration_ms"))).select("flow_id", "anomaly_score")


@query("topk_02_context_observables", """
SELECT type, value, confidence FROM x_obs ORDER BY is_malicious DESC, confidence DESC, type, value LIMIT 40""")
def _(t):
    return RP.context_observables(t.observables).select("type", "value", "confidence")


@query("topk_02_context_bundle", """
SELECT * FROM (SELECT 'findings' AS list, finding_id AS name, severity_score::double AS score FROM x_findings WHERE NOT is_false_positive ORDER BY severity_score DESC, finding_id LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'flows', flow_id::varchar, anomaly_score::double FROM x_flows ORDER BY anomaly_score DESC, flow_id LIMIT 25)
UNION ALL SELECT * FROM (SELECT 'observables', type || ':' || value, confidence::double FROM x_obs ORDER BY is_malicious DESC, confidence DESC, type, value LIMIT 40)""")
def _(t):
    """The three JSON texts of the bundle, read back entry by entry."""
    bundle = RP.context_bundle(t.findings, t.flows.withColumn("severity_score", c("anomaly_score")), t.observables)

    def entries(name, schema, key, score):
        return bundle.select(F.explode(F.from_json(name, f"array<struct<{schema}>>")).alias("e")).select(
            F.lit(name).alias("list"), key.alias("name"), c(f"e.{score}").alias("score"))

    found = entries("findings", "finding_id:string,severity_score:double", c("e.finding_id"), "severity_score")
    flows = entries("flows", "flow_id:bigint,anomaly_score:double", c("e.flow_id").cast("string"), "anomaly_score")
    return found.unionByName(flows).unionByName(entries(
        "observables", "type:string,value:string,confidence:double", F.concat_ws(":", "e.type", "e.value"), "confidence"))


@query("topk_03_review_candidates", """
SELECT finding_id, severity, severity_score FROM x_findings WHERE NOT is_false_positive AND severity IN ('critical','high','medium') ORDER BY severity_score DESC, finding_id LIMIT 25""")
def _(t):
    return RP.review_candidates(t.findings).select("finding_id", "severity", "severity_score")


@query("topk_04_recent_analyses", "SELECT analysis_id, status FROM x_analyses ORDER BY created_at DESC, analysis_id LIMIT 6")
def _(t):
    return RP.newest(t.analyses, 6, "created_at", "analysis_id").select("analysis_id", "status")


@query("topk_05_retention", """
SELECT seq FROM (SELECT seq, row_number() OVER (ORDER BY ts_us DESC, seq) AS r FROM x_events) WHERE r>500""")
def _(t):
    return RP.expired(t.events, 500, "ts_us", "seq").select("seq")


@query("topk_06_page_totals", "SELECT count(*) AS total, cast(ceil(count(*)/50) AS bigint) AS pages FROM x_flows WHERE protocol='UDP'")
def _(t):
    return RP.pages(RP.filter_flows(t.flows, "UDP"), 50)


@query("topk_06_page", "SELECT flow_id FROM x_flows WHERE protocol='UDP' ORDER BY flow_id LIMIT 50 OFFSET 200")
def _(t):
    return RP.page(RP.filter_flows(t.flows, "UDP"), [F.asc("flow_id")], 5, 50).select("flow_id")


@query("str_09_latest_feed", "SELECT id, severity FROM x_alerts WHERE ts_us>1704844800000000 ORDER BY ts_us DESC, id LIMIT 200")
def _(t):
    return RP.newest(A.filter_alerts(t.alerts, 1704844800 * 1_000_000), 200, "ts_us", "id").select("id", "severity")


@query("src_08_tail_of_log", "SELECT seq, kind FROM x_events ORDER BY ts_us DESC, seq LIMIT 100")
def _(t):
    from flowloom.sources.sensor import tail

    return tail(t.events, 100, "ts_us", "seq").select("seq", "kind")


# ---- exports -------------------------------------------------------------------------------

@query("snk_04_flow_export", """
SELECT src_ip, dst_ip, src_port, dst_port, protocol, bytes_sent, bytes_recv, duration_ms, application_layer AS app_layer, anomaly_score AS severity FROM x_flows""")
def _(t):
    return RP.flow_export(t.flows.withColumn("severity_score", c("anomaly_score")))


@query("snk_05_event_export", """
SELECT seq AS id, ts_us AS "timestamp", src_ip, src_port, dst_ip, dst_port, protocol, length, info, 'info' AS severity, kind AS event_type FROM x_events WHERE seq>5000""")
def _(t):
    named = t.events.withColumnsRenamed({"seq": "id", "ts_us": "timestamp", "kind": "event_type"}).withColumn("severity", F.lit("info"))
    return RP.event_export(named, 5000)


@query("snk_06_indicator_bundle", """
SELECT finding_id, '[network-traffic:src_ref.value = ''' || o.src_ip || ''' AND network-traffic:dst_ref.value = ''' || o.dst_ip || ''']' AS pattern, severity AS label
FROM x_findings f LEFT JOIN x_order_flows o ON f.flow_id=o.flow_id WHERE NOT is_false_positive""")
def _(t):
    out = RP.indicators(t.findings, t.order_flows)
    return out.select("finding_id", F.get_json_object("indicator", "$.pattern").alias("pattern"),
                      F.get_json_object("indicator", "$.labels[0]").alias("label"))


_PAIRS = ["findings_by_severity", "protocol_distribution", "top_talkers", "dns_top_domains", "port_heatmap", "traffic_timeline"]


@query("snk_07_report_document", f"""
WITH m AS (SELECT count(*) AS total, count(*) FILTER (WHERE {WL_FLAG}) AS listed, count(DISTINCT dst_ip) FILTER (WHERE NOT {DST_IN}) AS outside FROM x_flows),
k AS (SELECT least(10.0, round(avg(severity_score),2)) AS risk FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY severity_score DESC) AS r
 FROM x_findings WHERE NOT is_false_positive) WHERE r<=5 GROUP BY analysis_id)
SELECT 'findings_by_severity' AS part, severity AS key, count(*)::double AS value FROM x_findings WHERE NOT is_false_positive GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'protocol_distribution', coalesce(application_layer, protocol), count(*) AS n FROM x_flows GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'top_talkers', src_ip, sum(bytes_sent+bytes_recv) AS n FROM x_flows GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'dns_top_domains', dns_query, count(*) AS n FROM x_flows WHERE dns_query IS NOT NULL GROUP BY 2 ORDER BY n DESC, 2 LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'port_heatmap', dst_port::varchar, count(*) AS n FROM x_flows GROUP BY dst_port ORDER BY n DESC, dst_port LIMIT 20)
UNION ALL SELECT 'traffic_timeline', strftime(make_timestamp(start_us), '%Y-%m-%d %H:%M'), sum(bytes_sent+bytes_recv) FROM x_flows GROUP BY 2
UNION ALL SELECT 'flow_metrics', 'total_flows', total FROM m UNION ALL SELECT 'flow_metrics', 'whitelisted_flows', listed FROM m UNION ALL SELECT 'flow_metrics', 'unique_external_ips', outside FROM m
UNION ALL SELECT 'observable_metrics', 'malicious_observables', count(*) FROM x_obs WHERE is_malicious
UNION ALL SELECT 'observable_metrics', 'investigated_count', count(*) FROM x_obs WHERE status='complete' AND has_intel
UNION ALL SELECT 'risk_score', 'all', max(risk) FROM k""")
def _(t):
    """The document's charts and metrics, read back from its JSON."""
    flows = white(t).withColumn("severity_score", c("anomaly_score"))
    minute = t.flows.agg(F.min("start_time").cast("string").alias("started"))
    document = RP.report_document(minute.withColumn("analysis_id", F.lit("all")), flows, t.findings, t.observables, FI.risk_score(t.findings))
    pairs = "array<struct<key:string,value:double>>"
    metrics = {"flow_metrics": ["total_flows", "whitelisted_flows", "unique_external_ips"], "observable_metrics": ["malicious_observables", "investigated_count"]}
    body = F.from_json("report", ", ".join(["risk_score double", *[f"{n} {pairs}" for n in _PAIRS], *[f"{n} map<string,double>" for n in metrics]]))
    parsed = document.select(body.alias("r"))

    def chart(name):
        return F.transform(f"r.{name}", lambda e: F.struct(F.lit(name).alias("part"), e["key"].alias("key"), e["value"].alias("value")))

    lists = [chart(n) for n in _PAIRS]
    values = [F.struct(F.lit(part).alias("part"), F.lit(name).alias("key"), c(f"r.{part}")[name].alias("value")) for part, names in metrics.items() for name in names]
    values.append(F.struct(F.lit("risk_score").alias("part"), F.lit("all").alias("key"), c("r.risk_score").alias("value")))
    return parsed.select(F.explode(F.concat(*lists, F.array(*values))).alias("e")).select("e.*")


@query("snk_08_push_payloads", """
SELECT id, CASE lower(type) WHEN 'suricata' THEN 'Rule matched: ' || coalesce(signature,'unnamed rule') WHEN 'correlation' THEN 'Rule and outlier agree: ' || coalesce(signature,'unnamed rule') || ': ' || coalesce(anomaly_score::varchar,'unknown')
 WHEN 'llm' THEN 'Model verdict: ' || coalesce(ai_status,'open') || ': ' || coalesce(attack_type,'unnamed attack') ELSE 'Outlier flow: ' || coalesce(anomaly_score::varchar,'unknown') END AS title
FROM x_alerts WHERE lower(severity) IN ('high','critical') AND lower(type) IN ('llm','ml','suricata') AND (lower(type)<>'llm' OR ai_status='true_positive')""")
def _(t):
    return A.push_payloads(t.alerts, ["high", "critical"], ["llm", "ml", "suricata"], ["true_positive"]).select("id", "title")


@query("snk_03_patched_alerts", """
SELECT finding_id, arg_max(severity, ts_us) FILTER (WHERE severity IS NOT NULL) AS severity, arg_max(signature, ts_us) FILTER (WHERE signature IS NOT NULL) AS signature,
 arg_max(confidence, ts_us) FILTER (WHERE confidence IS NOT NULL) AS confidence FROM x_alerts GROUP BY 1""")
def _(t):
    return A.patched(t.alerts, ["finding_id"], "ts_us", ["severity", "signature", "confidence"])


@query("win_10_latest_version", """
SELECT finding_id, arg_max(id, ts_us) AS id, max(ts_us) AS ts_us FROM x_alerts GROUP BY 1""")
def _(t):
    return TI.latest(t.alerts.select("finding_id", "ts_us", "id"), ["finding_id"], "ts_us")
