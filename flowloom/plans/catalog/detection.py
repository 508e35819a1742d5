"""Whitelists and detection rules over flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom import constants as K
from flowloom.functions import net, text
from flowloom.operators import findings as FI
from flowloom.operators import rules as R
from flowloom.operators import whitelist as W
from flowloom.plans.adapter_sql import INTERNAL, IP_NUM
from flowloom.plans.catalog import query
from flowloom.session import literal_frame

SRC_IN, DST_IN = INTERNAL.format(c="src_ip"), INTERNAL.format(c="dst_ip")
WL_PORTS = " OR ".join(f"(dst_port={p} AND protocol='{q}')" for p, q in K.WHITELIST_PORTS)


def _ranges(cidrs, col):
    return "(" + " OR ".join(
        "{} BETWEEN {} AND {}".format(IP_NUM.format(c=col), *net.cidr_bounds(c)) for c in cidrs) + ")"


NETS = ["45.33.0.0/27", "45.33.1.16/28", "45.33.1.0/26", "192.168.0.0/15"]
WL_FLAG = (f"({_ranges(['45.33.0.0/27'], 'dst_ip')} OR {WL_PORTS} OR coalesce(tls_sni LIKE '%.google.com' OR tls_sni = 'google.com', false))")


def white(t):
    return W.mark_whitelisted(t.wide.flows, cidrs=["45.33.0.0/27"])


@query("flt_07_whitelist_predicate", f"""
SELECT flow_id, {WL_FLAG} AS is_whitelisted FROM x_flows""")
def _(t):
    return white(t).select("flow_id", "is_whitelisted")


_REASON = f"""CASE WHEN {SRC_IN} AND {DST_IN} THEN 'local-only endpoints' WHEN {DST_IN} THEN 'internal destination'
  WHEN {WL_FLAG} THEN 'whitelisted flow' END"""


@query("flt_08_suppress_reason", f"""
SELECT coalesce({_REASON}, 'none') AS reason, count(*) AS n FROM x_flows GROUP BY 1""")
def _(t):
    marked = W.with_suppression(white(t))
    return marked.groupBy(F.coalesce("suppress_reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_09_signature_suppression", f"""
SELECT seq, src_ip, dst_ip FROM x_events WHERE kind='error' AND NOT ({_ranges(['45.33.0.0/28'], 'dst_ip')} OR {WL_PORTS})""")
def _(t):
    alerts = t.events.where("kind = 'error'")
    return W.unsuppressed_signatures(alerts, cidrs=["45.33.0.0/28"]).select("seq", "src_ip", "dst_ip")


@query("join_02_cidr_membership", f"""
SELECT dst_ip, count(*) AS flows FROM x_flows WHERE {_ranges(NETS, 'dst_ip')} GROUP BY 1""")
def _(t):
    hit = W.mark_networks(t.wide.flows.select("dst_ip"), "dst_ip", W.networks_frame(t.spark, NETS))
    return hit.where("in_network").groupBy("dst_ip").agg(F.count(F.lit(1)).alias("flows"))


@query("join_03_cdn_membership", f"""
SELECT dst_port, count(*) AS flows, count(*) FILTER (WHERE dst_port IN (80,443) AND {_ranges(NETS, 'dst_ip')}) AS cdn
FROM x_flows GROUP BY 1""")
def _(t):
    return W.mark_cdn(t.wide.flows, cidrs=NETS).groupBy("dst_port").agg(
        F.count(F.lit(1)).alias("flows"), F.count_if("is_cdn").alias("cdn"))


@query("join_04_domain_patterns", """
SELECT page_id, host FROM x_hosts WHERE host LIKE '%.example.org' OR host = 'example.org'
 OR host IN (SELECT host FROM x_hosts WHERE host LIKE 'th%')""")
def _(t):
    exact = t.hosts.where("host LIKE 'th%'").select(F.col("host").alias("pattern"))
    wild = literal_frame(t.spark, [("*.example.org",)], "pattern STRING")
    return W.matching_hosts(t.hosts, exact.unionByName(wild)).select("page_id", "host")


@query("join_05_port_protocol_semi", f"""
SELECT flow_id, dst_port, protocol FROM x_flows WHERE {WL_PORTS}""")
def _(t):
    listed = literal_frame(t.spark, K.WHITELIST_PORTS, "dst_port BIGINT, protocol STRING")
    return t.flows.join(F.broadcast(listed), ["dst_port", "protocol"], "left_semi").select(
        "flow_id", "dst_port", "protocol")  # a literal list of five pairs


# ---- rules. Thresholds fit the month-long adapter timeline -----------------------------------
DAY = 86400


@query("rule_01_portscan_horizontal", """
SELECT src_ip, dst_ip, count(*) AS flow_count, count(DISTINCT dst_port) AS ports_scanned,
  (max(start_us)-min(start_us))/1e6 AS span_s, min(flow_id) AS flow_id FROM x_flows GROUP BY 1,2
HAVING count(*)>=8 AND count(DISTINCT dst_port)>=8 AND (max(start_us)-min(start_us))/1e6 <= 250000000""")
def _(t):
    return R.horizontal_scan(t.flows, min_ports=8, window_s=250_000_000)


@query("rule_02_host_sweep", """
SELECT src_ip, dst_port, count(DISTINCT dst_ip) AS hosts_scanned, (max(start_us)-min(start_us))/1e6 AS span_s,
  min(flow_id) AS flow_id FROM x_flows GROUP BY 1,2
HAVING count(DISTINCT dst_ip)>=30 AND (max(start_us)-min(start_us))/1e6 <= 250000000""")
def _(t):
    return R.host_sweep(t.flows, min_hosts=30, window_s=250_000_000)


def _beacon_sql(conn, lo, hi, jitter):
    return f"""
WITH g AS (SELECT src_ip, dst_ip, dst_port, flow_id,
  (start_us - lag(start_us) OVER (PARTITION BY src_ip, dst_ip, dst_port ORDER BY start_us, flow_id))/1e6 AS gap
  FROM x_flows WHERE NOT {DST_IN}),
s AS (SELECT src_ip, dst_ip, dst_port, min(flow_id) AS flow_id, count(*) AS connections,
  count(*) FILTER (WHERE gap BETWEEN {lo} AND {hi}) AS gaps, avg(gap) FILTER (WHERE gap BETWEEN {lo} AND {hi}) AS m,
  stddev_pop(gap) FILTER (WHERE gap BETWEEN {lo} AND {hi}) AS sd FROM g GROUP BY 1,2,3)
SELECT src_ip, dst_ip, dst_port, flow_id, connections, gaps, round(m,2) AS mean_interval_s, round(sd/m*100,2) AS jitter_pct
FROM s WHERE connections>={conn} AND gaps>={conn}-1 AND m>0 AND sd/m<={jitter}/100.0"""


@query("rule_03_beacon", _beacon_sql(4, 1000, 12_000_000, 90))
def _(t):
    return R.beacons(t.wide.flows, 4, 90, 1000, 12_000_000)


@query("rule_04_slow_beacon", _beacon_sql(3, 1800, 8_640_000, 60))
def _(t):
    return R.slow_beacons(t.flows, 3, 60, 1800, 8_640_000)


# ---- the same rules for each analysis apart, in one job ---------------------------------------
BY = ["analysis_id"]


@query("rule_01_portscan_by_analysis", """
SELECT analysis_id, src_ip, dst_ip, count(*) AS flow_count, count(DISTINCT dst_port) AS ports_scanned,
  (max(start_us)-min(start_us))/1e6 AS span_s, min(flow_id) AS flow_id FROM x_flows GROUP BY 1,2,3
HAVING count(*)>=3 AND count(DISTINCT dst_port)>=3 AND (max(start_us)-min(start_us))/1e6 <= 250000000""")
def _(t):
    return R.horizontal_scan(t.flows, 3, 250_000_000, BY)


@query("rule_02_host_sweep_by_analysis", """
SELECT analysis_id, src_ip, dst_port, count(DISTINCT dst_ip) AS hosts_scanned, (max(start_us)-min(start_us))/1e6 AS span_s,
  min(flow_id) AS flow_id FROM x_flows GROUP BY 1,2,3
HAVING count(DISTINCT dst_ip)>=4 AND (max(start_us)-min(start_us))/1e6 <= 250000000""")
def _(t):
    return R.host_sweep(t.flows, 4, 250_000_000, BY)


@query("rule_03_beacon_by_analysis", _beacon_sql(3, 1000, 12_000_000, 90).replace("src_ip, dst_ip, dst_port", "analysis_id, src_ip, dst_ip, dst_port").replace("GROUP BY 1,2,3", "GROUP BY 1,2,3,4"))
def _(t):
    return R.beacons(t.wide.flows, 3, 90, 1000, 12_000_000, BY)


@query("rule_06_dns_frequency_by_analysis", """
WITH g AS (SELECT analysis_id, src_ip, substr(dns_query, 21) AS apex, count(*) AS queries, (max(start_us)-min(start_us))/1e6 AS span FROM x_flows
  WHERE dns_query IS NOT NULL GROUP BY 1, 2, 3)
SELECT analysis_id, src_ip, apex, queries, round(queries/greatest(1.0, span/60),1) AS queries_per_minute FROM g
WHERE queries>=0.00002 AND queries/greatest(1.0, span/60)>=0.00002""")
def _(t):
    return R.dns_rate(t.flows, 0.00002, BY)


@query("rule_07_lateral_movement_by_analysis", f"""
SELECT analysis_id, src_ip, count(DISTINCT dst_ip) AS targets FROM x_flows WHERE dst_port IN (445,3389,5985) AND {SRC_IN} AND {DST_IN}
GROUP BY 1,2 HAVING count(DISTINCT dst_ip)>=2""")
def _(t):
    return R.lateral_movement(t.wide.flows, min_targets=2, by=BY).drop("ports")


@query("rule_11_exfiltration_by_analysis", f"""
WITH m AS (SELECT analysis_id, avg(bytes_sent) AS m FROM x_flows WHERE bytes_sent>0 GROUP BY 1)
SELECT analysis_id, flow_id, dst_ip, bytes_sent, round(m,0) AS baseline_mean FROM x_flows JOIN m USING (analysis_id)
WHERE bytes_sent>m*1.9 AND {SRC_IN} AND NOT {DST_IN}""")
def _(t):
    return R.exfiltration(t.wide.flows, 1.9, BY)


@query("rule_05_dns_payload", """
SELECT flow_id, bytes_sent+bytes_recv AS payload_bytes FROM x_flows WHERE application_layer='DNS' AND bytes_sent+bytes_recv>90000""")
def _(t):
    return R.large_dns(t.flows, 90000)


@query("rule_06_dns_frequency", """
WITH g AS (SELECT src_ip, substr(dns_query, 21) AS apex, count(*) AS queries, (max(start_us)-min(start_us))/1e6 AS span FROM x_flows
  WHERE dns_query IS NOT NULL GROUP BY 1, 2)
SELECT src_ip, apex, queries, round(queries/greatest(1.0, span/60),1) AS queries_per_minute FROM g
WHERE queries>=0.00002 AND queries/greatest(1.0, span/60)>=0.00002""")
def _(t):
    return R.dns_rate(t.flows, 0.00002)


@query("rule_07_lateral_movement", f"""
SELECT src_ip, count(DISTINCT dst_ip) AS targets, string_agg(DISTINCT dst_port::varchar, ',' ORDER BY dst_port::varchar) AS ports FROM x_flows WHERE dst_port IN (445,3389,5985) AND {SRC_IN} AND {DST_IN}
GROUP BY 1 HAVING count(DISTINCT dst_ip)>=10""")
def _(t):
    found = R.lateral_movement(t.wide.flows, min_targets=10)
    return found.withColumn("ports", F.array_join(F.array_sort(F.transform("ports", lambda p: p.cast("string"))), ","))


_LABEL = "split_part(dns_query,'.',1)"
_ENT = """(SELECT -sum(c/n*log2(c/n)) FROM (SELECT count(*)::double AS c, sum(count(*)) OVER ()::double AS n
  FROM (SELECT unnest(string_split({s}, '')) AS ch) GROUP BY ch))"""


def _entropy_cte(source_sql, col):
    """Entropy of each distinct value of ``col``, by plain grouping."""
    return f"""chars AS (SELECT DISTINCT {col} AS lab FROM {source_sql}),
ch AS (SELECT lab, unnest(string_split(lab,'')) AS c FROM chars),
ent AS (SELECT lab, -sum(n/len*log2(n/len)) AS e FROM (SELECT lab, c, count(*)::double AS n, length(lab)::double AS len FROM ch GROUP BY lab, c) GROUP BY lab)"""


def _bigram_cte(source_sql, col):
    return f"""labs AS (SELECT DISTINCT {col} AS lab FROM {source_sql}),
bi AS (SELECT lab, substr(lab, i::bigint, 2) AS b FROM (SELECT lab, unnest(range(1, length(lab))) AS i FROM labs)),
bent AS (SELECT lab, -sum(n/t*log2(n/t)) AS e FROM (SELECT lab, b, count(*)::double AS n, (length(lab)-1)::double AS t FROM bi GROUP BY lab, b) GROUP BY lab)"""


@query("rule_08_dns_entropy", f"""
WITH {_entropy_cte('x_flows', _LABEL)}
SELECT flow_id, dns_query AS domain, round(e,2) AS entropy FROM x_flows JOIN ent ON lab={_LABEL} WHERE e>=3.1""")
def _(t):
    return R.entropic_labels(t.wide.dns, 3.1)


@query("rule_09_arp_requests", """
SELECT sender_mac, ts, op FROM x_arp WHERE op=1""")
def _(t):
    return R.arp_requests(t.arp).select("sender_mac", "ts", F.col("op").cast("bigint").alias("op"))


@query("rule_10_arp_storm", """
WITH c AS (SELECT sender_mac, ts, count(*) OVER (PARTITION BY sender_mac ORDER BY ts_us RANGE BETWEEN CURRENT ROW AND 86400000000 FOLLOWING) AS n
  FROM x_arp WHERE op=2)
SELECT sender_mac, min(ts) AS window_start, arg_min(n, ts) AS reply_count FROM c WHERE n>=5 GROUP BY 1""")
def _(t):
    return R.arp_storm(t.arp, min_replies=5, window_s=DAY)


@query("rule_11_exfiltration", f"""
WITH m AS (SELECT avg(bytes_sent) AS m FROM x_flows WHERE bytes_sent>0)
SELECT flow_id, dst_ip, bytes_sent, round(m,0) AS baseline_mean FROM x_flows, m WHERE bytes_sent>m*1.9 AND {SRC_IN} AND NOT {DST_IN}""")
def _(t):
    return R.exfiltration(t.wide.flows, 1.9)


@query("rule_12_port_mismatch", """
SELECT flow_id, application_layer, dst_port FROM x_flows WHERE (application_layer='SSH' AND dst_port<>22)
 OR (application_layer='HTTP' AND dst_port NOT IN (80,443,8080,8000)) OR (application_layer='DNS' AND dst_port<>53)""")
def _(t):
    return R.port_mismatch(t.flows)


_CV = (f"length(regexp_replace({_LABEL},'[^b-df-hj-np-tv-z]','','g'))"
       f"/greatest(length(regexp_replace({_LABEL},'[^aeiou]','','g')),1)")


@query("rule_13_generated_domain", f"""
WITH {_bigram_cte('x_flows', _LABEL)}
SELECT flow_id, dns_query AS domain, round({_CV},2) AS cv_ratio, round(e,2) AS bigram_entropy
FROM x_flows JOIN bent ON lab={_LABEL} WHERE {_CV}>3 OR e>3.6""")
def _(t):
    return R.generated_domains(t.wide.dns, 3, 3.6)


@query("rule_14_tls_without_sni", f"""
SELECT flow_id, dst_ip, dst_port FROM x_flows WHERE application_layer='TLS' AND tls_sni IS NULL AND NOT {DST_IN}""")
def _(t):
    return R.tls_without_sni(t.flows)


@query("rule_15_cleartext_login", """
SELECT flow_id, dst_port, http_host FROM x_flows WHERE application_layer='HTTP' AND dst_port<>443 AND (http_host LIKE '%login%' OR http_host LIKE '%auth%')""")
def _(t):
    return R.cleartext_logins(t.flows).select("flow_id", "dst_port", F.get("http_hosts", F.lit(0)).alias("http_host"))


@query("rule_16_new_domain", "SELECT value AS domain FROM x_obs WHERE type='domain' AND newly_registered")
def _(t):
    return R.new_domains(t.observables).select("domain")


@query("rule_17_long_connection", """
SELECT flow_id, dst_ip, round(duration_ms/3600000.0,2) AS duration_hours FROM x_flows WHERE protocol='TCP' AND duration_ms>=28800000""")
def _(t):
    return R.long_connections(t.flows)


@query("rule_18_signature_threshold", """
SELECT (ts_us // 86400000000)*86400 AS window_start_s, src_ip, count(*) AS hits FROM x_events
WHERE protocol='TCP' AND dst_port=22 AND (tcp_flags & 2)<>0 GROUP BY 1,2 HAVING count(*)>=3""")
def _(t):
    return R.signature_threshold(t.events, 22, 3, "1 day").select(
        F.unix_seconds("window_start").alias("window_start_s"), "src_ip", "hits")


@query("rule_19_anomaly_finding", f"""
SELECT flow_id, anomaly_score FROM x_flows WHERE anomaly_score>=9 AND {_REASON} IS NULL""")
def _(t):
    return R.anomaly_findings(W.with_suppression(white(t)), 9.0).select("flow_id", "anomaly_score")


@query("prj_09_rule_findings", f"""
SELECT rule_id, severity, severity_score, count(*) AS n, count(DISTINCT flow_id) AS flows FROM (
 SELECT 'DNSTUNNEL-001' AS rule_id, 'medium' AS severity, 5.0::double AS severity_score, flow_id FROM x_flows WHERE application_layer='DNS' AND bytes_sent+bytes_recv>200
 UNION ALL SELECT 'PORTMISMATCH-001','medium',5.0,flow_id FROM x_flows WHERE (application_layer='SSH' AND dst_port<>22)
  OR (application_layer='HTTP' AND dst_port NOT IN (80,443,8080,8000)) OR (application_layer='DNS' AND dst_port<>53)
 UNION ALL SELECT 'TLSNONSNI-001','low',3.0,flow_id FROM x_flows WHERE application_layer='TLS' AND tls_sni IS NULL AND NOT {DST_IN}
 UNION ALL SELECT 'CLEARTEXT-001','high',8.0,flow_id FROM x_flows WHERE application_layer='HTTP' AND dst_port<>443 AND http_host LIKE 'login%'
 UNION ALL SELECT 'LONGCONN-001','high',8.0,flow_id FROM x_flows WHERE protocol='TCP' AND duration_ms>=28800000) GROUP BY 1,2,3""")
def _(t):
    found = FI._with_rule_fields(R.single_flow_hits(t.wide.flows), F.col("rule_id"), F.lit("all"))
    return found.groupBy("rule_id", "severity", "severity_score").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("flow_id").alias("flows"))


_PORT_PARAMS = {
    "horizontal_scan": {"min_ports": 8, "window_s": 250_000_000}, "host_sweep": {"min_hosts": 30, "window_s": 250_000_000},
    "beacons": {"min_connections": 4, "max_jitter_pct": 90, "min_interval_s": 1000, "max_interval_s": 12_000_000},
    "slow_beacons": {"min_connections": 3, "max_jitter_pct": 60, "min_interval_s": 1800, "max_interval_s": 8_640_000},
    "dns_rate": {"queries_per_minute": 0.00002}, "entropic_labels": {"min_entropy": 3.1},
    "generated_domains": {"min_bigram_entropy": 3.6}, "exfiltration": {"multiplier": 1.9},
    "lateral_movement": {"min_targets": 10}, "arp_storm": {"min_replies": 5, "window_s": DAY},
}


def _counts(rule_id: str, severity: str, sql: str) -> str:
    return f"SELECT '{rule_id}' AS rule_id, '{severity}' AS severity, count(*) AS n FROM ({sql}) HAVING count(*)>0"


def _all_rules_sql() -> str:
    """The rules' own SQL, counted; rules over single flows come from their shared query."""
    from flowloom.plans.catalog import _REGISTRY

    grouped = {"PORTSCAN-001": "rule_01_portscan_horizontal", "PORTSCAN-002": "rule_02_host_sweep", "BEACON-001": "rule_03_beacon",
               "BEACON-002": "rule_04_slow_beacon", "DNSTUNNEL-002": "rule_06_dns_frequency", "LATERAL-001": "rule_07_lateral_movement",
               "DNSTUNNEL-003": "rule_08_dns_entropy", "ARPSPOOFING-001": "rule_09_arp_requests", "ARPSPOOFING-002": "rule_10_arp_storm",
               "EXFIL-001": "rule_11_exfiltration", "DGATOP-001": "rule_13_generated_domain", "NEWDOMAIN-001": "rule_16_new_domain"}
    parts = [_counts(rid, R.RULES[rid].severity, _REGISTRY[name].sql) for rid, name in grouped.items()]
    return " UNION ALL ".join(parts) + f" UNION ALL SELECT rule_id, severity, n FROM ({_REGISTRY['prj_09_rule_findings'].sql})"


@query("set_01_all_rule_findings", _all_rules_sql(), views=False)
def _(t):
    """Every rule at once, counted per rule."""
    found = FI.rule_findings(t.wide.flows, t.arp, t.observables, **_PORT_PARAMS)
    return found.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))
