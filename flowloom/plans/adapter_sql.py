"""The adapter views as SQL text, for the checks that compare with another engine."""

from __future__ import annotations

import re

_IP45 = "'45.' || cast({k} // 62500 AS varchar) || '.' || cast(({k} // 250) % 250 AS varchar) || '.' || cast({k} % 250 + 1 AS varchar)"
_FLOW_ID = ("(cast(l_orderkey AS bigint)*8+l_linenumber)*1000000 + (l_partkey % 1000)*1000 "
            "+ cast(floor(l_extendedprice*100+0.5) AS bigint) % 1000")

VIEWS: dict[str, str] = {
    "x_flows": f"""
SELECT {_FLOW_ID} AS flow_id, 'a' || (l_suppkey % 20) AS analysis_id,
  CASE WHEN l_orderkey % 3 = 0 THEN '10.0.0.7' ELSE '10.0.' || (l_orderkey % 2) || '.' || (l_orderkey % 200 + 1) END AS src_ip,
  CASE WHEN l_partkey % 5 = 0 THEN '192.168.1.' || (l_suppkey % 50 + 1)
       ELSE '45.33.' || (l_suppkey % 3) || '.' || (l_suppkey % 50 + 1) END AS dst_ip,
  cast(l_linenumber + 40000 AS bigint) AS src_port,
  cast(CASE l_partkey % 7 WHEN 0 THEN 22 WHEN 1 THEN 53 WHEN 2 THEN 80 WHEN 3 THEN 443 WHEN 4 THEN 445 WHEN 5 THEN 3389
       ELSE 1024 + l_partkey % 500 END AS bigint) AS dst_port,
  CASE WHEN l_partkey % 7 = 1 THEN 'UDP' ELSE 'TCP' END AS protocol,
  epoch_us(l_shipdate) + ((cast(l_orderkey AS bigint)*37 + l_partkey*11) % 86400)*1000000 AS start_us,
  cast(floor(l_quantity) AS bigint)*600000 AS duration_ms,
  cast(floor(l_extendedprice) AS bigint) AS bytes_sent, cast(floor(l_extendedprice*l_discount) AS bigint) AS bytes_recv,
  cast(floor(l_quantity) AS bigint) AS packets_sent, cast(l_linenumber AS bigint) AS packets_recv,
  CASE l_partkey % 11 WHEN 0 THEN 'SSH' WHEN 1 THEN 'HTTP' WHEN 2 THEN 'DNS' WHEN 3 THEN 'TLS' END AS application_layer,
  CASE WHEN l_partkey % 11 = 2 THEN substr(md5(cast(l_partkey AS varchar)),1,14) || '.zone.example' || (l_suppkey % 7) || '.com' END AS dns_query,
  CASE WHEN l_partkey % 11 = 1 THEN (CASE WHEN l_linenumber % 2 = 0 THEN 'login.site' ELSE 'www.site' END) || (l_suppkey % 9) || '.example.org' END AS http_host,
  CASE WHEN l_partkey % 11 = 3 AND l_partkey % 3 <> 0 THEN CASE WHEN l_suppkey % 5 = 0 THEN 'maps.google.com'
       ELSE 'host' || (l_suppkey % 13) || '.example.net' END END AS tls_sni,
  l_discount AS iat_mean, l_tax AS iat_std, l_discount*2 AS iat_max, l_tax/2 AS fwd_iat_mean,
  least(10.0, floor(l_extendedprice/100)/100) AS anomaly_score,
  l_partkey % 5 = 0 AS dst_internal
FROM lineitem""",
    "x_events": """
SELECT event_id AS seq, epoch_us(ts) AS ts_us,
  '10.0.' || (u % 4) || '.' || (u % 200 + 1) AS src_ip, '45.33.0.' || (k % 30 + 1) AS dst_ip, k + 5000 AS src_port,
  cast(CASE k % 10 WHEN 1 THEN 22 WHEN 2 THEN 21 WHEN 4 THEN 3389 ELSE k + 1000 END AS bigint) AS dst_port,
  CASE WHEN k % 5 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol,
  CASE WHEN event_id % 97 = 0 THEN 'nmap scan' WHEN event_id % 89 = 0 THEN 'hydra login failed'
       WHEN k % 10 = 3 THEN 'ssh session' ELSE 'event ' || event_type END AS info,
  event_type AS kind, cast(floor(value*100) AS bigint) AS length, value, event_id*7 % 64 AS tcp_flags, k
FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS u,
             cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events)""",
    "x_packets": """
SELECT seq, ts_us/1e6 AS ts, CASE WHEN back THEN server ELSE client END AS src_ip, CASE WHEN back THEN client ELSE server END AS dst_ip,
  CASE WHEN protocol='ICMP' THEN 0 WHEN back THEN sport ELSE cport END AS src_port,
  CASE WHEN protocol='ICMP' THEN 0 WHEN back THEN cport ELSE sport END AS dst_port,
  protocol, length AS payload_len, seq % 3 * 4 + 20 AS header_len, tcp_flags, seq % 500 + 1000 AS win,
  CASE WHEN seq % 11 = 0 THEN 22 ELSE 71 END AS first_byte, seq % 13 = 0 AS is_request,
  CASE WHEN k % 5 = 1 AND seq % 4 = 0 THEN 'h' || k || '.example.com' END AS sni,
  CASE WHEN k % 5 = 4 AND seq % 3 = 0 THEN 'w' || k || '.example.org:80' END AS http_host,
  CASE WHEN k % 5 = 2 THEN 'q' || (k % 7) || '.example.net' END AS dns_qname
FROM (SELECT *, src_ip AS client, dst_ip AS server, kind IN ('error','signup') AS back, k % 4 + 5000 AS cport,
        cast(CASE k % 5 WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 22 WHEN 4 THEN 80 ELSE 9000 END AS bigint) AS sport
      FROM (SELECT * REPLACE (CASE WHEN k % 5 = 2 THEN 'UDP' WHEN k % 25 = 0 THEN 'ICMP' ELSE 'TCP' END AS protocol) FROM x_events))""",
    "x_keyed": """
SELECT *, least(e1, e2) || '~' || greatest(e1, e2) || '~' || protocol AS fkey
FROM (SELECT *, src_ip || '#' || src_port AS e1, dst_ip || '#' || dst_port AS e2 FROM x_packets)""",
    "x_arp": """
SELECT CASE WHEN kind = 'click' THEN 1 ELSE 2 END AS op, 'mac-' || src_ip AS sender_mac, src_ip AS sender_ip,
  dst_ip AS target_ip, ts_us, ts_us/1e6 AS ts FROM x_events""",
    "x_findings": f"""
SELECT 'f' || ({_FLOW_ID}) AS finding_id, 'a' || (l_suppkey % 20) AS analysis_id, cast(l_orderkey AS bigint) AS flow_id,
  'R-' || (l_partkey % 9) AS rule_id,
  CASE l_suppkey % 5 WHEN 0 THEN 'rule' WHEN 1 THEN 'ml' WHEN 2 THEN 'ti_correlation' WHEN 3 THEN 'suricata' ELSE 'enrichment' END AS source,
  'title ' || l_linenumber AS title,
  CASE l_partkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity,
  floor(l_extendedprice/110)/100 AS severity_score,
  '45.33.' || (l_suppkey % 3) || '.' || (l_suppkey % 50 + 1) AS ev_src, '10.0.0.7' AS ev_dst,
  'host' || (l_suppkey % 13) || '.example.net' AS ev_domain, l_tax >= 0.07 AS is_false_positive
FROM lineitem""",
    "x_order_flows": """
SELECT cast(o_orderkey AS bigint) AS flow_id, '10.0.1.' || (o_custkey % 200 + 1) AS src_ip,
  '45.33.' || (o_custkey % 3) || '.' || (o_custkey % 50 + 1) AS dst_ip,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'host' || (o_orderkey % 13) || '.example.net' END AS tls_sni,
  'q' || (o_orderkey % 5) || '.example.com' AS dns_query,
  least(10.0, floor(o_totalprice/5000)/10) AS anomaly_score, CASE WHEN o_orderkey % 2 = 0 THEN 'TCP' ELSE 'UDP' END AS protocol
FROM orders""",
    "x_obs": f"""
SELECT *, n % 4 = 0 AS is_malicious, floor(abs(bal)/10)/1000 AS confidence,
  CASE WHEN n % 3 = 0 THEN 'complete' ELSE 'pending' END AS status, n % 2 = 0 AS has_intel,
  CASE WHEN nation % 5 = 0 THEN 0.0 ELSE nation*3.5 - 40 END AS lat, nation*7.0 - 80 AS lon, n % 6 = 0 AS newly_registered
FROM (SELECT 'ip' AS type, {_IP45.format(k='s_suppkey')} AS value, 'a' || (s_suppkey % 20) AS analysis_id, cast(s_suppkey AS bigint) AS n,
        s_acctbal AS bal, cast(s_nationkey AS bigint) AS nation FROM supplier
      UNION ALL SELECT 'domain', 'c' || c_custkey || '.example.com', 'a' || (c_custkey % 20), c_custkey, c_acctbal, c_nationkey FROM customer)""",
    "x_prov": """
SELECT type, value, CASE WHEN n % 7 <> 0 THEN n % 6 END AS vt, CASE WHEN n % 5 <> 0 THEN cast(floor(abs(bal)/100) AS bigint) END AS abuse,
  CASE WHEN n % 3 = 0 THEN n % 6 = 0 END AS new_domain, CASE WHEN n % 4 <> 1 THEN n % 5 END AS pulses,
  CASE WHEN n % 2 = 0 THEN n % 4 END AS sandbox,
  CASE n % 4 WHEN 0 THEN 'malicious' WHEN 1 THEN 'benign' WHEN 2 THEN 'unknown' END AS scanner, n % 9 = 0 AS known_good,
  CASE WHEN n % 3 <> 1 THEN n % 3 END AS vulns FROM x_obs""",
    "x_intel": f"""
SELECT 'ip' AS type, {_IP45.format(k='l_suppkey')} AS value,
  CASE l_linenumber % 3 WHEN 0 THEN 'vt' WHEN 1 THEN 'abuse' ELSE 'otx' END AS provider,
  epoch_us(l_shipdate) + cast(l_orderkey AS bigint) % 86400 * 1000000 AS fetched_us, cast(floor(l_quantity) AS bigint) AS score FROM lineitem""",
    "x_analyses": """
SELECT 'an' || o_orderkey AS analysis_id, o_orderpriority AS analysis_name, 'Capture-' || (o_orderkey % 50) || '.pcap' AS filename,
  CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'failed' ELSE 'running' END AS status,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'live' ELSE 'upload' END AS source,
  floor(o_totalprice/500)/100 AS risk_score, cast(o_orderkey % 97 AS bigint) AS total_flows, cast(o_orderkey % 13 AS bigint) AS total_findings,
  epoch_us(o_orderdate) AS created_at FROM orders""",
    "x_alerts": """
SELECT 'al' || seq AS id, 'al' || (seq % 100) AS finding_id, 's' || (seq % 3) AS session_id,
  CASE seq % 5 WHEN 0 THEN 'ml' WHEN 1 THEN 'suricata' WHEN 2 THEN 'correlation' WHEN 3 THEN 'LLM' ELSE 'Heuristic' END AS type, ts_us,
  CASE k % 5 WHEN 0 THEN 'info' WHEN 1 THEN 'Low' WHEN 2 THEN 'medium' WHEN 3 THEN 'HIGH' ELSE 'critical' END AS severity,
  CASE WHEN seq % 5 = 0 THEN floor(value*2.5)/100 END AS anomaly_score, CASE WHEN seq % 4 = 0 THEN k/100 END AS confidence,
  CASE WHEN seq % 5 = 1 THEN 'sig ' || (k % 9) END AS signature, CASE WHEN seq % 5 >= 3 THEN 'attack ' || (k % 4) END AS attack_type,
  'why ' || (k % 8) AS explanation, CASE WHEN seq % 2 = 0 THEN 'heuristic+llm' END AS models,
  CASE WHEN seq % 5 = 3 THEN CASE k % 2 WHEN 0 THEN 'true_positive' ELSE 'benign' END END AS ai_status,
  src_ip, dst_ip, src_port, dst_port, protocol FROM x_events""",
    "x_labelled": """
SELECT cast(d.doc_id AS bigint) AS doc_id, least(10.0, floor(n_chars/5)/100) AS score, toxic = 1 AS is_attack, lang AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "x_scored": """
SELECT flow_id, anomaly_score AS score, duration_ms > 20000000 AS is_attack, coalesce(application_layer, 'other') AS label FROM x_flows""",
    "x_models": """
SELECT cast(conv_id AS bigint) AS item, 'm' || (turn % 4) AS model, length(text) % 3 = 0 AS suspicious,
  CASE length(text) % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
  length(text) % 100 / 100 AS confidence,
  CASE length(text) % 3 WHEN 0 THEN 'true_positive' WHEN 1 THEN 'benign' ELSE 'open' END AS ai_status FROM conversations""",
    "x_hosts": "SELECT cast(page_id AS bigint) AS page_id, regexp_extract(url, '://([^/]+)', 1) AS host FROM pages",
}

# Literal forms of the scalar tests, with {c} for the column.
INTERNAL = ("({c} LIKE '10.%' OR {c} LIKE '192.168.%' OR {c} LIKE '127.%')")
IP_NUM = ("(cast(split_part({c},'.',1) AS bigint)*16777216 + cast(split_part({c},'.',2) AS bigint)*65536"
          " + cast(split_part({c},'.',3) AS bigint)*256 + cast(split_part({c},'.',4) AS bigint))")


def with_views(sql: str) -> str:
    """Prefix the query with the views it uses, each after the ones it reads itself."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(VIEWS[name])
                needed.append(name)

    need(sql)
    if not needed:
        return sql
    body = sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
