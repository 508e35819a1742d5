"""Scalar functions, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom import constants as K
from flowloom.functions import net, sqlfunctions, text, values
from flowloom.operators import alerts as A
from flowloom.operators import features as FT
from flowloom.operators import incidents as I
from flowloom.operators import intel as TI
from flowloom.operators import report as RP
from flowloom.plans.adapter_sql import INTERNAL
from flowloom.plans.catalog import query
from flowloom.plans.catalog.detection import _bigram_cte, _entropy_cte

c = F.col
SRC_IN, DST_IN = INTERNAL.format(c="src_ip"), INTERNAL.format(c="dst_ip")

# Addresses of every scope, formed from the user id of each event.
_PROBE = """(SELECT event_id, CASE event_id % 16
 WHEN 0 THEN '10.' || (user_id % 256) || '.0.1' WHEN 1 THEN '172.' || (user_id % 40) || '.1.1' WHEN 2 THEN '192.' || (160 + user_id % 16) || '.7.7'
 WHEN 3 THEN '169.254.' || (user_id % 256) || '.9' WHEN 4 THEN '198.' || (10 + user_id % 50) || '.100.1' WHEN 5 THEN (200 + user_id % 60) || '.1.2.3'
 WHEN 6 THEN '203.0.' || (user_id % 120) || '.4' WHEN 7 THEN '' WHEN 8 THEN 'not-an-ip' WHEN 9 THEN '100.' || (user_id % 256) || '.0.1'
 WHEN 10 THEN '127.0.0.' || (user_id % 256) WHEN 11 THEN '0.0.0.0' WHEN 12 THEN '192.0.' || (user_id % 4) || '.' || (user_id % 256)
 WHEN 13 THEN '8.8.8.' || (user_id % 300) WHEN 14 THEN 'fe80::' || (user_id % 10) ELSE '2606:4700::' || (user_id % 10) END AS ip FROM events)"""


def _probe(t):
    u, e = c("user_id").cast("bigint"), c("event_id").cast("bigint")

    def s(x):
        return x.cast("string")

    ip = F.element_at(F.array(
        F.concat(F.lit("10."), s(u % 256), F.lit(".0.1")), F.concat(F.lit("172."), s(u % 40), F.lit(".1.1")),
        F.concat(F.lit("192."), s(u % 16 + 160), F.lit(".7.7")), F.concat(F.lit("169.254."), s(u % 256), F.lit(".9")),
        F.concat(F.lit("198."), s(u % 50 + 10), F.lit(".100.1")), F.concat(s(u % 60 + 200), F.lit(".1.2.3")),
        F.concat(F.lit("203.0."), s(u % 120), F.lit(".4")), F.lit(""), F.lit("not-an-ip"),
        F.concat(F.lit("100."), s(u % 256), F.lit(".0.1")), F.concat(F.lit("127.0.0."), s(u % 256)), F.lit("0.0.0.0"),
        F.concat(F.lit("192.0."), s(u % 4), F.lit("."), s(u % 256)), F.concat(F.lit("8.8.8."), s(u % 300)),
        F.concat(F.lit("fe80::"), s(u % 10)), F.concat(F.lit("2606:4700::"), s(u % 10))), (e % 16 + 1).cast("int"))
    return t.read("events").select(e.alias("event_id"), ip.alias("ip"))


_OCTETS = "regexp_matches(ip, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$')"
_PARTS = f"""SELECT event_id, ip, {_OCTETS} AS v4,
 try_cast(split_part(ip,'.',1) AS int) AS a, try_cast(split_part(ip,'.',2) AS int) AS b,
 try_cast(split_part(ip,'.',3) AS int) AS d, try_cast(split_part(ip,'.',4) AS int) AS e FROM {_PROBE}"""
_VALID = "v4 AND greatest(a,b,d,e) <= 255"
_PRIV = """(a IN (0,10,127) OR a>=240 OR (a=172 AND b BETWEEN 16 AND 31) OR (a=192 AND b=168) OR (a=169 AND b=254)
 OR (a=198 AND b IN (18,19)) OR (a=192 AND b=0 AND d=0 AND e NOT IN (9,10)) OR (a=192 AND b=0 AND d=2) OR (a=198 AND b=51 AND d=100) OR (a=203 AND b=0 AND d=113))"""


@query("scl_01_internal_ip", f"""
SELECT event_id, ip, CASE WHEN ip='' THEN true WHEN ip LIKE 'fe80%' THEN true WHEN {_VALID} THEN {_PRIV} OR a BETWEEN 224 AND 239
 ELSE false END AS internal FROM ({_PARTS})""")
def _(t):
    return _probe(t).withColumn("internal", net.is_internal_ip(c("ip")))


@query("scl_02_ip_scope", f"""
SELECT event_id, CASE WHEN ip='' THEN 'none' WHEN ip LIKE 'fe80%' THEN 'link_local' WHEN ip LIKE '2606%' THEN 'public'
 WHEN NOT ({_VALID}) THEN 'invalid' WHEN a=127 THEN 'loopback' WHEN a=169 AND b=254 THEN 'link_local' WHEN a BETWEEN 224 AND 239 THEN 'multicast'
 WHEN {_PRIV} THEN 'private' ELSE 'public' END AS scope,
 coalesce({_VALID} AND {_PRIV}, false) OR ip LIKE 'fe80%' AS private FROM ({_PARTS})""")
def _(t):
    return _probe(t).select("event_id", net.ip_scope(c("ip")).alias("scope"), net.is_private_ip(c("ip")).alias("private"))


@query("scl_03_local_only", f"""
SELECT flow_id, {SRC_IN} AND {DST_IN} AS local_only, {DST_IN} AND dst_port IN (1900,5353,5355,67,68) AND protocol='UDP' AS lan_service FROM x_flows""")
def _(t):
    return t.flows.select("flow_id", net.is_local_only(c("src_ip"), c("dst_ip")).alias("local_only"),
                          net.is_lan_service(c("dst_ip"), c("dst_port"), c("protocol")).alias("lan_service"))


@query("scl_04_protocol_code", """
SELECT l_orderkey, l_linenumber::bigint AS line, p, cast(CASE WHEN upper(p) IN ('TCP','6') THEN 1 WHEN upper(p) IN ('UDP','17') THEN 2
 WHEN upper(p) IN ('ICMP','1') THEN 3 ELSE 0 END AS bigint) AS code FROM (SELECT *, CASE l_partkey % 9 WHEN 0 THEN 'tcp' WHEN 1 THEN 'UDP' WHEN 2 THEN 'Icmp'
 WHEN 3 THEN '6' WHEN 4 THEN '17' WHEN 5 THEN '1' WHEN 6 THEN '99' WHEN 7 THEN '' ELSE 'GRE' END AS p FROM lineitem)""")
def _(t):
    p = F.element_at(F.array(*map(F.lit, ["tcp", "UDP", "Icmp", "6", "17", "1", "99", "", "GRE"])),
                     (c("l_partkey") % 9 + 1).cast("int"))
    return t.read("lineitem").select("l_orderkey", c("l_linenumber").cast("bigint").alias("line"), p.alias("p"),
                                     values.encode_protocol(p).cast("bigint").alias("code"))


@query("scl_05_unit_conversions", """
SELECT l_orderkey, l_partkey, greatest(x,0.0)/1000.0 AS ms, greatest(x,0.0)/1000000.0 AS s, l_tax*1000000.0 AS us
FROM (SELECT *, l_extendedprice*10-100000 AS x FROM lineitem)""")
def _(t):
    x = c("l_extendedprice") * 10 - 100000
    return t.read("lineitem").select("l_orderkey", "l_partkey", values.us_to_ms(x).alias("ms"),
                                     values.us_to_seconds(x).alias("s"), values.seconds_to_us(c("l_tax")).alias("us"))


@query("scl_06_shannon_entropy", f"""
WITH {_entropy_cte('x_hosts', 'host')} SELECT page_id, round(e,6) AS entropy FROM x_hosts JOIN ent ON lab=host""")
def _(t):
    return t.hosts.select("page_id", F.round(text.shannon_entropy(c("host")), 6).alias("entropy"))


@query("scl_07_consonant_ratio", """
SELECT page_id, round(length(regexp_replace(lower(host),'[^b-df-hj-np-tv-z]','','g'))/greatest(length(regexp_replace(lower(host),'[^aeiou]','','g')),1),6) AS ratio FROM x_hosts""")
def _(t):
    return t.hosts.select("page_id", F.round(text.consonant_vowel_ratio(c("host")), 6).alias("ratio"))


@query("scl_08_bigram_entropy", f"""
WITH {_bigram_cte('x_hosts', 'host')} SELECT page_id, round(e,6) AS entropy FROM x_hosts JOIN bent ON lab=host""")
def _(t):
    return t.hosts.select("page_id", F.round(text.bigram_entropy(c("host")), 6).alias("entropy"))


@query("scl_09_domain_parts", """
SELECT page_id, CASE WHEN len(string_split(host,'.'))>1 THEN string_split(host,'.')[-2] || '.' || string_split(host,'.')[-1] ELSE host END AS apex,
 string_split(host,'.')[1] AS first_label, len(string_split(host,'.'))::bigint AS labels, split_part(host || ':8080', ':', 1) AS bare FROM x_hosts""")
def _(t):
    h = c("host")
    return t.hosts.select("page_id", text.apex_domain(h).alias("apex"), text.first_label(h).alias("first_label"),
                          text.label_count(h).cast("bigint").alias("labels"),
                          text.strip_port(F.concat(h, F.lit(":8080"))).alias("bare"))


@query("scl_10_target_typing", f"""
SELECT event_id, CASE WHEN {_VALID} OR ip LIKE '%::%' THEN 'ip' WHEN position('.' IN ip)>0 AND position(' ' IN ip)=0 THEN 'domain' ELSE 'none' END AS kind
FROM ({_PARTS})""")
def _(t):
    ip = c("ip")
    return _probe(t).select("event_id", F.when(net.is_ip(ip), "ip").when(text.looks_like_domain(ip), "domain").otherwise("none").alias("kind"))


@query("scl_12_packet_severity", """
SELECT seq, CASE WHEN dst_port IN (4444,31337,6667,1337) THEN 'critical' WHEN dst_port IN (22,23,445,1433,3389,4444,5900,6667,31337) THEN 'high'
 WHEN protocol IN ('TCP','UDP') THEN 'medium' WHEN info LIKE '%scan%' THEN 'high' ELSE 'info' END AS severity FROM x_events""")
def _(t):
    return t.events.select("seq", net.packet_severity(c("dst_ip"), c("dst_port"), c("protocol"), c("info")).alias("severity"))


@query("scl_13_tls_fingerprint", """
SELECT seq, md5('771,' || k || '-' || (k+1) || ',0-' || (k % 20) || ',29-23,0') AS fingerprint FROM x_events""")
def _(t):
    def ints(*xs):
        return F.array(*[(x if not isinstance(x, int) else F.lit(x)).cast("int") for x in xs])

    return t.events.select("seq", net.tls_fingerprint(F.lit(771), ints(c("k"), c("k") + 1), ints(0, c("k") % 20), ints(29, 23), ints(0)).alias("fingerprint"))


@query("scl_14_severity_maps", """
SELECT finding_id, CASE severity WHEN 'critical' THEN 10.0 WHEN 'high' THEN 8.0 WHEN 'medium' THEN 5.0 WHEN 'low' THEN 3.0 ELSE 1.0 END::double AS score,
 CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END::bigint AS merge_rank,
 CASE lev WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'medium' END AS alert_level,
 CASE lev WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' ELSE 'high' END AS display_level,
 CASE lev WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS finding_level
FROM (SELECT *, length(title || finding_id) % 5 AS lev FROM x_findings)""")
def _(t):
    lev = F.length(F.concat("title", "finding_id")) % 5
    return t.findings.select(
        "finding_id", values.severity_score(c("severity")).alias("score"), values.merge_rank(c("severity")).cast("bigint").alias("merge_rank"),
        *[values.signature_severity(lev, v).alias(f"{v}_level") for v in ("alert", "display", "finding")])


@query("scl_15_time_parsing", """
SELECT event_id, epoch_us(ts) AS iso_us, epoch_us(date_trunc('second', ts)) AS number_us, CASE WHEN event_id % 2 = 0 THEN hour(ts) ELSE 12 END::bigint AS hour_or_noon FROM events""")
def _(t):
    ts = c("ts").cast("timestamp")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    bad = F.when(c("event_id") % 2 == 0, iso).otherwise("garbage")
    return t.read("events").select(
        c("event_id").cast("bigint").alias("event_id"), F.unix_micros(values.parse_time(iso)).alias("iso_us"),
        F.unix_micros(values.parse_time(F.unix_seconds(ts).cast("string"))).alias("number_us"),
        values.hour_or_noon(values.parse_time(bad)).cast("bigint").alias("hour_or_noon"))


@query("scl_16_keyword_hit", """
SELECT seq, CASE WHEN info LIKE '%scan%' OR info LIKE '%nmap%' THEN 'scan' WHEN dst_port IN (22,21,23,3389,445,1433) AND info LIKE '%hydra%' THEN 'brute' END AS hit FROM x_events""")
def _(t):
    from flowloom.operators.heuristics import keyword_hit

    return t.events.select("seq", keyword_hit().alias("hit"))


@query("scl_17_json_helpers", """
SELECT seq, json_extract_string('{"a":{"k":' || k || '}}', '$.a.k')::bigint AS k, substr('{"seq":' || seq || ',"kind":"' || kind || '"}', 1, 12) AS cut FROM x_events""")
def _(t):
    wrapped = F.concat(F.lit('Sure: {"a":{"k":'), c("k").cast("string"), F.lit("}} done"))
    return t.events.select("seq", F.get_json_object(text.first_json_object(wrapped), "$.a.k").cast("bigint").alias("k"),
                           text.truncated_json(F.struct("seq", "kind"), 12).alias("cut"))


@query("scl_18_value_key", "SELECT page_id, substr(sha256(host),1,16) AS k FROM x_hosts")
def _(t):
    return t.hosts.select("page_id", text.value_key(c("host")).alias("k"))


@query("scl_19_keys", """
SELECT seq, least(src_ip,dst_ip) || '|' || greatest(src_ip,dst_ip) AS pair,
 src_ip || '|' || dst_ip || '|' || src_port || '|' || dst_port || '|' || protocol AS connection FROM x_events""")
def _(t):
    return t.events.select("seq", text.pair_key(c("src_ip"), c("dst_ip")).alias("pair"), text.connection_key(
        *[c(n) for n in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")]).alias("connection"))


_BASE = """(CASE WHEN vt>2 THEN 0.4 ELSE 0 END + CASE WHEN abuse>25 THEN 0.35 ELSE 0 END + CASE WHEN new_domain THEN 0.25 ELSE 0 END
 + CASE WHEN pulses>2 THEN 0.25 ELSE 0 END + CASE WHEN sandbox=1 THEN 0.15 WHEN sandbox>=2 THEN 0.35 ELSE 0 END)::double"""
VERDICT_SQL = f"""SELECT *, round(least(1.0, CASE WHEN scanner='malicious' THEN base+0.3 WHEN known_good OR scanner='benign' THEN greatest(0.0, base-0.2) ELSE base END
 + CASE WHEN vulns>0 THEN 0.1 ELSE 0 END),6)::double AS conf,
 coalesce(vt>2,false) OR coalesce(abuse>25,false) OR coalesce(new_domain,false) OR coalesce(pulses>2,false) OR coalesce(sandbox>=2,false) OR coalesce(scanner='malicious',false) AS bad
 FROM (SELECT *, {_BASE} AS base FROM x_prov)"""


@query("scl_20_intel_verdict", f"""
SELECT type, value, bad AS is_malicious, conf AS confidence, ((vt IS NOT NULL)::int + (abuse IS NOT NULL)::int + (new_domain IS NOT NULL)::int + (pulses IS NOT NULL)::int
 + (sandbox IS NOT NULL)::int + (scanner IS NOT NULL)::int + (vulns IS NOT NULL)::int)::bigint AS signals FROM ({VERDICT_SQL})""")
def _(t):
    return TI.with_verdict(t.providers).select("type", "value", "is_malicious", F.round("confidence", 6).alias("confidence"),
                                               F.size("signals").cast("bigint").alias("signals"))


@query("scl_21_domain_age_and_sandbox", """
SELECT o_orderkey, o_orderdate > (timestamp '1999-01-01' - interval 30 days) AS young,
 CASE o_orderkey % 4 WHEN 1 THEN 'Suspicious' WHEN 2 THEN 'Malicious' ELSE 'No info' END AS verdict FROM orders""")
def _(t):
    return t.read("orders").select(
        "o_orderkey", values.newly_registered(c("o_orderdate").cast("timestamp"), F.lit("1999-01-01").cast("timestamp")).alias("young"),
        values.sandbox_verdict(c("o_orderkey") % 4).alias("verdict"))


@query("scl_22_escalation", """
SELECT finding_id, CASE WHEN bad AND severity IN ('low','medium') THEN 'high' ELSE severity END AS severity,
 CASE WHEN bad AND severity IN ('low','medium') THEN greatest(severity_score, 8.0) ELSE severity_score END AS severity_score
FROM (SELECT *, ev_src LIKE '45.33.0.%' AS bad FROM x_findings)""")
def _(t):
    from flowloom.operators.findings import escalate

    bad = t.findings.where(F.get_json_object("evidence", "$.src_ip").startswith("45.33.0.")).select("finding_id")
    return escalate(t.findings, bad).select("finding_id", "severity", "severity_score")


@query("udf_04_sql_functions", f"""
WITH {_entropy_cte('x_hosts', 'host')} SELECT page_id, round(e,6) AS entropy,
 string_split(host,'.')[-2] || '.' || string_split(host,'.')[-1] AS apex FROM x_hosts JOIN ent ON lab=host""")
def _(t):
    sqlfunctions.register(t.spark)
    return t.hosts.selectExpr("page_id", "round(fl_entropy(host), 6) AS entropy", "fl_apex(host) AS apex")


# ---- projections ---------------------------------------------------------------------------

@query("prj_04_packet_flag_text", """
SELECT seq, CASE WHEN f='' THEN 'data' ELSE f END AS flags FROM (SELECT seq, concat_ws(',', CASE WHEN tcp_flags & 2 <> 0 THEN 'SYN' END,
 CASE WHEN tcp_flags & 16 <> 0 THEN 'ACK' END, CASE WHEN tcp_flags & 1 <> 0 THEN 'FIN' END, CASE WHEN tcp_flags & 4 <> 0 THEN 'RST' END) AS f FROM x_packets)""")
def _(t):
    return t.packets.select("seq", net.tcp_flag_text(c("tcp_flags")).alias("flags"))


@query("prj_05_compact_event", """
WITH b AS (SELECT seq, '{"kind":"' || kind || '","src_ip":"' || src_ip || '","dst_port":' || dst_port AS head, info FROM x_events)
SELECT seq, CASE WHEN info IS NULL OR info='' OR length(head || ',"info":"' || info || '"}')>60 THEN head || '}' ELSE head || ',"info":"' || info || '"}' END AS body FROM b""")
def _(t):
    return t.events.select("seq", A.compact_event(["kind", "src_ip", "dst_port"], budget=60).alias("body"))


@query("prj_06_anomaly_alerts", f"""
SELECT flow_id, true AS named, CASE WHEN anomaly_score>=9 THEN 'critical' WHEN anomaly_score>=8 THEN 'high' ELSE 'medium' END AS severity, anomaly_score, bytes_sent AS total_fwd_bytes
FROM x_flows WHERE anomaly_score>=7 AND NOT {DST_IN}""")
def _(t):
    marked = t.flows.withColumn("suppress_reason", F.when(net.is_internal_ip(c("dst_ip")), "internal destination"))
    return A.anomaly_alerts(marked, threshold=7.0).select(
        "flow_id", c("id").rlike("^ml-[0-9a-f]{20}$").alias("named"), "severity", "anomaly_score", "total_fwd_bytes")


@query("prj_07_signature_and_correlation_alerts", """
SELECT type, severity, explanation, count(*) AS n FROM (
 SELECT 'suricata' AS type, 'high' AS severity, 'Signature hit: sig ' || (k % 9) || ' (cat)' AS explanation FROM x_events WHERE kind='error'
 UNION ALL SELECT 'correlation','critical','Signature ''sig ' || (k % 9) || ''' and an anomaly (score 7.5) on the same host pair' FROM x_events WHERE kind='view') GROUP BY 1,2,3""")
def _(t):
    sig = F.concat(F.lit("sig "), (c("k") % 9).cast("string"))
    base = t.events.withColumns({"signature": sig, "signature_id": c("k"), "category": F.lit("cat"), "severity": F.lit("high"),
                                 "anomaly_score": F.lit(7.5), "flow_id": c("seq")})
    both = A.all_alerts(A.signature_alerts(base.where("kind='error'")), A.correlation_alerts(base.where("kind='view'")))
    return RP.count_by(both, "type", "severity", "explanation")


@query("prj_08_incident_from_alert", """
SELECT id AS alert_id, CASE lower(type) WHEN 'ml' THEN 'ML anomaly (' || coalesce(anomaly_score::varchar,'?') || ')' ELSE coalesce(attack_type, signature, explanation) END AS attack_type,
 round(CASE WHEN coalesce(anomaly_score,0)<>0 AND coalesce(confidence,0)=0 THEN anomaly_score/10 WHEN coalesce(confidence,0)=0 THEN 0.5 ELSE confidence END,3)::double AS confidence,
 CASE WHEN lower(type)='llm' THEN 'true_positive' ELSE 'open' END AS disposition,
 CASE WHEN lower(type)='llm' AND models LIKE '%heuristic%' THEN 'llm,heuristic' ELSE lower(type) END AS sources FROM x_alerts""")
def _(t):
    return I.incident_from_alert(t.alerts).select("alert_id", "attack_type", "confidence", "disposition",
                                                  F.array_join("sources", ",").alias("sources"))


def triage_input(t):
    n, txt = F.length("text"), c("text")

    def when(cond, v):
        return F.when(cond, v)

    return t.read("conversations").select(
        (c("conv_id") * 100 + c("turn")).alias("item"), when(n % 2 == 0, "merged attack").alias("merged_attack"),
        when(n % 2 == 0, "HIGH").alias("merged_severity"), when(n % 2 == 0, n % 100 / 100).alias("merged_confidence"),
        when(n % 2 == 0, F.substring(txt, 1, 20)).alias("merged_summary"), when(n % 2 == 0, F.array(F.lit("m1"))).alias("merged_indicators"),
        when(n % 3 == 0, "heur attack").alias("heur_attack"), when(n % 3 == 0, "medium").alias("heur_severity"),
        when(n % 3 == 0, n % 90 / 100).alias("heur_confidence"), when(n % 3 == 0, "heur").alias("heur_summary"),
        when(n % 3 == 0, F.array(F.lit("h1"), F.lit("h2"))).alias("heur_indicators"),
        when(n % 5 == 0, "prim attack").alias("prim_attack"), when(n % 5 == 0, "low").alias("prim_severity"),
        when(n % 5 == 0, F.lit(0.5)).alias("prim_confidence"), when(n % 5 == 0, "prim").alias("prim_summary"),
        F.element_at(F.array(F.lit("benign"), F.lit("true_positive"), F.lit(None), F.lit("weird")), (n % 4 + 1).cast("int")).alias("ai_status"),
        (n % 2 == 0).alias("verdict_suspicious"), (n % 3).cast("bigint").alias("model_answers"))


@query("prj_10_triage_rows", """
WITH b AS (SELECT conv_id*100+turn AS item, length(text) AS n, text, CASE length(text) % 4 WHEN 0 THEN 'benign' WHEN 1 THEN 'true_positive' WHEN 3 THEN 'weird' END AS st FROM conversations),
d AS (SELECT *, CASE WHEN st IN ('benign','true_positive') THEN st WHEN st='weird' THEN 'open' WHEN n%2=0 THEN 'true_positive' ELSE 'open' END AS base FROM b)
SELECT item, CASE WHEN n%3=0 AND base IN ('benign','open') THEN 'open' ELSE base END AS disposition,
 CASE WHEN n%3=0 AND base IN ('benign','open') AND coalesce(st,base)='benign' THEN 'open' ELSE coalesce(st,base) END AS ai_status,
 CASE WHEN n%2=0 THEN 'merged attack' WHEN n%3=0 THEN 'heur attack' WHEN n%5=0 THEN 'prim attack' ELSE 'Unknown' END AS attack_type,
 CASE WHEN n%2=0 THEN 'high' WHEN n%3=0 THEN 'medium' WHEN n%5=0 THEN 'low' ELSE 'info' END AS severity,
 round(CASE WHEN n%2=0 THEN n%100/100 WHEN n%3=0 THEN n%90/100 WHEN n%5=0 THEN 0.5 ELSE 0 END,3)::double AS confidence,
 CASE WHEN n%2=0 THEN substr(text,1,20) WHEN n%5=0 THEN 'prim' WHEN n%3=0 THEN 'heur' ELSE '' END AS summary,
 concat_ws(',', CASE WHEN n%2=0 THEN 'm1' END, CASE WHEN n%3=0 THEN 'h1,h2' END) AS indicators FROM d""")
def _(t):
    return I.triage_rows(triage_input(t))


@query("flt_15_triage_gate", """
SELECT conv_id*100+turn AS item, CASE WHEN n%2=0 AND n%3>0 THEN 'model' ELSE 'heuristic' END AS gate FROM (SELECT *, length(text) AS n FROM conversations)
WHERE (n%2=0 AND n%3>0) OR (n%3=0 AND n%90/100>=0.75)""")
def _(t):
    return I.triage_gate(triage_input(t)).select("item", "gate")


# ---- filters -------------------------------------------------------------------------------

@query("flt_01_findings_filter", """
SELECT finding_id, severity_score FROM x_findings WHERE severity='high' AND source='rule'""")
def _(t):
    return RP.filter_findings(t.findings, "high", "rule").select("finding_id", "severity_score")


@query("flt_02_flow_page", f"""
SELECT flow_id, protocol, anomaly_score FROM x_flows WHERE protocol='TCP' AND anomaly_score>0 AND NOT {DST_IN} ORDER BY anomaly_score DESC, flow_id LIMIT 50 OFFSET 100""")
def _(t):
    marked = t.flows.withColumns({"severity_score": c("anomaly_score"), "is_whitelisted": net.is_internal_ip(c("dst_ip"))})
    kept = RP.filter_flows(marked, "TCP", flagged=True, not_whitelisted=True)
    return RP.page(kept, [F.desc("anomaly_score"), F.asc("flow_id")], 3, 50).select("flow_id", "protocol", "anomaly_score")


@query("flt_03_observables_by_type", "SELECT value, confidence FROM x_obs WHERE type='domain'")
def _(t):
    return RP.filter_observables(t.observables, "domain").select("value", "confidence")


@query("flt_04_alert_filter", """
SELECT id, type, severity FROM x_alerts WHERE ts_us > epoch_us(timestamp '2024-01-10') AND lower(severity) IN ('high','low') AND lower(type) IN ('llm','ml')""")
def _(t):
    since = 1704844800 * 1_000_000  # 2024-01-10
    return A.filter_alerts(t.alerts, since, ["high", "LOW"], ["LLM", "ml"]).select("id", "type", "severity")


@query("flt_06_analysis_search", """
SELECT analysis_id, filename, source FROM x_analyses WHERE (analysis_name ILIKE '%urgent%' OR filename ILIKE '%capture-1%') AND status='complete' AND (source IS NULL OR source<>'live')""")
def _(t):
    return RP.search_analyses(t.analyses, "CAPTURE-1", "complete", live=False).unionByName(
        RP.search_analyses(t.analyses, "urgent", "complete", live=False)).distinct().select("analysis_id", "filename", "source")


@query("flt_11_label_predicates", """
SELECT count(*) FILTER (WHERE upper(trim(lab))='BENIGN') AS benign, count(*) FILTER (WHERE upper(trim(lab))<>'BENIGN') AS attacks
FROM (SELECT CASE WHEN toxic=0 THEN ' Benign ' ELSE 'DDoS' END AS lab FROM labels)""")
def _(t):
    lab = F.when(c("toxic") == 0, " Benign ").otherwise("DDoS")
    return t.read("labels").agg(F.count_if(FT.is_benign(lab)).alias("benign"), F.count_if(FT.is_attack(lab)).alias("attacks"))


@query("flt_12_clean_dataset", """
SELECT count(*) AS kept, cast(sum(k) AS bigint) AS k_sum FROM (SELECT DISTINCT user_id, event_type, CASE WHEN cast(json_extract_string(props,'$.k') AS bigint) % 10 = 0 THEN NULL
 ELSE cast(json_extract_string(props,'$.k') AS bigint) END AS k FROM events) WHERE k IS NOT NULL""")
def _(t):
    k = F.get_json_object("props", "$.k").cast("double")
    dirty = F.when(k % 10 == 0, F.when(k % 20 == 0, float("inf")).otherwise(float("nan"))).otherwise(k)
    rows = t.read("events").select("user_id", "event_type", dirty.alias("k"))
    # infinities and NaN of one (user, type) are two dirty rows; both disappear
    return FT.clean_dataset(rows, ["k"]).agg(F.count(F.lit(1)).alias("kept"), F.sum("k").cast("bigint").alias("k_sum"))


@query("flt_13_day_filter", "SELECT event_id FROM events WHERE cast(ts AS date) = date '2024-01-05'")
def _(t):
    from flowloom.sources.labelled import on_day

    return on_day(t.read("events"), "ts", "2024-01-05").select("event_id")


@query("set_06_exact_duplicates", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type, props FROM events)")
def _(t):
    return t.read("events").select("user_id", "event_type", "props").dropDuplicates().agg(F.count(F.lit(1)).alias("n"))


@query("set_04_differences", """
SELECT DISTINCT 'a' || (s_suppkey % 20) AS analysis_id FROM supplier WHERE s_suppkey % 20 NOT IN (SELECT c_custkey % 20 FROM customer WHERE c_nationkey = 3)""")
def _(t):
    ids = t.observables.where("type='ip'").select("analysis_id").distinct()
    seen = t.observables.where("type='domain' and nation=3").select("analysis_id").distinct()
    return ids.join(seen, "analysis_id", "left_anti")


_ = K
