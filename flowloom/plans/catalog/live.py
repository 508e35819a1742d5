"""Rolling windows, heuristics, sensor mapping and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flowloom.operators import alerts as A
from flowloom.operators import heuristics as H
from flowloom.operators.intel import enrich_with
from flowloom.operators.sinks import persist_analyses
from flowloom.operators.slices import forward_count, recent_gap
from flowloom.plans.catalog import query
from flowloom.session import shared_dir, spread
from flowloom.sources import sensor
from flowloom.streaming import live, rolling
from flowloom.streaming.path import LivePath

c = F.col
H6 = 6 * 3_600_000_000
RANGE = f"RANGE BETWEEN {H6} PRECEDING AND CURRENT ROW"
SSH = "(dst_port=22 OR info LIKE '%ssh%' OR info LIKE '%:22%')"


def scratch(t, name: str) -> str:
    """A fresh path in the shared folder for one run of a streaming query."""
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex[:10]}"


def stream_of(t, table: str):
    """The given table as a stream, through the same view as the batch queries."""
    class Streamed(type(t)):
        def read(self, name):
            if name != table:
                return super().read(name)
            schema = type(t)(self.spark, self.dir).read(name).schema
            rows = self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.dir)
            return spread(rows) if self.wide_reads else rows

    return Streamed(t.spark, t.dir)


def spread_reads(t):
    """The same tables, their rows dealt over all cores as they are read, before heavy per-row work."""
    return type(t)(t.spark, t.dir, wide_reads=True)


# ---- rolling windows -----------------------------------------------------------------------

@query("win_03_flow_start_gap", """
SELECT flow_id, round(CASE WHEN g<=8640000 THEN g END,3) AS gap_s FROM (SELECT flow_id, (start_us-lag(start_us) OVER (PARTITION BY src_ip, dst_ip, dst_port ORDER BY start_us, flow_id))/1e6 AS g FROM x_flows)""")
def _(t):
    flows = t.flows.select("flow_id", "src_ip", "dst_ip", "dst_port", F.unix_micros("start_time").alias("us"))
    return recent_gap(flows, ["src_ip", "dst_ip", "dst_port"], "us", 8_640_000_000_000, "gap", "flow_id").select(
        "flow_id", F.round(c("gap") / 1e6, 3).alias("gap_s"))


@query("win_04_forward_count", f"""
SELECT seq, count(*) OVER (PARTITION BY src_ip ORDER BY ts_us RANGE BETWEEN CURRENT ROW AND {H6} FOLLOWING) AS n FROM x_events""")
def _(t):
    return forward_count(t.events, "src_ip", "ts_us", H6, "n", "seq").select("seq", "n")


_ROLLING_ENTROPY = f"""
WITH p AS (SELECT a.seq, b.dst_port, count(*)::double AS n FROM x_events a JOIN x_events b ON a.src_ip=b.src_ip AND b.ts_us BETWEEN a.ts_us-{H6} AND a.ts_us GROUP BY 1,2),
q AS (SELECT seq, n, sum(n) OVER (PARTITION BY seq) AS t FROM p) SELECT seq, round(greatest(0.0,-sum(n/t*log2(n/t))),6) AS dst_port_entropy FROM q GROUP BY 1"""


@query("win_05_rolling_entropy", _ROLLING_ENTROPY)
def _(t):
    out = H.rolling_port_entropy(t.events.select("seq", "src_ip", "ts_us", "dst_port"), H6)
    return out.select("seq", F.round("dst_port_entropy", 6).alias("dst_port_entropy"))


@query("win_06_ssh_burst", f"""
SELECT seq, n, round(least(0.95, 0.5+n*0.04),2)::double AS confidence FROM (SELECT seq, count(*) OVER (PARTITION BY src_ip ORDER BY ts_us {RANGE}) AS n FROM x_events WHERE {SSH}) WHERE n>=3""")
def _(t):
    return H.ssh_bursts(t.events, 3, H6).select("seq", "n", "confidence")


@query("win_07_auth_port_burst", f"""
SELECT seq, n, round(least(0.92, 0.45+n*0.04),2)::double AS confidence FROM (SELECT seq, count(*) OVER (PARTITION BY src_ip, dst_port ORDER BY ts_us {RANGE}) AS n FROM x_events
 WHERE dst_port IN (22,21,23,445,1433,3389)) WHERE n>=2""")
def _(t):
    return H.auth_bursts(t.events, 2, H6).select("seq", "n", "confidence")


@query("win_08_port_diversity", f"""
WITH e AS (SELECT * FROM x_events WHERE protocol='TCP'), d AS (SELECT a.seq, count(DISTINCT b.dst_port) AS n FROM e a JOIN e b ON a.src_ip=b.src_ip AND b.ts_us BETWEEN a.ts_us-{H6} AND a.ts_us GROUP BY 1)
SELECT seq, n, round(least(0.9, 0.4+n*0.03),2)::double AS confidence FROM d WHERE n>=8""")
def _(t):
    return H.port_diversity(t.events, 8, H6).select("seq", "n", "confidence")


@query("win_12_rate_limit_fixed_window", """
SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY session_id, ts_us//3600000000 ORDER BY ts_us, id) AS r FROM x_alerts) WHERE r<=3""")
def _(t):
    return A.cap_per_window(t.alerts, ["session_id"], "ts_us", 3, 3_600_000_000).select("id")


#: The limiter row by row: a recursion that carries each session's admissions of the last hour.
_GREEDY = """
WITH RECURSIVE o AS (SELECT id, session_id, ts_us, row_number() OVER (PARTITION BY session_id ORDER BY ts_us, id) AS r FROM x_alerts),
g AS (SELECT id, session_id, ts_us, r, true AS ok, [ts_us] AS recent FROM o WHERE r = 1
  UNION ALL SELECT o.id, o.session_id, o.ts_us, o.r, len(list_filter(g.recent, lambda t: t >= o.ts_us - 3600000000)) < 3,
    CASE WHEN len(list_filter(g.recent, lambda t: t >= o.ts_us - 3600000000)) < 3 THEN list_append(list_filter(g.recent, lambda t: t >= o.ts_us - 3600000000), o.ts_us)
      ELSE list_filter(g.recent, lambda t: t >= o.ts_us - 3600000000) END
  FROM g JOIN o ON o.session_id = g.session_id AND o.r = g.r + 1)
SELECT id, session_id, ts_us FROM g WHERE ok"""


@query("win_12_rate_limit_greedy", _GREEDY)
def _(t):
    return A.greedy_cap(t.alerts.select("id", "session_id", "ts_us"), "session_id", "ts_us", 3, 3_600_000_000)


_TRIAGE = f"""
WITH k AS (SELECT *, CASE WHEN info LIKE '%scan%' OR info LIKE '%nmap%' THEN 'scan' WHEN dst_port IN (22,21,23,3389,445,1433) AND info LIKE '%hydra%' THEN 'brute' END AS kw FROM x_events),
l1 AS (SELECT * FROM k WHERE kw IS NULL),
s AS (SELECT *, count(*) OVER (PARTITION BY src_ip ORDER BY ts_us {RANGE}) AS n FROM l1 WHERE {SSH}),
l2 AS (SELECT * FROM l1 WHERE NOT {SSH} UNION ALL SELECT * EXCLUDE (n) FROM s WHERE n<3),
a AS (SELECT *, count(*) OVER (PARTITION BY src_ip, dst_port ORDER BY ts_us {RANGE}) AS n FROM l2 WHERE dst_port IN (22,21,23,3389,445,1433)),
l3 AS (SELECT * FROM l2 WHERE dst_port NOT IN (22,21,23,3389,445,1433) UNION ALL SELECT * EXCLUDE (n) FROM a WHERE n<2),
l3t AS (SELECT * FROM l3 WHERE protocol='TCP'),
p AS (SELECT x.seq, count(DISTINCT y.dst_port) AS n FROM l3t x JOIN l3t y ON x.src_ip=y.src_ip AND y.ts_us BETWEEN x.ts_us-{H6} AND x.ts_us GROUP BY 1)
SELECT seq, CASE kw WHEN 'scan' THEN 'scan' ELSE 'brute' END AS hit, CASE kw WHEN 'scan' THEN 0.85 ELSE 0.88 END::double AS confidence FROM k WHERE kw IS NOT NULL
UNION ALL SELECT seq, 'ssh', round(least(0.95,0.5+n*0.04),2)::double FROM s WHERE n>=3
UNION ALL SELECT seq, 'auth', round(least(0.92,0.45+n*0.04),2)::double FROM a WHERE n>=2
UNION ALL SELECT seq, 'ports', round(least(0.9,0.4+n*0.03),2)::double FROM p WHERE n>=6"""


def _hits(df):
    ind = c("indicators")
    kind = (F.when(ind.startswith("nmap"), "scan").when(ind.contains("brute_tool"), "brute").when(ind.startswith("ssh_syn"), "ssh")
            .when(ind.startswith("port_scan"), "ports").otherwise("auth"))
    return df.select("seq", kind.alias("hit"), "confidence")


@query("win_13_heuristic_precedence", _TRIAGE)
def _(t):
    return _hits(H.triage(t.events, H6, min_ssh=3, min_auth=2, min_ports=6))


# ---- sensor events -------------------------------------------------------------------------

def sensor_lines(t):
    """Each event as one line of a sensor log: plain, array-framed, quoted or broken."""
    e = spread_reads(t).events  # the rows are a fraction of their lines
    kind = F.element_at(F.array(*map(F.lit, ["flow", "alert", "dns", "http", "tls", "anomaly"])), (c("seq") % 6 + 1).cast("int"))
    iso = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+0000'")
    start = F.date_format(F.timestamp_micros(c("ts_us") - c("k") * 1_000_000), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+0000'")
    body = F.to_json(F.struct(
        iso.alias("timestamp"), kind.alias("event_type"), F.when(c("seq") % 50 != 0, c("src_ip")).alias("src_ip"), c("dst_ip").alias("dest_ip"),
        "src_port", c("dst_port").alias("dest_port"), F.lower("protocol").alias("proto"), c("seq").alias("flow_id"), c("length").cast("int").alias("pkt_len"),
        F.when(kind == "flow", F.struct(c("k").alias("pkts_toserver"), (c("k") + 1).alias("pkts_toclient"), c("length").alias("bytes_toserver"),
                                        (c("length") * 2).alias("bytes_toclient"), start.alias("start"), iso.alias("end"))).alias("flow"),
        F.when(kind == "alert", F.struct(F.when(c("k") % 7 != 0, F.concat(F.lit("sig "), c("k").cast("string"))).otherwise(" ").alias("signature"),
                                         c("k").alias("signature_id"), (c("k") % 4 + 1).alias("severity"))).alias("alert"),
        F.when(kind == "dns", F.struct(F.lit("query").alias("type"), F.concat(F.lit("n"), (c("k") % 3).cast("string"), F.lit(".local")).alias("rrname"))).alias("dns"),
        F.when(kind == "http", F.struct(F.lit("h.example").alias("hostname"), F.lit("GET").alias("http_method"), F.lit("/x").alias("url"))).alias("http"),
        F.when(kind == "tls", F.struct(F.lit("s.example").alias("sni"))).alias("tls")))
    bodies, body = e.select("seq", body.alias("body")), c("body")
    quoted = F.when(c("seq") % 5 == 2, F.to_json(F.struct(body.alias("s"))))
    packed = F.substr(c("quoted"), F.lit(6), F.length("quoted") - 6)
    line = (F.when(c("seq") % 5 == 1, F.concat(F.lit("  "), body, F.lit(","))).when(c("seq") % 5 == 2, packed)
            .when(c("seq") % 5 == 3, F.concat(F.lit("["), body, F.lit(","))).when(c("seq") % 45 == 4, F.concat(body, F.lit("}}bad{")))
            .otherwise(body))
    return bodies.withColumn("quoted", quoted).select(line.alias("value"))


@query("src_04_sensor_log_scan", """
SELECT CASE seq % 6 WHEN 0 THEN 'flow' WHEN 1 THEN 'alert' WHEN 2 THEN 'dns' WHEN 3 THEN 'http' WHEN 4 THEN 'tls' ELSE 'anomaly' END AS event_type, count(*) AS n, cast(sum(seq) AS bigint) AS ids
FROM x_events WHERE seq % 45 <> 4 GROUP BY 1""")
def _(t):
    return sensor.parse_lines(sensor_lines(t)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("flow_id").alias("ids"))


@query("prj_01_sensor_flow_mapping", """
SELECT seq AS flow_id, src_ip, dst_ip, dst_port, protocol, k*1000 AS duration_ms, length AS bytes_sent, length*2 AS bytes_recv, k AS packets_sent, k+1 AS packets_recv, true AS is_external_dst
FROM x_events WHERE seq % 45 <> 4 AND seq % 6 = 0 AND seq % 50 <> 0""")
def _(t):
    return sensor.to_flows(sensor.parse_lines(sensor_lines(t))).select(
        "flow_id", "src_ip", "dst_ip", "dst_port", "protocol", "duration_ms", "bytes_sent", "bytes_recv", "packets_sent", "packets_recv", "is_external_dst")


@query("prj_02_sensor_alert_mapping", """
SELECT 'sig ' || k AS signature, CASE k % 4 + 1 WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'medium' END AS severity, count(*) AS n FROM x_events
WHERE seq % 45 <> 4 AND seq % 6 = 1 AND k % 7 <> 0 GROUP BY 1,2""")
def _(t):
    return sensor.to_alerts(sensor.parse_lines(sensor_lines(t))).groupBy("signature", "severity").agg(F.count(F.lit(1)).alias("n"))


_HIGH = "CASE WHEN dst_port IN (22,23,445,1433,3389) THEN 'high' ELSE 'medium' END"


@query("prj_03_display_rows", f"""
SELECT ts_us, dst_ip, dst_port, info, severity, event_type, protocol FROM (SELECT ts_us, dst_ip, dst_port,
 CASE seq % 6 WHEN 0 THEN 'Flow end · ' || (2*k+1) || ' pkts · ' || (3*length) || ' B' WHEN 1 THEN CASE WHEN k % 7 <> 0 THEN 'sig ' || k ELSE ' ' END WHEN 2 THEN 'DNS query: n' || (k % 3) || '.local'
  WHEN 3 THEN 'GET h.example/x' WHEN 4 THEN 's.example' ELSE 'anomaly:' END AS info,
 CASE seq % 6 WHEN 0 THEN {_HIGH} WHEN 1 THEN CASE k % 4 + 1 WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' ELSE 'high' END WHEN 2 THEN 'info' WHEN 3 THEN {_HIGH} WHEN 4 THEN 'medium' ELSE 'medium' END AS severity,
 CASE seq % 6 WHEN 0 THEN 'flow' WHEN 1 THEN 'alert' WHEN 2 THEN 'dns' WHEN 3 THEN 'http' WHEN 4 THEN 'tls' ELSE 'anomaly' END AS event_type,
 CASE seq % 6 WHEN 2 THEN 'DNS' WHEN 3 THEN 'HTTP' WHEN 4 THEN 'TLS' ELSE protocol END AS protocol FROM x_events WHERE seq % 45 <> 4)""")
def _(t):
    rows = sensor.to_display(sensor.parse_lines(sensor_lines(t)))
    return rows.select(F.unix_micros("time").alias("ts_us"), "dst_ip", "dst_port", "info", "severity", "event_type", "protocol")


@query("flt_10_event_routing", """
SELECT 'flow' AS branch, count(*) AS n FROM x_events WHERE seq % 45 <> 4 AND seq % 6 = 0 AND seq % 50 <> 0
UNION ALL SELECT 'alert', count(*) FROM x_events WHERE seq % 45 <> 4 AND seq % 6 = 1 AND k % 7 <> 0""")
def _(t):
    flows, alerts = sensor.route(sensor.parse_lines(sensor_lines(t)))
    return flows.agg(F.lit("flow").alias("branch"), F.count(F.lit(1)).alias("n")).unionByName(
        alerts.agg(F.lit("alert").alias("branch"), F.count(F.lit(1)).alias("n")))


def persisted(t):
    """Flows and bytes of every analysis, written twice and read back: the second run replaces the first one's rows."""
    out = scratch(t, "analyses")
    for _ in range(2):
        persist_analyses(out, flows=t.flows)
    return t.spark.read.schema(t.flows.schema).parquet(f"{out}/flows").groupBy("analysis_id").agg(
        F.count(F.lit(1)).alias("flows"), F.sum("bytes_sent").cast("bigint").alias("bytes"))


@query("snk_01_persist_analysis", """
SELECT analysis_id, count(*) AS flows, sum(bytes_sent)::bigint AS bytes FROM x_flows GROUP BY 1""")
def _(t):
    return persisted(t)


def _lengths(keys):
    """Stands for a caller's look-up service."""
    import pandas as pd

    return pd.DataFrame({"dst_ip": keys, "length": keys.str.len()})


@query("udf_02_lookup_plugin", "SELECT DISTINCT dst_ip, length(dst_ip)::bigint AS length FROM x_flows WHERE dst_ip IS NOT NULL")
def _(t):
    return enrich_with(t.flows, "dst_ip", _lengths, "dst_ip string, length bigint")


# ---- streams -------------------------------------------------------------------------------

def _finish(query_handle):
    query_handle.awaitTermination()
    if query_handle.exception():
        raise query_handle.exception()


@query("str_02_stream_port_entropy", _ROLLING_ENTROPY)
def _(t):
    out = scratch(t, "entropy")
    events = stream_of(t, "events").events.select("seq", "src_ip", "ts_us", "dst_port")
    _finish(rolling.rolling_entropy_stream(f"{out}/rows", f"{out}/context", H6).start(events, f"{out}/checkpoint"))
    return t.spark.read.parquet(f"{out}/rows").select("seq", F.round("dst_port_entropy", 6).alias("dst_port_entropy"))


@query("str_05_stream_triage", _TRIAGE)
def _(t):
    out = scratch(t, "triage")
    run = rolling.triage_stream(f"{out}/rows", f"{out}/context", H6, min_ssh=3, min_auth=2, min_ports=6)
    _finish(run.start(stream_of(t, "events").events, f"{out}/checkpoint"))
    return _hits(t.spark.read.parquet(f"{out}/rows"))


@query("str_06_stream_rate_limit", _GREEDY)
def _(t):
    out = scratch(t, "limit")
    alerts = stream_of(t, "events").alerts.select("id", "session_id", "ts_us")
    run = rolling.rate_limit_stream(f"{out}/rows", f"{out}/context", "session_id", 3, 3_600_000_000)
    _finish(run.start(alerts, f"{out}/checkpoint"))
    return t.spark.read.parquet(f"{out}/rows").select("id", "session_id", "ts_us")


def correlation_sql():
    from flowloom.plans.catalog.joins import HOUR6, _MATCH

    return f"WITH {_MATCH} SELECT pair, min(ts_us) AS ts_us, arg_min(flow_id, ts_us) AS flow_id FROM m GROUP BY pair, ts_us//{HOUR6}"


@query("str_03_stream_correlation", correlation_sql())
def _(t):
    out = scratch(t, "correlation")
    e = stream_of(t, "events").events
    feed = F.when(c("kind") == "error", "signature").when((c("kind") == "view") & (c("value") > 20), "anomaly")
    both = e.select("ts_us", "src_ip", "dst_ip", F.concat(F.lit("sig "), (c("k") % 9).cast("string")).alias("signature"),
                    c("seq").alias("flow_id"), c("value").alias("anomaly_score"), feed.alias("feed")).where("feed is not null")
    _finish(rolling.correlation_stream(f"{out}/rows", f"{out}/context", H6).start(both, f"{out}/checkpoint"))
    return t.spark.read.parquet(f"{out}/rows").select("pair", "ts_us", "flow_id")


def _to_table(t, df, name, mode="append"):
    out = scratch(t, name)
    _finish(df.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint")
            .outputMode(mode).trigger(availableNow=True).start())
    return t.spark.read.schema(df.schema).parquet(f"{out}/rows")


@query("str_04_stream_idle_flows", """
WITH s AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w < 86400000000 THEN 0 ELSE 1 END AS fresh, (ts_us - lag(ts_us) OVER w)/1e6 AS g FROM x_events WINDOW w AS (PARTITION BY src_ip, dst_ip, src_port, dst_port, protocol ORDER BY ts_us)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY src_ip, dst_ip, src_port, dst_port, protocol ORDER BY ts_us) AS sid FROM s),
g AS (SELECT src_ip, dst_ip, min(ts_us) AS start_us, max(ts_us) AS last_us, count(*) AS packets_sent, cast(sum(length) AS bigint) AS bytes_sent,
  round(coalesce(avg(g) FILTER (WHERE fresh=0 AND g>0),0),3) AS iat_mean, round(coalesce(max(g) FILTER (WHERE fresh=0 AND g>0),0),3) AS iat_max,
  round(coalesce(min(g) FILTER (WHERE fresh=0 AND g>0),0),3) AS iat_min, round(coalesce(stddev_pop(g) FILTER (WHERE fresh=0 AND g>0),0),2) AS iat_std FROM r GROUP BY src_ip, dst_ip, src_port, dst_port, protocol, sid)
SELECT src_ip, dst_ip, start_us, packets_sent, bytes_sent, iat_mean, iat_max, iat_min, iat_std FROM g WHERE last_us//1000 + 86400000 <= (SELECT max(ts_us)//1000 FROM x_events)""")
def _(t):
    flows = live.idle_flow_stream(stream_of(t, "events").events, 86400, "0 seconds")
    return _to_table(t, flows, "idle").select("src_ip", "dst_ip", F.unix_micros("start_time").alias("start_us"), "packets_sent", "bytes_sent",
                                              *[F.round(n, d).alias(n) for n, d in (("iat_mean", 3), ("iat_max", 3), ("iat_min", 3), ("iat_std", 2))])


@query("rule_18_stream_signature_threshold", """
SELECT (ts_us // 86400000000)*86400 AS window_start_s, src_ip, count(*) AS hits FROM x_events
WHERE protocol='TCP' AND dst_port=22 AND (tcp_flags & 2)<>0 AND (ts_us // 86400000000 + 1)*86400000000 <= (SELECT max(ts_us) FROM x_events WHERE protocol='TCP' AND dst_port=22 AND (tcp_flags & 2)<>0) GROUP BY 1,2 HAVING count(*)>=3""")
def _(t):
    hits = live.signature_threshold_stream(stream_of(t, "events").events, 22, 3, "1 day", "0 seconds")
    return _to_table(t, hits, "threshold").select(F.unix_seconds("window_start").alias("window_start_s"), "src_ip", "hits")


@query("src_05_stream_tail", "SELECT kind, count(*) AS n FROM x_events GROUP BY 1")
def _(t):
    rows = _to_table(t, stream_of(t, "events").events.select("seq", "kind"), "tail")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("snk_02_daily_json_log", """
SELECT strftime(make_timestamp(ts_us), '%Y%m%d') AS date, count(*) AS n FROM x_events GROUP BY 1""")
def _(t):
    from flowloom.operators.sinks import write_daily_json

    out = scratch(t, "daily")
    stream = stream_of(t, "events").events.select("seq", "time", "src_ip", "dst_ip", "dst_port")
    _finish(write_daily_json(stream, f"{out}/log", f"{out}/checkpoint"))
    back = t.spark.read.schema("seq BIGINT, date STRING").json(f"{out}/log")
    return back.groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("str_01_live_alerts", """
SELECT type, severity, count(*) AS n FROM (
 SELECT 'ml' AS type, CASE WHEN k>=90 THEN 'critical' WHEN k>=80 THEN 'high' ELSE 'medium' END AS severity FROM x_events WHERE seq % 45 <> 4 AND seq % 6 = 0 AND seq % 50 <> 0 AND k>=70
 UNION ALL SELECT 'suricata', CASE k % 4 + 1 WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'medium' END FROM x_events WHERE seq % 45 <> 4 AND seq % 6 = 1 AND k % 7 <> 0) GROUP BY 1,2""")
def _(t):
    """Parsed sensor lines through the live query; a flow's score is a tenth of its packet count."""
    out = scratch(t, "live")
    events = sensor.parse_lines(sensor_lines(stream_of(t, "events")))
    _finish(live.run_live(t.spark, events, lambda flows: flows.withColumn("anomaly_score", c("packets_sent") / 10), out, f"{out}/checkpoint",
                          threshold=7.0, trigger={"availableNow": True}))
    return live.read_alerts(t.spark, out).groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n"))


#: The live path in one statement: entropy of the flows, scores, correlation, one limit for all alerts row by row, intelligence.
_LIVE_PATH = f"""
WITH RECURSIVE e AS (SELECT * REPLACE (CASE WHEN seq % 50 = 0 THEN '' ELSE src_ip END AS src_ip) FROM x_events WHERE seq % 45 <> 4),
f AS (SELECT * FROM e WHERE seq % 6 = 0 AND seq % 50 <> 0), h AS (SELECT * FROM e WHERE seq % 6 = 1 AND k % 7 <> 0),
p AS (SELECT a.seq, b.dst_port, count(*)::double AS n FROM f a JOIN f b ON a.src_ip=b.src_ip AND b.ts_us BETWEEN a.ts_us-{H6} AND a.ts_us GROUP BY 1,2),
q AS (SELECT seq, round(greatest(0.0,-sum(n/t*log2(n/t))),6) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY seq) AS t FROM p) GROUP BY 1),
s AS (SELECT f.*, k/10 + CASE WHEN entropy > 1.5 THEN 0.5 ELSE 0 END AS score FROM f JOIN q USING (seq)),
ano AS (SELECT *, least(src_ip,dst_ip) || '~' || greatest(src_ip,dst_ip) AS pair FROM s WHERE score >= 7), sig AS (SELECT *, least(src_ip,dst_ip) || '~' || greatest(src_ip,dst_ip) AS pair FROM h),
m AS (SELECT a.pair, a.ts_us, a.dst_ip FROM ano a WHERE EXISTS (SELECT 1 FROM sig b WHERE a.pair=b.pair AND b.ts_us BETWEEN a.ts_us-{H6} AND a.ts_us)
 UNION ALL SELECT a.pair, a.ts_us, a.dst_ip FROM sig a WHERE EXISTS (SELECT 1 FROM ano b WHERE a.pair=b.pair AND b.ts_us BETWEEN a.ts_us-{H6} AND a.ts_us)),
al AS (SELECT ts_us, 'ml' AS type, dst_ip, CASE WHEN score>=9 THEN 'critical' WHEN score>=8 THEN 'high' ELSE 'medium' END AS severity FROM ano
 UNION ALL SELECT ts_us, 'suricata', dst_ip, CASE k % 4 + 1 WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'medium' END FROM h
 UNION ALL SELECT min(ts_us), 'correlation', arg_min(dst_ip, ts_us), 'critical' FROM m GROUP BY pair, ts_us//{H6}),
o AS (SELECT *, row_number() OVER (ORDER BY ts_us, type = 'correlation') AS r FROM al),
g AS (SELECT o.*, true AS ok, [ts_us] AS recent FROM o WHERE r = 1
 UNION ALL SELECT o.*, len(list_filter(g.recent, lambda t: t >= o.ts_us - {H6})) < 40,
  CASE WHEN len(list_filter(g.recent, lambda t: t >= o.ts_us - {H6})) < 40 THEN list_append(list_filter(g.recent, lambda t: t >= o.ts_us - {H6}), o.ts_us)
   ELSE list_filter(g.recent, lambda t: t >= o.ts_us - {H6}) END FROM g JOIN o ON o.r = g.r + 1)
SELECT ts_us, type, dst_ip, CASE WHEN cast(split_part(dst_ip,'.',4) AS bigint) % 3 = 0 AND severity NOT IN ('high','critical') THEN 'high' ELSE severity END AS severity FROM g WHERE ok"""


def _providers(t):
    """A verdict for every address that events go to; every third is malicious."""
    last, n = F.element_at(F.split("dst_ip", r"\."), -1).cast("bigint"), F.lit(None)
    return t.events.select("dst_ip").distinct().select(
        c("dst_ip").alias("value"), F.when(last % 3 == 0, 5).otherwise(0).cast("bigint").alias("vt"), n.cast("bigint").alias("abuse"),
        n.cast("boolean").alias("new_domain"), n.cast("bigint").alias("pulses"), n.cast("bigint").alias("sandbox"),
        n.cast("string").alias("scanner"), n.cast("boolean").alias("known_good"), n.cast("bigint").alias("vulns"))


def live_path(t):
    """Scores of flows: a tenth of the packets, and a half for a source that varies its ports."""
    varied = F.when(F.round("dst_port_entropy", 6) > 1.5, 0.5).otherwise(0.0)
    return LivePath(lambda flows: flows.withColumn("anomaly_score", c("packets_sent") / 10 + varied), threshold=7.0, limit=40,
                    limit_us=H6, correlation_us=H6, entropy_us=H6, providers=_providers(t))


@query("str_01_live_path", _LIVE_PATH)
def _(t):
    out = scratch(t, "path")
    events = sensor.parse_lines(sensor_lines(stream_of(t, "events")))
    _finish(live_path(t).start(events, out, f"{out}/checkpoint", {"availableNow": True}))
    return live.read_alerts(t.spark, out).select("ts_us", "type", "dst_ip", "severity")


@query("str_07_stream_incidents", """
SELECT src_ip, dst_ip, count(*) AS connections, cast(sum(n) AS bigint) AS alerts FROM (SELECT src_ip, dst_ip, src_port, dst_port, protocol, count(*) AS n FROM (
 SELECT * FROM x_events WHERE seq % 45 <> 4 AND seq % 6 = 0 AND seq % 50 <> 0 AND k>=70
 UNION ALL SELECT * REPLACE (CASE WHEN seq % 50 = 0 THEN '' ELSE src_ip END AS src_ip) FROM x_events WHERE seq % 45 <> 4 AND seq % 6 = 1 AND k % 7 <> 0) GROUP BY 1,2,3,4,5) GROUP BY 1,2""")
def _(t):
    out = scratch(t, "live")
    events = sensor.parse_lines(sensor_lines(stream_of(t, "events")))
    _finish(live.run_live(t.spark, events, lambda flows: flows.withColumn("anomaly_score", c("packets_sent") / 10), out, f"{out}/checkpoint",
                          threshold=7.0, trigger={"availableNow": True}))
    return live.read_incidents(t.spark, out).groupBy("src_ip", "dst_ip").agg(
        F.count(F.lit(1)).alias("connections"), F.sum("alerts").alias("alerts"))


@query("str_12_alert_enrichment", """
SELECT id, CASE WHEN k % 3 = 0 AND lower(severity) NOT IN ('high','critical') THEN 'high' ELSE severity END AS severity FROM (SELECT a.*, cast(split_part(dst_ip,'.',4) AS bigint) AS k FROM x_alerts a)""")
def _(t):
    last = F.element_at(F.split("dst_ip", r"\."), -1).cast("bigint")
    n = F.lit(None)
    providers = t.alerts.select("dst_ip").distinct().select(
        c("dst_ip").alias("value"), F.when(last % 3 == 0, 5).otherwise(0).cast("bigint").alias("vt"), n.cast("bigint").alias("abuse"),
        n.cast("boolean").alias("new_domain"), n.cast("bigint").alias("pulses"), n.cast("bigint").alias("sandbox"),
        n.cast("string").alias("scanner"), n.cast("boolean").alias("known_good"), n.cast("bigint").alias("vulns"))
    return _to_table(t, live.enrich_alerts(stream_of(t, "events").alerts, providers).select("id", "severity"), "enriched")
