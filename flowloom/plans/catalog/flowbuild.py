"""Packets to flows, gaps, observables and idle sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.functions import net
from flowloom.operators import flows as FL
from flowloom.plans.catalog import query

# First packet of the flow fixes the direction: src/dst of the row with the smallest seq.
_HEADS = """
heads AS (SELECT fkey, arg_min(src_ip, seq) AS f_src, arg_min(dst_ip, seq) AS f_dst, arg_min(src_port, seq) AS f_sport,
  arg_min(dst_port, seq) AS f_dport FROM x_keyed GROUP BY 1),
p AS (SELECT k.*, k.src_ip = h.f_src OR k.protocol='ICMP' AS fwd, f_src, f_dst, f_sport, f_dport FROM x_keyed k JOIN heads h USING (fkey))"""
_ENDS = "f_src AS src_ip, f_dst AS dst_ip, f_sport AS src_port, f_dport AS dst_port, protocol"
_GROUP = "GROUP BY f_src, f_dst, f_sport, f_dport, protocol, fkey"
KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
SLICE = 2500  # small enough that the adapter's flows span several slices


def built(t):
    return FL.flow_table(t.packets, rows_per_slice=SLICE)


@query("join_01_bidirectional_match", f"""
WITH {_HEADS} SELECT {_ENDS}, count(*) AS packets FROM p {_GROUP}""")
def _(t):
    return built(t).select(*KEY, (F.col("packets_sent") + F.col("packets_recv")).alias("packets"))


@query("agg_01_flow_reconstruction", f"""
WITH {_HEADS} SELECT {_ENDS}, min(CASE WHEN true THEN cast(round(ts*1e6) AS bigint) END) AS start_us,
  cast(floor((cast(round(arg_max(ts,seq)*1e6) AS bigint)-cast(round(arg_min(ts,seq)*1e6) AS bigint))/1000) AS bigint) AS duration_ms,
  cast(coalesce(sum(payload_len) FILTER (WHERE fwd),0) AS bigint) AS bytes_sent,
  cast(coalesce(sum(payload_len) FILTER (WHERE NOT fwd),0) AS bigint) AS bytes_recv,
  count(*) FILTER (WHERE fwd) AS packets_sent, count(*) FILTER (WHERE NOT fwd) AS packets_recv FROM p {_GROUP}""")
def _(t):
    return built(t).select(*KEY, F.unix_micros("start_time").alias("start_us"), "duration_ms", "bytes_sent", "bytes_recv",
                           "packets_sent", "packets_recv")


def _std(cond):
    return f"round(coalesce(stddev_pop(payload_len) FILTER (WHERE {cond}),0),4)"


@query("agg_02_length_moments", f"""
WITH {_HEADS} SELECT {_ENDS},
  coalesce(min(payload_len) FILTER (WHERE fwd),0)::double AS fwd_pkt_len_min, coalesce(max(payload_len) FILTER (WHERE fwd),0)::double AS fwd_pkt_len_max,
  {_std('fwd')} AS fwd_pkt_len_std, coalesce(min(payload_len) FILTER (WHERE NOT fwd),0)::double AS bwd_pkt_len_min,
  coalesce(max(payload_len) FILTER (WHERE NOT fwd),0)::double AS bwd_pkt_len_max, {_std('NOT fwd')} AS bwd_pkt_len_std,
  min(payload_len)::double AS pkt_len_min, max(payload_len)::double AS pkt_len_max, {_std('true')} AS pkt_len_std FROM p {_GROUP}""")
def _(t):
    cols = [f"{p}{s}" for p in ("fwd_pkt_len_", "bwd_pkt_len_", "pkt_len_") for s in ("min", "max")]
    stds = [F.round(c, 4).alias(c) for c in ("fwd_pkt_len_std", "bwd_pkt_len_std", "pkt_len_std")]
    return built(t).select(*KEY, *cols, *stds)


def _flag(bit, side="true"):
    return f"count(*) FILTER (WHERE protocol='TCP' AND (tcp_flags & {bit})<>0 AND {side})"


@query("agg_03_tcp_flags", f"""
WITH {_HEADS} SELECT {_ENDS}, {_flag(1)} AS fin_count, {_flag(2)} AS syn_count, {_flag(4)} AS rst_count, {_flag(8)} AS psh_count,
  {_flag(16)} AS ack_count, {_flag(32)} AS urg_count, {_flag(8, 'fwd')} AS fwd_psh_count, {_flag(32, 'NOT fwd')} AS bwd_urg_count,
  cast(coalesce(sum(header_len) FILTER (WHERE fwd AND protocol='TCP'),0) AS bigint) AS fwd_header_len,
  cast(coalesce(sum(header_len) FILTER (WHERE NOT fwd AND protocol='TCP'),0) AS bigint) AS bwd_header_len,
  count(*) FILTER (WHERE fwd AND protocol='TCP' AND payload_len>=1) AS act_data_pkt_fwd,
  cast(min(header_len) FILTER (WHERE fwd AND protocol='TCP') AS bigint) AS min_seg_size_fwd FROM p {_GROUP}""")
def _(t):
    cols = [f"{n}_count" for n in ("fin", "syn", "rst", "psh", "ack", "urg", "fwd_psh", "bwd_urg")]
    return built(t).select(*KEY, *cols, "fwd_header_len", "bwd_header_len", "act_data_pkt_fwd",
                           F.col("min_seg_size_fwd").cast("bigint").alias("min_seg_size_fwd"))


_GAPS = """
gaps AS (SELECT *, ts - lag(ts) OVER (PARTITION BY fkey ORDER BY seq) AS gap,
  ts - lag(ts) OVER (PARTITION BY fkey, CASE WHEN protocol='ICMP' THEN '*' ELSE src_ip END ORDER BY seq) AS dgap0 FROM p),
g AS (SELECT *, CASE WHEN dgap0>=0 THEN dgap0 END AS dgap FROM gaps)"""


@query("agg_04_iat_statistics", f"""
WITH {_HEADS}, {_GAPS} SELECT {_ENDS}, round(coalesce(avg(gap),0),3) AS iat_mean,
  round(CASE WHEN count(gap)>1 THEN stddev_pop(gap) ELSE 0 END,2) AS iat_std, round(coalesce(max(gap),0),3) AS iat_max,
  round(coalesce(min(gap),0),3) AS iat_min, round(coalesce(avg(dgap) FILTER (WHERE fwd),0),3) AS fwd_iat_mean,
  round(coalesce(sum(dgap) FILTER (WHERE fwd),0),2) AS fwd_iat_total, round(coalesce(max(dgap) FILTER (WHERE NOT fwd),0),3) AS bwd_iat_max,
  round(coalesce(stddev_pop(dgap) FILTER (WHERE NOT fwd),0),2) AS bwd_iat_std FROM g {_GROUP}""")
def _(t):
    digits = {"iat_mean": 3, "iat_std": 2, "iat_max": 3, "iat_min": 3, "fwd_iat_mean": 3, "fwd_iat_total": 2,
              "bwd_iat_max": 3, "bwd_iat_std": 2}
    return built(t).select(*KEY, *[F.round(c, d).alias(c) for c, d in digits.items()])


_LAYER = """CASE WHEN protocol='ICMP' THEN 'ICMP' WHEN protocol='UDP' THEN CASE WHEN dst_port=53 OR src_port=53 THEN 'DNS' END
  WHEN payload_len<=0 THEN NULL WHEN srv IN (443,8443) OR first_byte=22 THEN 'TLS' WHEN srv IN (80,8080,8000) OR is_request THEN 'HTTP'
  WHEN srv=22 THEN 'SSH' WHEN srv=445 THEN 'SMB' WHEN srv=3389 THEN 'RDP' END"""


@query("agg_05_sets_and_last_values", f"""
WITH {_HEADS}, q AS (SELECT *, CASE WHEN fwd THEN dst_port ELSE src_port END AS srv FROM p), l AS (SELECT *, {_LAYER} AS layer FROM q)
SELECT {_ENDS}, arg_max(layer, seq) FILTER (WHERE layer IS NOT NULL) AS application_layer,
  arg_max(sni, seq) FILTER (WHERE sni IS NOT NULL) AS tls_sni,
  coalesce(string_agg(DISTINCT dns_qname, ',' ORDER BY dns_qname),'') AS dns_queries,
  coalesce(string_agg(DISTINCT http_host, ',' ORDER BY http_host),'') AS http_hosts FROM l {_GROUP}""")
def _(t):
    flows = FL.build_flows(t.packets, rows_per_slice=SLICE)
    return flows.select(*KEY, "application_layer", "tls_sni", F.array_join("dns_queries", ",").alias("dns_queries"),
                           F.array_join("http_hosts", ",").alias("http_hosts"))


@query("agg_06_observables", """
SELECT type, value, arg_min(ts, seq) AS first_seen, count(*) AS occurrence_count FROM (
  SELECT 'ip' AS type, src_ip AS value, ts, seq FROM x_packets UNION ALL SELECT 'ip', dst_ip, ts, seq FROM x_packets
  UNION ALL SELECT 'domain', sni, ts, seq FROM x_packets UNION ALL SELECT 'domain', split_part(http_host,':',1), ts, seq FROM x_packets
  UNION ALL SELECT 'domain', dns_qname, ts, seq FROM x_packets) WHERE value IS NOT NULL GROUP BY 1,2""")
def _(t):
    return FL.build_observables(t.packets)


@query("win_01_packet_gap", """
SELECT seq, round(ts - lag(ts) OVER (PARTITION BY fkey ORDER BY seq),4) AS gap FROM x_keyed""")
def _(t):
    return FL.packet_gaps(t.packets, SLICE).select("seq", F.round("gap", 4).alias("gap"))


@query("win_02_direction_gap", """
SELECT seq, src_ip, round(CASE WHEN g>=0 THEN g END,4) AS dir_gap FROM (
  SELECT *, ts - lag(ts) OVER (PARTITION BY fkey, CASE WHEN protocol='ICMP' THEN '*' ELSE src_ip END ORDER BY seq) AS g FROM x_keyed)""")
def _(t):
    return FL.packet_gaps(t.packets, SLICE).select("seq", "src_ip", F.round("dir_gap", 4).alias("dir_gap"))


@query("win_09_first_last_values", f"""
WITH {_HEADS} SELECT {_ENDS}, cast(arg_min(win, seq) FILTER (WHERE fwd AND protocol='TCP') AS bigint) AS init_win_fwd,
  cast(arg_min(win, seq) FILTER (WHERE NOT fwd AND protocol='TCP') AS bigint) AS init_win_bwd FROM p {_GROUP}""")
def _(t):
    return built(t).select(*KEY, F.col("init_win_fwd").cast("bigint").alias("init_win_fwd"),
                           F.col("init_win_bwd").cast("bigint").alias("init_win_bwd"))


@query("scl_11_app_layer", f"""
SELECT seq, {_LAYER} AS layer FROM (SELECT *, dst_port AS srv FROM x_packets)""")
def _(t):
    c = F.col
    return t.packets.select("seq", net.app_layer(c("protocol"), c("dst_port"), c("src_port"), c("dst_port"), c("payload_len"),
                                                 c("first_byte"), c("is_request")).alias("layer"))


@query("str_04_idle_sessions", """
WITH s AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w < 86400000000 THEN 0 ELSE 1 END AS fresh, (ts_us - lag(ts_us) OVER w)/1e6 AS g FROM x_events
  WINDOW w AS (PARTITION BY src_ip, dst_ip, src_port, dst_port, protocol ORDER BY ts_us)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY src_ip, dst_ip, src_port, dst_port, protocol ORDER BY ts_us) AS sid FROM s)
SELECT src_ip, dst_ip, src_port, dst_port, protocol, min(ts_us) AS start_us, count(*) AS packets_sent, cast(sum(length) AS bigint) AS bytes_sent,
  min(length) AS pkt_len_min, max(length) AS pkt_len_max, (max(ts_us)-min(ts_us))//1000 AS duration_ms, count(*) AS packets_recv,
  round(coalesce(avg(g) FILTER (WHERE fresh=0 AND g>0),0),3) AS iat_mean, round(coalesce(max(g) FILTER (WHERE fresh=0 AND g>0),0),3) AS iat_max,
  round(coalesce(stddev_pop(g) FILTER (WHERE fresh=0 AND g>0),0),2) AS iat_std FROM r GROUP BY 1,2,3,4,5,sid""")
def _(t):
    return FL.idle_flows(t.events, 86400).select(
        *KEY, F.unix_micros("start_time").alias("start_us"), "packets_sent", "bytes_sent", "pkt_len_min", "pkt_len_max",
        "duration_ms", "packets_recv", F.round("iat_mean", 3).alias("iat_mean"), F.round("iat_max", 3).alias("iat_max"),
        F.round("iat_std", 2).alias("iat_std"))
