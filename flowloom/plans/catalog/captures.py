"""Captures: frames of the given packets decoded from tables and from files cut into ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom import constants as K
from flowloom.plans.analysis import analyse_packets
from flowloom.plans.catalog import query
from flowloom.plans.catalog.flowbuild import _HEADS, _LAYER
from flowloom.plans.catalog.live import _finish, scratch
from flowloom.session import stored
from flowloom.sources import capture
from flowloom.streaming import live

_KEPT = "seq % 17 <> 0 AND seq % 19 <> 0"
_COLUMNS = """src_ip, dst_ip, cast(src_port AS int) AS src_port, cast(dst_port AS int) AS dst_port, protocol,
  cast(((payload_len % 200) + 200) % 200 AS int) AS payload_len, CASE WHEN protocol='TCP' THEN 20 END AS header_len,
  CASE WHEN protocol='TCP' THEN cast(tcp_flags AS int) END AS tcp_flags, CASE WHEN protocol='TCP' THEN cast(win AS int) END AS win,
  CASE WHEN protocol='TCP' AND ((payload_len % 200) + 200) % 200 > 0 THEN 120 END AS first_byte"""
_NAMES = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "payload_len", "header_len", "tcp_flags", "win", "first_byte"]


def written(t):
    """The frames of the given packets as capture files of the shared folder."""
    out = scratch(t, "captures")
    if "://" not in out:  # a plain path, or Spark's short form of a local one
        out = f"file://{out.removeprefix('file:')}"
    return stored(capture.write_captures(t.frames.repartition(4, "seq").sortWithinPartitions("seq"), out), "capture-files")


@query("src_02_frames_to_packets", f"SELECT seq, round(ts, 3) AS ts, {_COLUMNS} FROM x_packets WHERE {_KEPT}")
def _(t):
    rows = capture.decode_frames(t.frames).where("skipped IS NULL")
    return rows.select("seq", F.round("ts", 3).alias("ts"), *_NAMES)


@query("src_01_capture_ranges", f"SELECT round(ts, 3) AS ts, {_COLUMNS} FROM x_packets WHERE {_KEPT}")
def _(t):
    """Captures are written, cut into small ranges and decoded range by range."""
    return capture.packets(written(t), range_bytes=1 << 16).select(F.round("ts", 3).alias("ts"), *_NAMES)


@query("src_03_skipped_frames", """
SELECT CASE WHEN seq % 19 = 0 THEN 'not_ip' ELSE 'short_ip' END AS reason, count(*) AS frames FROM x_packets
WHERE seq % 17 = 0 OR seq % 19 = 0 GROUP BY 1""")
def _(t):
    return capture.skipped_packets(capture.decode_files(written(t), 1 << 18)).groupBy("reason").agg(F.sum("frames").alias("frames"))


def _listed(t):
    """The written captures as Spark lists them, and what their writers said of them."""
    made = written(t)
    folder = made.select("path").first()["path"].rsplit("/", 1)[0]
    return capture.read_files(t.spark, folder), made


@query("agg_33_file_inventory", """
SELECT 4 AS files, cast(4 * 24 + sum(16 + CASE WHEN seq % 17 = 0 THEN 30 ELSE 34 + ((payload_len % 200) + 200) % 200
  + CASE protocol WHEN 'TCP' THEN 20 WHEN 'UDP' THEN 8 ELSE 4 END END) AS bigint) AS bytes FROM x_packets""")
def _(t):
    files, _ = _listed(t)
    return capture.inventory(files).agg(F.count(F.lit(1)).cast("int").alias("files"), F.sum("size").cast("bigint").alias("bytes"))


@query("src_06_closed_chunks", """
SELECT 3 AS closed, count(*) AS packets FROM x_packets""")
def _(t):
    """One of four chunks has been processed; the packets of the open ones and its own are all there are."""
    files, made = _listed(t)
    first = F.col("path").endswith("part-00000.pcap")
    closed = capture.closed_chunks(files, files.where(first).select("path"), quiet_seconds=0)
    rest = capture.decode_files(closed.select("path", "length")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").cast("int").alias("closed"))
    done = made.where(first).agg(F.sum("records").alias("own"))
    return rest.crossJoin(done).select("closed", (F.col("n") + F.col("own")).alias("packets"))  # one row each


#: Flows to a listed port are whitelisted; no network or name of these packets is.
_LISTED = " OR ".join(f"f_dport = {port} AND protocol = '{name}'" for port, name in K.WHITELIST_PORTS)


@query("src_09_packets_to_findings", f"""
WITH {_HEADS}, q AS (SELECT *, CASE WHEN fwd THEN dst_port ELSE src_port END AS srv FROM p), l AS (SELECT *, {_LAYER} AS layer FROM q),
f AS (SELECT fkey, f_dport AS port, arg_max(layer, seq) FILTER (WHERE layer IS NOT NULL) AS app, sum(payload_len) AS total,
  coalesce(sum(payload_len) FILTER (WHERE fwd), 0) AS sent FROM l WHERE NOT ({_LISTED}) GROUP BY fkey, f_dport)
SELECT 'ARPSPOOFING-001' AS rule_id, count(*) AS findings FROM x_arp WHERE op = 1
UNION ALL SELECT 'DNSTUNNEL-001', count(*) FROM f WHERE app = 'DNS' AND total > 200
UNION ALL SELECT 'PORTMISMATCH-001', count(*) FROM f WHERE (app = 'SSH' AND port <> 22) OR (app = 'HTTP' AND port NOT IN (80, 443, 8080, 8000)) OR (app = 'DNS' AND port <> 53)
UNION ALL SELECT 'OBSERVABLES', count(*) FROM (SELECT src_ip FROM x_packets UNION SELECT dst_ip FROM x_packets)""")
def _(t):
    """Packets with ARP events to flows, names, observables and findings in one call."""
    arp = t.arp.select(F.lit("capture").alias("file"), F.col("op").alias("arp_op"), "sender_mac", "sender_ip", "target_ip", "ts")
    found = analyse_packets(t.packets.unionByName(arp, allowMissingColumns=True), lambda flows: flows.withColumn("anomaly_score", F.lit(1.0)))
    rules = found.findings.where(F.col("rule_id").isin("ARPSPOOFING-001", "DNSTUNNEL-001", "PORTMISMATCH-001"))
    addresses = found.observables.where("type = 'ip'").agg(F.count(F.lit(1)).alias("findings"))
    return rules.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings")).unionByName(
        addresses.select(F.lit("OBSERVABLES").alias("rule_id"), "findings"))


@query("str_10_chunk_analysis", f"""
SELECT 4 AS analyses, count(*) AS packets, cast(sum(((payload_len % 200) + 200) % 200) AS bigint) AS bytes FROM x_packets WHERE {_KEPT}""")
def _(t):
    """Every closed chunk of a file stream becomes an analysis with its flows; the stream runs twice over the same chunks."""
    made, out = written(t), scratch(t, "chunks")
    folder = made.select("path").first()["path"].rsplit("/", 1)[0]
    for checkpoint in ("first", "again"):
        stream = t.spark.readStream.format("binaryFile").schema(capture.read_files(t.spark, folder).schema).option("pathGlobFilter", "*.pcap").load(folder)
        _finish(live.analyse_chunks(stream, out, f"{out}-{checkpoint}"))
    flows = t.spark.read.parquet(f"{out}/flows")
    return flows.agg(F.count_distinct("analysis_id").cast("int").alias("analyses"), F.sum(F.col("packets_sent") + F.col("packets_recv")).alias("packets"),
                     F.sum(F.col("bytes_sent") + F.col("bytes_recv")).alias("bytes"))
