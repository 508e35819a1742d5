"""Schemas of the main tables and alias resolution for foreign column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOW_COLUMNS = [
    "flow_id", "analysis_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "start_time",
    "duration_ms", "bytes_sent", "bytes_recv", "packets_sent", "packets_recv", "application_layer",
    "dns_queries", "http_hosts", "tls_sni",
]

PACKETS = (
    "file STRING, seq BIGINT, ts DOUBLE, src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, "
    "protocol STRING, payload_len INT, header_len INT, tcp_flags INT, win INT, first_byte INT, "
    "is_request BOOLEAN, sni STRING, http_host STRING, user_agent STRING, dns_qnames ARRAY<STRING>, "
    "tls_version INT, tls_ciphers ARRAY<INT>, tls_extensions ARRAY<INT>, tls_groups ARRAY<INT>, "
    "tls_formats ARRAY<INT>, frame_len INT, icmp_type INT, arp_op INT, sender_mac STRING, "
    "sender_ip STRING, target_ip STRING"
)

SENSOR_EVENT = (
    "timestamp STRING, event_type STRING, src_ip STRING, dest_ip STRING, dst_ip STRING, src_port INT, "
    "dest_port INT, dst_port INT, proto STRING, app_proto STRING, flow_id BIGINT, tx_id BIGINT, "
    "in_iface STRING, pcap_cnt BIGINT, pkt_len INT, reason STRING, action STRING, "
    "flow STRUCT<pkts_toserver: BIGINT, pkts_toclient: BIGINT, bytes_toserver: BIGINT, "
    "bytes_toclient: BIGINT, start: STRING, end: STRING, age: INT, state: STRING, reason: STRING, "
    "alerted: BOOLEAN, mean_delta: DOUBLE>, "
    "alert STRUCT<signature: STRING, signature_id: BIGINT, category: STRING, severity: INT, action: STRING>, "
    "tcp STRUCT<syn: BOOLEAN, fin: BOOLEAN, rst: BOOLEAN>, "
    "dns STRUCT<type: STRING, rrname: STRING>, "
    "http STRUCT<hostname: STRING, http_method: STRING, method: STRING, url: STRING>, "
    "tls STRUCT<sni: STRING, subject: STRING>"
)

FINDINGS = (
    "finding_id STRING, analysis_id STRING, flow_id BIGINT, rule_id STRING, source STRING, title STRING, "
    "description STRING, severity STRING, severity_score DOUBLE, evidence STRING, mitre_tactic STRING, "
    "mitre_technique STRING, recommendation STRING, is_false_positive BOOLEAN"
)


def find_column(df: DataFrame, aliases: list[str]) -> str | None:
    """First alias present in ``df``, ignoring case and surrounding blanks."""
    exact = {c.strip(): c for c in df.columns}
    folded = {c.strip().lower(): c for c in df.columns}
    for alias in aliases:
        if alias in exact:
            return exact[alias]
        if alias.lower() in folded:
            return folded[alias.lower()]
    return None


def column_of(name: str) -> Column:
    """A column whose name may hold dots, slashes or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def conform(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename a caller's columns to the canonical ones: ``{"src_ip": "client_address", …}``."""
    renamed = {theirs: ours for ours, theirs in names.items()}
    return df.withColumnsRenamed(renamed)


def unknown_features(names: list[str], known: list[str]) -> list[str]:
    return [n for n in names if n not in known]
