"""One query through the whole detection path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import findings as FI
from flowloom.operators import report as RP
from flowloom.operators import rules as R
from flowloom.operators import whitelist as W
from flowloom.plans.adapters import Tables


def severity_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by severity with the highest flow severity behind them."""
    flows = W.mark_whitelisted(Tables(spark, sf_dir).flows, cidrs=["45.33.0.0/27"])
    active = flows.where(~F.col("is_whitelisted"))
    found = FI.union_findings(
        FI.as_findings(R.horizontal_scan(active, min_ports=3, window_s=250_000_000), "PORTSCAN-001"),
        FI.as_findings(R.exfiltration(active, 1.9), "EXFIL-001"),
        FI.as_findings(R.port_mismatch(active), "PORTMISMATCH-001"))
    severity = FI.hybrid_severity(active.select("flow_id", "anomaly_score"), found)
    worst = found.join(severity.select("flow_id", F.col("severity_score").alias("flow_severity")), "flow_id")
    peak = worst.groupBy("severity").agg(F.max("flow_severity").alias("worst_flow"))
    return RP.findings_by(found, "severity").join(peak, "severity", "left")
