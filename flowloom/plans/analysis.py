"""Capture analysis end to end: packets to flows, whitelist, rules, scores, findings and report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions import net
from flowloom.operators import findings as FI
from flowloom.operators import flows as FL
from flowloom.operators import report as RP
from flowloom.operators import whitelist as W
from flowloom.session import stored
from flowloom.sources import capture


@dataclass
class Analysis:
    flows: DataFrame
    findings: DataFrame
    risk: DataFrame
    observables: DataFrame | None = None

    def report(self, observables: DataFrame, analysis_id: str) -> DataFrame:
        head = self.flows.sparkSession.range(1).select(F.lit(analysis_id).alias("analysis_id"))
        return RP.report_document(head, self.flows, self.findings, observables, self.risk)


def analyse_flows(flows: DataFrame, observables: DataFrame | None = None, arp: DataFrame | None = None,
                  signatures: DataFrame | None = None, threshold: float = 5.0, analysis_id: str = "all",
                  strict: bool = True, lists: dict | None = None, rule_params: dict | None = None,
                  keep: bool = True, names: DataFrame | None = None) -> Analysis:
    """Detect on flows that already carry ``anomaly_score``.

    The whitelisted and scored flows feed every rule, so they are written once (``keep``) and read
    back column by column; without ``keep`` every rule scans the source again.
    """
    marked = net.with_address_classes(W.with_suppression(W.mark_whitelisted(flows, **(lists or {})), strict), "src_ip", "dst_ip")
    base = stored(marked, "analysed-flows") if keep else marked
    active = base.where(~F.col("is_whitelisted"))
    found = [FI.rule_findings(active, arp, observables, analysis_id, names=names, **(rule_params or {})),
             FI.ml_findings(active, threshold, analysis_id)]
    if signatures is not None:
        found.append(FI.signature_findings(signatures, analysis_id))
    findings = FI.union_findings(*found)
    if keep:
        findings = stored(findings, "findings")
    if observables is not None:
        matched = FI.intel_correlation(findings, base, observables)
        intel = matched.select(
            FI.finding_id(F.lit(analysis_id), F.lit("TI-CORR-001"), F.col("flow_id").cast("string")).alias("finding_id"),
            F.lit(analysis_id).alias("analysis_id"), "flow_id", F.lit("TI-CORR-001").alias("rule_id"), "source",
            F.lit("Threat intel — anomaly on malicious indicator").alias("title"), "severity", "severity_score",
            F.to_json(F.struct("indicators", "anomaly_score")).alias("evidence"), F.lit(False).alias("is_false_positive"))
        findings = FI.union_findings(findings, intel)
    scored = FI.hybrid_severity(base.drop(*map(net.class_column, ("src_ip", "dst_ip"))), findings)
    return Analysis(scored, findings, FI.risk_score(findings))


def analyse_packets(decoded: DataFrame, score: Callable[[DataFrame], DataFrame],
                    enrich: Callable[[DataFrame], DataFrame] | None = None, **options) -> Analysis:
    """From decoded packets to the report's parts; ``score`` adds ``anomaly_score`` to flows.

    Packets are decoded and stored once; flows, all their names, observables and ARP events read the
    columns they need of that table. ``enrich`` adds what intelligence says of the observables
    (``is_malicious``, ``newly_registered``); without it nothing is known of any.
    """
    packets = stored(decoded, "packets")
    seen = capture.ip_packets(packets)
    flows, names = stored(FL.flow_table(seen), "flows"), stored(FL.flow_names(seen), "names")
    shown = FL.with_names(flows, names).drop(*[k for k in FL.KEY if k not in ("file", "protocol")])
    observables = FL.build_observables(seen)
    observables = enrich(observables) if enrich else observables.withColumns(
        {"is_malicious": F.lit(False), "newly_registered": F.lit(False)})
    found = analyse_flows(score(shown), observables, capture.arp_events(packets), names=FL.names_by_flow(flows, names), **options)
    found.observables = observables
    return found
