"""Findings: one row per rule, anomaly, intel or signature hit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom import constants as K
from flowloom.functions import values
from flowloom.operators import rules as R


def finding_id(*parts: Column) -> Column:
    """Deterministic id, so a repeated run overwrites instead of duplicating."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def _with_rule_fields(hits: DataFrame, rule_id: Column, analysis_id: Column) -> DataFrame:
    def field(get) -> Column:
        return values.lookup({k: get(r) for k, r in R.RULES.items()}, F.col("rule_id"), None)

    base = hits.withColumn("rule_id", rule_id).withColumn("analysis_id", analysis_id)
    severity = field(lambda r: r.severity)
    return base.select(
        finding_id("analysis_id", "rule_id", F.coalesce(F.col("flow_id").cast("string"), F.lit("")),
                   "evidence").alias("finding_id"),
        "analysis_id", "flow_id", "rule_id", field(lambda r: r.source).alias("source"),
        field(lambda r: r.title).alias("title"), severity.alias("severity"),
        values.severity_score(severity).alias("severity_score"), "evidence",
        field(lambda r: r.tactic).alias("mitre_tactic"),
        field(lambda r: r.technique).alias("mitre_technique"),
        F.lit(False).alias("is_false_positive"),
    )


def evidence_of(hits: DataFrame, without: Sequence[str] = ()) -> Column:
    return F.to_json(F.struct(*[c for c in hits.columns if c != "flow_id" and c not in without]))


def as_findings(hits: DataFrame, rule_id: str, analysis_id: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Rule metadata times hit evidence; the evidence is every column but the flow id and ``by``."""
    evidence = evidence_of(hits, by)
    flow = F.col("flow_id") if "flow_id" in hits.columns else F.lit(None).cast("bigint")
    rows = hits.select(*by, flow.alias("flow_id"), evidence.alias("evidence"))
    return _with_rule_fields(rows, F.lit(rule_id), analysis_id if analysis_id is not None else F.lit("all"))


def union_findings(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def rule_findings(flows: DataFrame, arp: DataFrame | None = None, observables: DataFrame | None = None,
                  analysis_id: str = "all", by: Sequence[str] = (), names: DataFrame | None = None, **params) -> DataFrame:
    """All rules over one set of flows. ``params`` maps a rule function's name to its arguments.

    With ``by`` each value of those columns is an analysis of its own: groups, rates and means do not
    mix, and the findings carry the values as their analysis id.

    Rules that look at single flows share one pass, and so do the two kinds of beacon; the others aggregate on their own keys. Flows built from
    packets show some of their names only; ``names`` (``flow_id``, ``kind``, ``value``) has them all, and the
    rules about names read it where it is given.
    """
    aid = F.concat_ws("|", *[F.col(c).cast("string") for c in by]) if by else F.lit(analysis_id)

    def args(fn) -> dict:
        return {**params.get(fn.__name__, {}), "by": by}

    def requests(frame: DataFrame) -> DataFrame:
        return R.arp_requests(frame, **params.get("arp_requests", {}))

    grouped = {
        "PORTSCAN-001": R.horizontal_scan, "PORTSCAN-002": R.host_sweep, "DNSTUNNEL-002": R.dns_rate, "DNSTUNNEL-003": R.entropic_labels,
        "DGATOP-001": R.generated_domains, "EXFIL-001": R.exfiltration, "LATERAL-001": R.lateral_movement,
    }
    looked_up = flows if names is None else names.where("kind = 'dns'").select(
        "flow_id", F.array("value").alias("dns_queries")).join(flows.drop("dns_queries"), "flow_id")
    about_names = ("DNSTUNNEL-002", "DNSTUNNEL-003", "DGATOP-001")
    frames = [_with_rule_fields(R.single_flow_hits(flows, **args(R.single_flow_hits)), F.col("rule_id"), aid)]
    frames += [as_findings(fn(looked_up if rid in about_names else flows, **args(fn)), rid, aid, by) for rid, fn in grouped.items()]
    paces = {"BEACON-001": R.Pace(**params.get("beacons", {})), "BEACON-002": replace(R.SLOW, **params.get("slow_beacons", {}))}
    paced = R.paced_connections(flows, paces, by)
    frames.append(_with_rule_fields(paced.select(*by, "flow_id", "rule_id", evidence_of(paced, [*by, "rule_id"]).alias("evidence")),
                                    F.col("rule_id"), aid))
    if arp is not None:
        frames += [as_findings(requests(arp), "ARPSPOOFING-001", aid, by),
                   as_findings(R.arp_storm(arp, **args(R.arp_storm)), "ARPSPOOFING-002", aid, by)]
    if observables is not None:
        frames.append(as_findings(R.new_domains(observables, by), "NEWDOMAIN-001", aid, by))
    return union_findings(*frames)


def ml_findings(scored: DataFrame, threshold: float = 5.0, analysis_id: str = "all") -> DataFrame:
    hits = R.anomaly_findings(scored, threshold)
    rows = hits.select("flow_id", "anomaly_score", F.to_json(F.struct(
        "anomaly_score", "src_ip", "dst_ip", "src_port", "dst_port", "protocol")).alias("evidence"))
    scores = rows.select("flow_id", "evidence", "anomaly_score")
    base = _with_rule_fields(scores, F.lit("ML-ANOMALY-001"), F.lit(analysis_id))
    own = F.get_json_object("evidence", "$.anomaly_score").cast("double")
    return base.withColumn("severity_score", own)


def signature_findings(alerts: DataFrame, analysis_id: str = "all", pairs: int = 5) -> DataFrame:
    """One finding per signature with its hit count, its number of host pairs and the first of them.

    :func:`signature_pairs` lists all pairs. Pairs are numbered after a distinct per signature, so a signature that fired on most of the
    data keeps only ``pairs`` entries per task before the shuffle.
    """
    key = F.coalesce(F.col("signature_id").cast("string"), F.col("signature"))
    keyed = alerts.withColumn("sig", key)
    pair = F.concat_ws(" → ", "src_ip", "dst_ip")
    counts = keyed.groupBy("sig").agg(
        F.count(F.lit(1)).alias("hit_count"), F.min("signature").alias("signature"),
        F.min("category").alias("category"), F.min("severity").alias("level"))
    distinct = keyed.select("sig", pair.alias("pair")).distinct()
    totals = distinct.groupBy("sig").agg(F.count(F.lit(1)).alias("pair_count"))
    numbered = distinct.withColumn(
        "_n", F.row_number().over(Window.partitionBy("sig").orderBy("pair"))).where(F.col("_n") <= pairs)
    shown = numbered.groupBy("sig").agg(F.array_sort(F.collect_list("pair")).alias("host_pairs"))
    severity = values.signature_severity(F.col("level"), "finding")
    return counts.join(shown, "sig").join(totals, "sig").select(
        finding_id(F.lit(analysis_id), "sig").alias("finding_id"), F.lit(analysis_id).alias("analysis_id"),
        F.concat(F.lit("SIGNATURE-"), "sig").alias("rule_id"), F.lit("suricata").alias("source"),
        F.concat(F.lit("Signature: "), "signature").alias("title"), severity.alias("severity"),
        values.lookup(K.SIGNATURE_FINDING_SCORES, severity, 3.0).alias("severity_score"),
        F.to_json(F.struct("signature", "category", "hit_count", "host_pairs", "pair_count")).alias("evidence"),
        "hit_count", "host_pairs", F.lit(False).alias("is_false_positive"),
    )


def signature_pairs(alerts: DataFrame) -> DataFrame:
    """(rule_id, src_ip, dst_ip): every host pair a signature fired on."""
    key = F.coalesce(F.col("signature_id").cast("string"), F.col("signature"))
    return alerts.select(F.concat(F.lit("SIGNATURE-"), key).alias("rule_id"), "src_ip", "dst_ip").distinct()


def intel_correlation(ml_rows: DataFrame, flows: DataFrame, observables: DataFrame) -> DataFrame:
    """Flagged flows with a malicious endpoint; one high finding per flow.

    Each flow offers its two endpoints as keys, at most two rows per flow, to an equi join with the
    malicious values.
    """
    flagged = ml_rows.where((F.col("source") == "ml") & ~F.col("is_false_positive")
                            & F.col("flow_id").isNotNull()).select("flow_id").distinct()
    bad = observables.where(F.col("is_malicious")).select("value").distinct()
    ends = flows.join(flagged, "flow_id", "left_semi").select(
        "flow_id", "anomaly_score", F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))).alias("value"))
    return ends.join(bad, "value", "left_semi").groupBy("flow_id").agg(
        F.max("anomaly_score").alias("anomaly_score"),
        F.array_sort(F.collect_set("value")).alias("indicators"),  # two endpoints at most
    ).select("flow_id", "anomaly_score", "indicators", F.lit("high").alias("severity"),
             F.lit(9.0).alias("severity_score"), F.lit("ti_correlation").alias("source"))


def hybrid_severity(flows: DataFrame, findings: DataFrame, boundary: float = K.ANOMALY_BOUNDARY) -> DataFrame:
    """Flow severity from its anomaly score and its findings' scores."""
    scoring = F.when(F.col("source").isin(*K.RULE_SCORE_SOURCES), F.col("severity_score"))
    per_flow = findings.where(F.col("flow_id").isNotNull()).groupBy("flow_id").agg(
        F.max(scoring).alias("_top"), F.count(F.lit(1)).alias("_findings"))
    anomaly = F.coalesce("anomaly_score", F.lit(0.0))
    boost = F.when(anomaly >= boundary, anomaly * 0.4 * 0.25).otherwise(0.0)
    with_findings = F.greatest(anomaly, F.coalesce("_top", anomaly)) + boost
    raw = F.when(F.col("_findings").isNull(), anomaly).otherwise(with_findings)
    return (flows.join(per_flow, "flow_id", "left")
            .withColumn("severity_score", F.least(F.lit(10.0), F.round(raw, 2)))
            .drop("_top", "_findings"))


def risk_score(findings: DataFrame, by: str = "analysis_id", top: int = 5) -> DataFrame:
    """Mean of each analysis' highest scores; the rank filter is applied before the shuffle too."""
    ranked = findings.where(~F.col("is_false_positive")).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("severity_score"))))
    return ranked.where(F.col("_rank") <= top).groupBy(by).agg(
        F.least(F.lit(10.0), F.round(F.avg("severity_score"), 2)).alias("risk_score"))


def with_flow(findings: DataFrame, flows: DataFrame) -> DataFrame:
    """Findings with their flow's columns; findings without a flow stay."""
    extra = [c for c in flows.columns if c not in findings.columns or c == "flow_id"]
    return findings.join(flows.select(*extra), "flow_id", "left")


def scores_with_findings(flows: DataFrame, findings: DataFrame, source: str = "ml") -> DataFrame:
    """Flows that a source's findings point at, with their score and the number of those findings.

    Findings are counted per flow first, so a flow with very many of them is one row in the join.
    """
    counts = findings.where((F.col("source") == source) & F.col("flow_id").isNotNull()).groupBy("flow_id").agg(
        F.count(F.lit(1)).alias("findings"))
    return flows.select("flow_id", "anomaly_score").join(counts, "flow_id")


def evidence_observables(findings: DataFrame, observables: DataFrame) -> DataFrame:
    """Observables of the addresses a finding's evidence names, gathered per finding (two at most)."""
    ips = findings.select("finding_id", F.explode(F.array_distinct(F.array_compact(F.array(
        F.get_json_object("evidence", "$.src_ip"), F.get_json_object("evidence", "$.dst_ip"))))).alias("value"))
    hits = ips.join(observables.where(F.col("type") == "ip"), "value")
    return hits.groupBy("finding_id").agg(
        F.count(F.lit(1)).alias("observables"),
        F.array_join(F.array_sort(F.collect_set("value")), ",").alias("values"))


def escalate(findings: DataFrame, malicious_targets: DataFrame) -> DataFrame:
    """Low and medium findings with a malicious target become high, with a score of at least 8."""
    hit = malicious_targets.select("finding_id", F.lit(True).alias("_bad")).distinct()
    up = F.coalesce("_bad", F.lit(False)) & F.col("severity").isin("low", "medium")
    joined = findings.join(hit, "finding_id", "left")
    return joined.withColumn("_up", up).withColumn(
        "severity_score", F.when(F.col("_up"), F.greatest(F.coalesce("severity_score", F.lit(0.0)), F.lit(8.0)))
        .otherwise(F.col("severity_score"))).withColumn(
        "severity", F.when(F.col("_up"), "high").otherwise(F.col("severity"))).drop("_up", "_bad")


def targets(kinds: list[tuple[str, Column]], names: Column | None = None, limit: int | None = None) -> Column:
    """Distinct valid (kind, value) targets in priority order as an array built inside the row.

    ``names`` is an array of further domains; ``limit`` keeps the first ones only.
    """
    from flowloom.functions import net, text

    def entry(kind: str, value: Column) -> Column:
        def target(v: Column, valid: Column, public: Column) -> Column:
            return F.when(valid, F.struct(F.lit(kind).alias("kind"), v.alias("value"), public.alias("public")))

        v = F.trim(value)
        if kind == "domain":
            return target(v, value.isNotNull() & text.looks_like_domain(v), F.lit(True))
        return net.bound(net.address_class(v), lambda m: target(v, net.has(m, net.V4, net.V6), ~net.has(m, net.INTERNAL)))

    found = F.array(*[entry(k, v) for k, v in kinds])
    if names is not None:
        found = F.concat(found, F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: entry("domain", n)))
    found = F.array_distinct(F.array_compact(found))
    return found if limit is None else F.slice(found, 1, limit)


_EVIDENCE_IPS = ["src_ip", "dst_ip", "dest_ip", "ip"]
_EVIDENCE_NAMES = ["domain", "hostname", "apex", "dns_query", "tls_sni"]


def finding_targets(findings: DataFrame, flows: DataFrame, limit: int | None = None) -> DataFrame:
    """Addresses and names worth a look-up: the evidence first, then the flow with all names it asked for."""
    fields = ", ".join(f"{n} STRING" for n in _EVIDENCE_IPS + _EVIDENCE_NAMES)
    read = findings.select("finding_id", "flow_id", F.from_json("evidence", fields).alias("ev"))
    joined = with_flow(read, flows.select("flow_id", "src_ip", "dst_ip", "tls_sni", "dns_queries"))
    seen = [("ip", F.col(f"ev.{k}")) for k in _EVIDENCE_IPS] + [("domain", F.col(f"ev.{k}")) for k in _EVIDENCE_NAMES]
    seen += [("ip", F.col("src_ip")), ("ip", F.col("dst_ip")), ("domain", F.col("tls_sni"))]
    return joined.select("finding_id", F.posexplode(targets(seen, F.col("dns_queries"), limit)).alias("position", "t")).select(
        "finding_id", (F.col("position") + 1).cast("bigint").alias("position"), "t.kind", "t.value", "t.public")


def apply_feedback(findings: DataFrame, feedback: DataFrame) -> DataFrame:
    """Overlay analysts' false-positive marks (``finding_id``, ``is_false_positive``)."""
    marks = feedback.groupBy("finding_id").agg(F.bool_or("is_false_positive").alias("_fp"))
    return findings.join(marks, "finding_id", "left").withColumn(
        "is_false_positive", F.coalesce("_fp", "is_false_positive", F.lit(False))).drop("_fp")
