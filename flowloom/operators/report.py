"""Report aggregates, top lists, filters, pages and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions import net, values


def _blank_as_null(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def findings_by(findings: DataFrame, key: str) -> DataFrame:
    """Findings per severity or source, false positives left out."""
    return count_by(findings.where(~F.col("is_false_positive")).withColumn(
        key, F.coalesce(key, F.lit("unknown"))), key)


def top(df: DataFrame, order: str, tie: str, n: int) -> DataFrame:
    """Highest ``order`` first; ``tie`` makes the cut repeatable."""
    return df.orderBy(F.desc(order), F.asc_nulls_last(tie)).limit(n)


def protocol_distribution(flows: DataFrame, n: int = 10) -> DataFrame:
    name = F.coalesce(_blank_as_null("application_layer"), F.col("protocol"))
    return top(count_by(flows.withColumn("name", name), "name"), "n", "name", n)


def top_talkers(flows: DataFrame, n: int = 10) -> DataFrame:
    sums = flows.groupBy("src_ip").agg(F.sum(F.col("bytes_sent") + F.col("bytes_recv")).alias("bytes"))
    return top(sums, "bytes", "src_ip", n)


def top_domains(flows: DataFrame, n: int = 20) -> DataFrame:
    return top(count_by(flows.select(F.explode("dns_queries").alias("domain")), "domain"), "n", "domain", n)


def top_ports(flows: DataFrame, n: int = 20) -> DataFrame:
    return top(count_by(flows, "dst_port"), "n", "dst_port", n)


def traffic_timeline(flows: DataFrame, unit: str = "minute") -> DataFrame:
    """Bytes per minute; the minute is text, so it sorts and prints the same everywhere."""
    bucket = F.date_format(F.date_trunc(unit, "start_time"), "yyyy-MM-dd HH:mm")
    return flows.where(F.col("start_time").isNotNull()).groupBy(bucket.alias("minute")).agg(
        F.sum(F.col("bytes_sent") + F.col("bytes_recv")).alias("bytes"))


def flow_metrics(flows: DataFrame, private_only: bool = True) -> DataFrame:
    """Flow totals. The report calls an address external when it is not private, the metrics view when
    it is public Internet (``private_only=False``)."""
    inside = net.is_private_ip(F.col("dst_ip")) if private_only else net.is_internal_ip(F.col("dst_ip"))
    outside = F.when(~inside & (F.col("dst_ip") != ""), F.col("dst_ip"))
    return flows.agg(
        F.count(F.lit(1)).alias("total_flows"), F.count_if("is_whitelisted").alias("whitelisted_flows"),
        F.count_distinct(outside).alias("unique_external_ips"))


def observable_metrics(observables: DataFrame) -> DataFrame:
    return observables.agg(
        F.count_if("is_malicious").alias("malicious_observables"),
        F.count_if((F.col("status") == "complete") & F.col("has_intel")).alias("investigated_count"))


def overview(analyses: DataFrame) -> DataFrame:
    """Totals over all analyses in one conditional aggregation."""
    n = F.count(F.lit(1))
    complete, failed = F.count_if(F.col("status") == "complete"), F.count_if(F.col("status") == "failed")
    return analyses.agg(
        n.alias("total_analyses"), complete.alias("complete"), failed.alias("failed"),
        (n - complete - failed).alias("in_progress"),
        F.count_if(F.col("source") != "live").alias("pcap_count"),
        F.count_if(F.col("source") == "live").alias("live_count"),
        F.round(F.coalesce(F.avg(F.when(F.col("status") == "complete", F.col("risk_score"))), F.lit(0.0)), 2)
        .alias("avg_risk_score"),
        F.coalesce(F.sum("total_flows"), F.lit(0)).alias("total_flows"),
        F.coalesce(F.sum("total_findings"), F.lit(0)).alias("total_findings"))


def geo_markers(observables: DataFrame) -> DataFrame:
    """Address observables with a usable position."""
    return observables.where(
        (F.col("type") == "ip") & (F.coalesce("lat", F.lit(0.0)) != 0) & (F.coalesce("lon", F.lit(0.0)) != 0))


def threat_map(analyses: DataFrame, observables: DataFrame, newest: int | None = None, per_analysis: int | None = None,
               total: int | None = None) -> DataFrame:
    """Markers of all analyses or of the newest, of all their observables or the first ``per_analysis``.

    A rank limit applies before the shuffle.
    """
    recent = analyses.select("analysis_id", "created_at")
    if newest is not None:
        recent = F.broadcast(recent.orderBy(F.desc("created_at"), F.asc("analysis_id")).limit(newest))
    hits = observables.join(recent, "analysis_id")
    if per_analysis is not None:
        hits = hits.withColumn("_r", F.row_number().over(
            Window.partitionBy("analysis_id").orderBy("type", "value"))).where(F.col("_r") <= per_analysis).drop("_r")
    ordered = geo_markers(hits).orderBy(F.desc("created_at"), "analysis_id", "type", "value")
    return ordered if total is None else ordered.limit(total)


# ---- filters and pages ---------------------------------------------------------------------

def filter_findings(findings: DataFrame, severity: str | None = None, source: str | None = None) -> DataFrame:
    out = findings
    if severity:
        out = out.where(F.col("severity") == severity)
    if source:
        out = out.where(F.col("source") == source)
    return out.orderBy(F.desc("severity_score"), F.asc("finding_id"))


def filter_flows(flows: DataFrame, protocol: str | None = None, flagged: bool = False,
                 not_whitelisted: bool = False) -> DataFrame:
    out = flows
    if protocol:
        out = out.where(F.col("protocol") == protocol)
    if flagged:
        out = out.where(F.col("severity_score") > 0)
    if not_whitelisted:
        out = out.where(~F.col("is_whitelisted"))
    return out


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1). A total order makes pages disjoint."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def pages(df: DataFrame, size: int) -> DataFrame:
    """Row total and number of pages."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def filter_observables(observables: DataFrame, kind: str) -> DataFrame:
    return observables.where(F.col("type") == kind)


def search_analyses(analyses: DataFrame, query: str | None = None, status: str | None = None,
                    live: bool | None = None) -> DataFrame:
    out = analyses
    if query:
        like = f"%{query}%"
        out = out.where(F.col("analysis_name").ilike(like) | F.col("filename").ilike(like))
    if status:
        out = out.where(F.col("status") == status)
    if live is True:
        out = out.where(F.col("source") == "live")
    elif live is False:
        out = out.where(F.col("source").isNull() | (F.col("source") != "live"))
    return out


def context_findings(findings: DataFrame, n: int = 20) -> DataFrame:
    return top(findings.where(~F.col("is_false_positive")), "severity_score", "finding_id", n)


def context_flows(flows: DataFrame, n: int = 25) -> DataFrame:
    return flows.orderBy(F.desc("anomaly_score"), F.desc("severity_score"), F.asc("flow_id")).limit(n)


def context_observables(observables: DataFrame, n: int = 40) -> DataFrame:
    return observables.orderBy(F.desc("is_malicious"), F.desc("confidence"), "type", "value").limit(n)


def context_bundle(findings: DataFrame, flows: DataFrame, observables: DataFrame, budget: int | None = None) -> DataFrame:
    """One row of three JSON lists, each from a top list of fixed size; a ``budget`` leaves out whole entries beyond so many characters."""
    def block(df: DataFrame, name: str) -> DataFrame:
        entries = df.agg(F.transform(F.sort_array(F.collect_list(F.struct(*df.columns))), lambda e: F.to_json(e)).alias("entries"))
        if budget is None:
            return entries.select(F.concat(F.lit("["), F.array_join("entries", ","), F.lit("]")).alias(name))
        start = F.struct(F.lit(1).alias("size"), F.array().cast("array<string>").alias("kept"))

        def add(state, entry):
            size = state["size"] + F.length(entry) + 1
            fits = size <= budget
            return F.struct(size.alias("size"), F.when(fits, F.array_append(state["kept"], entry)).otherwise(state["kept"]).alias("kept"))

        kept = F.aggregate("entries", start, add, lambda s: s["kept"])
        return entries.select(F.concat(F.lit("["), F.array_join(kept, ","), F.lit("]")).alias(name))

    return block(context_findings(findings), "findings").crossJoin(
        block(context_flows(flows), "flows")).crossJoin(block(context_observables(observables), "observables"))


def review_candidates(findings: DataFrame, n: int = 25) -> DataFrame:
    """At least medium, best score first."""
    order = values.severity_order(F.col("severity"))
    return top(findings.where(~F.col("is_false_positive") & (order <= 2)), "severity_score", "finding_id", n)


def newest(df: DataFrame, n: int, by: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), F.asc(tie)).limit(n)


def expired(df: DataFrame, keep: int, by: str, tie: str) -> DataFrame:
    """Rows beyond the newest ``keep``: what a retention job would drop.

    The last row kept comes from a top list; all others are compared with it, so nothing is ranked
    globally. Fewer than ``keep`` rows leave nothing to drop.
    """
    last = newest(df.select(by, tie), keep, by, tie).agg(
        F.count(F.lit(1)).alias("_n"), F.min(by).alias("_by"),
        F.max_by(F.col(tie), F.struct(-F.col(by), F.col(tie))).alias("_tie"))
    older = (F.col(by) < F.col("_by")) | ((F.col(by) == F.col("_by")) & (F.col(tie) > F.col("_tie")))
    return df.crossJoin(F.broadcast(last)).where((F.col("_n") == keep) & older).drop("_n", "_by", "_tie")


# ---- exports -------------------------------------------------------------------------------

FLOW_EXPORT = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes_sent", "bytes_recv",
               "duration_ms", "app_layer", "severity"]
EVENT_EXPORT = ["id", "timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "length",
                "info", "severity", "event_type"]


def flow_export(flows: DataFrame) -> DataFrame:
    return flows.withColumnsRenamed({"application_layer": "app_layer", "severity_score": "severity"}).select(*FLOW_EXPORT)


def event_export(events: DataFrame, since_id: int = 0) -> DataFrame:
    return events.where(F.col("id") > since_id).select(*EVENT_EXPORT)


def indicators(findings: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """One indicator object (JSON) per finding that is no false positive.

    The pattern names the flow's real endpoints where the finding has a flow.
    """
    live = findings.where(~F.col("is_false_positive"))
    if flows is not None:
        live = live.join(flows.select("flow_id", "src_ip", "dst_ip"), "flow_id", "left")
        pattern = F.when(F.col("src_ip").isNotNull(), F.concat(
            F.lit("[network-traffic:src_ref.value = '"), "src_ip",
            F.lit("' AND network-traffic:dst_ref.value = '"), "dst_ip", F.lit("']")))
    else:
        pattern = F.lit(None).cast("string")
    body = F.struct(
        F.lit("indicator").alias("type"), F.concat(F.lit("indicator--"), "finding_id").alias("id"),
        F.col("title").alias("name"), F.coalesce(F.col("description"), F.col("title")).alias("description")
        if "description" in findings.columns else F.col("title").alias("description"),
        pattern.alias("pattern"), F.lit("stix").alias("pattern_type"), F.array("severity").alias("labels"))
    return live.select("finding_id", F.to_json(body).alias("indicator"))


def write_bundle(findings: DataFrame, path: str, flows: DataFrame | None = None) -> None:
    """Indicator objects as JSON lines. A bundle is their envelope; it is left to the reader, so the
    objects of a large analysis never have to meet in one row."""
    indicators(findings, flows).select("indicator").write.mode("overwrite").text(path)


def report_document(analysis: DataFrame, flows: DataFrame, findings: DataFrame, observables: DataFrame,
                    risk: DataFrame) -> DataFrame:
    """The report of one analysis as one JSON row, joined from one-row aggregates.

    Charts hold top lists of fixed size; the timeline has one entry per minute of the capture.
    """
    def chart(df: DataFrame, key: str, value: str, name: str, by_key: bool = False) -> DataFrame:
        first = F.col(key) if by_key else -F.col(value)
        items = F.sort_array(F.collect_list(F.struct(first.alias("o"), F.col(key).cast("string").alias("k"),
                                                     F.col(value).alias("v"))))
        return df.agg(F.transform(items, lambda x: F.struct(x["k"].alias("key"), x["v"].alias("value"))).alias(name))

    parts = [
        analysis.select(F.struct(*analysis.columns).alias("analysis")),
        risk.agg(F.coalesce(F.max("risk_score"), F.lit(0.0)).alias("risk_score")),
        flow_metrics(flows).select(F.struct("*").alias("flow_metrics")),
        observable_metrics(observables).select(F.struct("*").alias("observable_metrics")),
        chart(findings_by(findings, "severity"), "severity", "n", "findings_by_severity"),
        chart(protocol_distribution(flows), "name", "n", "protocol_distribution"),
        chart(top_talkers(flows), "src_ip", "bytes", "top_talkers"),
        chart(top_domains(flows), "domain", "n", "dns_top_domains"),
        chart(top_ports(flows), "dst_port", "n", "port_heatmap"),
        chart(traffic_timeline(flows), "minute", "bytes", "traffic_timeline", by_key=True),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out.select(F.to_json(F.struct(*out.columns)).alias("report"))
