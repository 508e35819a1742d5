"""Detection rules: parameterised aggregations and filters over flows that no whitelist covers.

With ``by`` (an analysis id, say) a rule runs for each value of those columns apart, all in one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom import constants as K
from flowloom.functions import net, text
from flowloom.operators.slices import forward_count, recent_gap

US = 1_000_000


@dataclass(frozen=True)
class Rule:
    rule_id: str
    title: str
    severity: str
    tactic: str
    technique: str
    source: str = "rule"

    @property
    def score(self) -> float:
        return K.SEVERITY_SCORES[self.severity]


# fixed values: rule identities, severities and technique codes
RULES = {r.rule_id: r for r in [
    Rule("PORTSCAN-001", "Port scan — horizontal", "high", "TA0007", "T1046"),
    Rule("PORTSCAN-002", "Port scan — vertical (host sweep)", "high", "TA0007", "T1046"),
    Rule("BEACON-001", "Beaconing — periodic outbound connection", "high", "TA0011", "T1071"),
    Rule("BEACON-002", "Low-and-slow beacon", "high", "TA0011", "T1071"),
    Rule("DNSTUNNEL-001", "DNS tunneling — payload size", "medium", "TA0011", "T1071.004"),
    Rule("DNSTUNNEL-002", "DNS tunneling — query frequency", "medium", "TA0010", "T1048.003"),
    Rule("DNSTUNNEL-003", "High entropy DNS labels", "medium", "TA0011", "T1071.004"),
    Rule("LATERAL-001", "SMB/RDP lateral movement", "high", "TA0008", "T1021"),
    Rule("ARPSPOOFING-001", "ARP cache poisoning", "critical", "TA0006", "T1557"),
    Rule("ARPSPOOFING-002", "ARP reply storm", "high", "TA0006", "T1557"),
    Rule("EXFIL-001", "Large outbound data spike", "high", "TA0010", "T1041"),
    Rule("PORTMISMATCH-001", "Protocol on wrong port", "medium", "TA0011", "T1571"),
    Rule("DGATOP-001", "DGA-like domain", "medium", "TA0011", "T1568"),
    Rule("TLSNONSNI-001", "TLS without SNI", "low", "TA0011", "T1573"),
    Rule("CLEARTEXT-001", "Credentials in cleartext", "high", "TA0006", "T1552"),
    Rule("NEWDOMAIN-001", "Newly registered domain", "medium", "TA0011", "T1568.002"),
    Rule("LONGCONN-001", "Abnormally long connection", "high", "TA0011", "T1095"),
    Rule("ML-ANOMALY-001", "Anomaly — outlier flow to external host", "medium", "TA0011", "T1071", "ml"),
]}


def _start_us() -> Column:
    return F.unix_micros("start_time")


def _span_s() -> Column:
    return (F.max(_start_us()) - F.min(_start_us())) / US


def _services(flows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Flows added up per source, host and port: what the scans count over, in one exchange for both."""
    return flows.groupBy(*by, "src_ip", "dst_ip", "dst_port").agg(
        F.count(F.lit(1)).alias("_n"), F.min(_start_us()).alias("_first"), F.max(_start_us()).alias("_last"),
        F.min("flow_id").alias("flow_id"))


def _services_span_s() -> Column:
    return (F.max("_last") - F.min("_first")) / US


def horizontal_scan(flows: DataFrame, min_ports: int = 50, window_s: float = 30, by: Sequence[str] = ()) -> DataFrame:
    """One source probing many ports of one host; the span of the whole group must fit the window."""
    return (
        _services(flows, by).groupBy(*by, "src_ip", "dst_ip")
        .agg(F.sum("_n").alias("flow_count"), F.count("dst_port").alias("ports_scanned"),
             _services_span_s().alias("span_s"), F.min("flow_id").alias("flow_id"))
        .where((F.col("flow_count") >= min_ports) & (F.col("ports_scanned") >= min_ports)
               & (F.col("span_s") <= window_s))
    )


def host_sweep(flows: DataFrame, min_hosts: int = 30, window_s: float = 60, by: Sequence[str] = ()) -> DataFrame:
    """One source probing one port on many hosts."""
    # every service has flows; asking for their number keeps the exchange equal to the other scan's, so it is reused
    host = F.when(F.col("_n") > 0, F.col("dst_ip"))
    return (
        _services(flows, by).groupBy(*by, "src_ip", "dst_port")
        .agg(F.count(host).alias("hosts_scanned"), _services_span_s().alias("span_s"),
             F.min("flow_id").alias("flow_id"))
        .where((F.col("hosts_scanned") >= min_hosts) & (F.col("span_s") <= window_s))
    )


@dataclass(frozen=True)
class Pace:
    """How regular connections must be to count as a beacon."""

    min_connections: int = 10
    max_jitter_pct: float = 20
    min_interval_s: float = 10
    max_interval_s: float = 3600


SLOW = Pace(5, 20, 1800, 86400)


def paced_connections(flows: DataFrame, paces: dict[str, Pace], by: Sequence[str] = ()) -> DataFrame:
    """Regular connections to one external service, a row per pace (``rule_id``) that they keep.

    Gaps outside a pace's interval bounds are ignored, so a flow only ever needs the previous one within
    the longest ``max_interval_s``; the service's timeline is cut into slices accordingly and sorted once for all paces.
    """
    key = [*by, "src_ip", "dst_ip", "dst_port"]
    outbound = flows.where(~net.internal_of(flows, "dst_ip")).select(*key, "flow_id", _start_us().alias("_us"))
    longest = max(int(p.max_interval_s * US) for p in paces.values())
    gaps = recent_gap(outbound, key, "_us", longest, "_gap", "flow_id").select(*key, "flow_id", "_gap")
    # connections without a start time have no gap but count
    gaps = gaps.unionByName(outbound.where(F.col("_us").isNull()).select(*key, "flow_id", F.lit(None).cast("bigint").alias("_gap")))

    def within(p: Pace) -> Column:
        return F.when(F.col("_gap").between(int(p.min_interval_s * US), int(p.max_interval_s * US)), F.col("_gap") / US)

    measures = {f"_{what}{i}": of(within(p)) for i, p in enumerate(paces.values())
                for what, of in (("gaps", F.count), ("mean", F.avg), ("std", F.stddev_pop))}
    stats = gaps.groupBy(*key).agg(F.count(F.lit(1)).alias("connections"), F.min("flow_id").alias("flow_id"),
                                   *[m.alias(n) for n, m in measures.items()])

    def kept(i: int, rule_id: str, p: Pace) -> Column:
        gaps, mean, cv = F.col(f"_gaps{i}"), F.col(f"_mean{i}"), F.col(f"_std{i}") / F.col(f"_mean{i}")
        regular = ((F.col("connections") >= p.min_connections) & (gaps >= p.min_connections - 1) & (mean > 0)
                   & (cv <= p.max_jitter_pct / 100.0))
        return F.when(regular, F.struct(F.lit(rule_id).alias("rule_id"), gaps.alias("gaps"), F.round(mean, 2).alias("mean_interval_s"),
                                        F.round(cv * 100, 2).alias("jitter_pct")))

    found = F.array(*[kept(i, rule_id, p) for i, (rule_id, p) in enumerate(paces.items())])
    return stats.select(*key, "flow_id", "connections", F.explode(found).alias("p")).where(F.col("p").isNotNull()).select(
        *key, "flow_id", "connections", "p.*")


def beacons(flows: DataFrame, min_connections: int = 10, max_jitter_pct: float = 20,
            min_interval_s: float = 10, max_interval_s: float = 3600, by: Sequence[str] = ()) -> DataFrame:
    """Regular connections to one external service, see :func:`paced_connections`."""
    pace = Pace(min_connections, max_jitter_pct, min_interval_s, max_interval_s)
    return paced_connections(flows, {"BEACON-001": pace}, by).drop("rule_id")


def slow_beacons(flows: DataFrame, min_connections: int = 5, max_jitter_pct: float = 20,
                 min_interval_s: float = 1800, max_interval_s: float = 86400, by: Sequence[str] = ()) -> DataFrame:
    return beacons(flows, min_connections, max_jitter_pct, min_interval_s, max_interval_s, by)


def large_dns(flows: DataFrame, min_payload_bytes: int = 200) -> DataFrame:
    total = F.col("bytes_sent") + F.col("bytes_recv")
    return flows.where((F.col("application_layer") == "DNS") & (total > min_payload_bytes)).select(
        "flow_id", total.alias("payload_bytes"))


def queried_names(flows: DataFrame, *columns: str) -> DataFrame:
    return flows.select(*columns, F.explode("dns_queries").alias("domain"))


def dns_rate(flows: DataFrame, queries_per_minute: float = 100, by: Sequence[str] = ()) -> DataFrame:
    """Queries of one source below one apex; the rate's time base is at least one minute."""
    names = queried_names(flows.where(F.col("start_time").isNotNull()), *by, "src_ip", "start_time")
    grouped = names.groupBy(*by, "src_ip", text.apex_domain(F.col("domain")).alias("apex")).agg(
        F.count(F.lit(1)).alias("queries"), _span_s().alias("_span"))
    rate = F.col("queries") / F.greatest(F.lit(1.0), F.col("_span") / 60)
    return grouped.where((F.col("queries") >= queries_per_minute) & (rate >= queries_per_minute)).select(
        *by, "src_ip", "apex", "queries", F.round(rate, 1).alias("queries_per_minute"))


def lateral_targets(flows: DataFrame, ports=(445, 3389, 5985), by: Sequence[str] = ()) -> DataFrame:
    """The distinct internal (source, target, port) triples on remote-service ports: a finding's targets, by src_ip."""
    return flows.where(
        F.col("dst_port").isin(*ports) & net.internal_of(flows, "dst_ip")
        & net.internal_of(flows, "src_ip")).select(*by, "src_ip", "dst_ip", "dst_port").distinct()


def lateral_movement(flows: DataFrame, ports=(445, 3389, 5985), min_targets: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Sources that reach many hosts; ``ports`` lists those used, the hosts are in :func:`lateral_targets`."""
    return (lateral_targets(flows, ports, by).groupBy(*by, "src_ip")
            .agg(F.count_distinct("dst_ip").alias("targets"), F.array_sort(F.collect_set("dst_port")).alias("ports"))
            .where(F.col("targets") >= min_targets))


def entropic_labels(flows: DataFrame, min_entropy: float = 3.8, by: Sequence[str] = ()) -> DataFrame:
    """Queried names with more than two labels whose first label looks random."""
    names = queried_names(flows, *by, "flow_id").where(text.label_count(F.col("domain")) > 2)
    scored = names.withColumn("entropy", text.shannon_entropy(text.first_label(F.col("domain"))))
    return scored.where(F.col("entropy") >= min_entropy).withColumn("entropy", F.round("entropy", 2))


def arp_requests(arp: DataFrame, limit: int | None = None) -> DataFrame:
    """The requests of the capture, all or the first ``limit``."""
    requests = arp.where(F.col("op") == 1)
    return requests if limit is None else requests.orderBy("ts", "sender_mac").limit(limit)


def arp_storm(arp: DataFrame, min_replies: int = 50, window_s: float = 10, by: Sequence[str] = ()) -> DataFrame:
    """Per sender the first reply that starts a window with enough replies."""
    replies = arp.where(F.col("op") == 2).select(
        *by, "sender_mac", (F.col("ts") * US).cast("bigint").alias("_us"), "ts")
    counted = forward_count(replies, [*by, "sender_mac"], "_us", int(window_s * US), "reply_count")
    return (counted.where(F.col("reply_count") >= min_replies).groupBy(*by, "sender_mac")
            .agg(F.min("ts").alias("window_start"), F.min_by("reply_count", "ts").alias("reply_count")))


def exfiltration(flows: DataFrame, multiplier: float = 10, by: Sequence[str] = ()) -> DataFrame:
    """Outbound volume far above the mean of all positive ones, from inside to outside."""
    means = flows.where(F.col("bytes_sent") > 0).groupBy(*by).agg(F.avg("bytes_sent").alias("_mean"))
    outbound = ~net.internal_of(flows, "dst_ip") & net.internal_of(flows, "src_ip")
    # without ``by`` the means are one row by construction
    met = flows.join(means, list(by)) if by else flows.crossJoin(F.broadcast(means))
    return (
        # one condition over both sides, so that addresses are only parsed of flows with the volume
        met.where(F.when(F.col("bytes_sent") > F.col("_mean") * multiplier, outbound))
        .select(*by, "flow_id", "dst_ip", "bytes_sent", F.round("_mean", 0).alias("baseline_mean"))
    )


def _mismatch() -> Column:
    app, port = F.col("application_layer"), F.col("dst_port")
    return (
        ((app == "SSH") & (port != 22)) | ((app == "HTTP") & ~port.isin(80, 443, 8080, 8000))
        | ((app == "DNS") & (port != 53))
    )


def port_mismatch(flows: DataFrame) -> DataFrame:
    return flows.where(_mismatch()).select("flow_id", "application_layer", "dst_port")


def generated_domains(flows: DataFrame, min_cv_ratio: float = 3, min_bigram_entropy: float = 4.2,
                      by: Sequence[str] = ()) -> DataFrame:
    names = queried_names(flows, *by, "flow_id")
    label = text.first_label(F.col("domain"))
    scored = names.withColumn("cv_ratio", text.consonant_vowel_ratio(label)).withColumn(
        "bigram_entropy", text.bigram_entropy(label))
    return scored.where(
        (F.col("cv_ratio") > min_cv_ratio) | (F.col("bigram_entropy") > min_bigram_entropy)
    ).select(*by, "flow_id", "domain", F.round("cv_ratio", 2).alias("cv_ratio"),
             F.round("bigram_entropy", 2).alias("bigram_entropy"))


def _tls_without_name(flows: DataFrame) -> Column:
    return (F.col("application_layer") == "TLS") & (F.coalesce("tls_sni", F.lit("")) == "") \
        & ~net.internal_of(flows, "dst_ip")


def tls_without_sni(flows: DataFrame) -> DataFrame:
    return flows.where(_tls_without_name(flows)).select("flow_id", "dst_ip", "dst_port")


def _cleartext_login() -> Column:
    login = F.exists("http_hosts", lambda h: F.lower(h).contains("login") | F.lower(h).contains("auth"))
    return (F.col("application_layer") == "HTTP") & (F.col("dst_port") != 443) & F.coalesce(login, F.lit(False))


def cleartext_logins(flows: DataFrame) -> DataFrame:
    return flows.where(_cleartext_login()).select("flow_id", "dst_port", "http_hosts")


def new_domains(observables: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Domain observables that the registry data call newly registered, with the date where it is known."""
    dated = F.col("creation_date") if "creation_date" in observables.columns else F.lit(None).cast("string")
    return observables.where((F.col("type") == "domain") & F.col("newly_registered")).select(
        *by, F.col("value").alias("domain"), dated.alias("creation_date"))


def long_connections(flows: DataFrame, min_hours: float = 8) -> DataFrame:
    return flows.where((F.col("protocol") == "TCP") & (F.col("duration_ms") >= int(min_hours * 3_600_000))).select(
        "flow_id", "dst_ip", F.round(F.col("duration_ms") / 3_600_000, 2).alias("duration_hours"))


def signature_threshold(packets: DataFrame, port: int, count: int, window: str = "60 seconds") -> DataFrame:
    """Connection attempts to ``port`` per source and fixed window, reported once per window.

    Works on a batch or (with a watermark on ``time``) on a stream.
    """
    return (
        packets.where((F.col("protocol") == "TCP") & (F.col("dst_port") == port)
                      & (F.col("tcp_flags").bitwiseAND(0x02) != 0))
        .groupBy(F.window("time", window).alias("w"), "src_ip")
        .agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= count)
        .select(F.col("w.start").alias("window_start"), "src_ip", "hits")
    )


def anomaly_findings(scored: DataFrame, threshold: float = 5.0) -> DataFrame:
    """Flagged flows with no reason to suppress them."""
    return scored.where((F.col("anomaly_score") >= threshold) & F.col("suppress_reason").isNull())


def single_flow_hits(flows: DataFrame, min_payload_bytes: int = 200, min_hours: float = 8, by: Sequence[str] = ()) -> DataFrame:
    """All rules that look at one flow at a time, in a single pass: one row per (flow, rule)."""
    total = F.col("bytes_sent") + F.col("bytes_recv")
    rules = {
        "DNSTUNNEL-001": ((F.col("application_layer") == "DNS") & (total > min_payload_bytes),
                          [F.col("dns_queries"), total.alias("payload_bytes")]),
        "PORTMISMATCH-001": (_mismatch(), [F.col("application_layer").alias("app"), F.col("dst_port").alias("port")]),
        "TLSNONSNI-001": (_tls_without_name(flows), [F.col("dst_ip"), F.col("dst_port")]),
        "CLEARTEXT-001": (_cleartext_login(), [F.col("http_hosts").alias("hosts"), F.col("dst_port").alias("port")]),
        "LONGCONN-001": ((F.col("protocol") == "TCP") & (F.col("duration_ms") >= int(min_hours * 3_600_000)),
                         [F.round(F.col("duration_ms") / 3_600_000, 2).alias("duration_hours"), F.col("dst_ip")]),
    }
    hits = F.array(*[F.when(cond, rule_id) for rule_id, (cond, _) in rules.items()])
    # the evidence is told of the hits, not of every flow
    evidence = F.coalesce(*[F.when(F.col("_rule") == rule_id, F.to_json(F.struct(*told))) for rule_id, (_, told) in rules.items()])
    return flows.withColumn("_hits", hits).select("*", F.explode("_hits").alias("_rule")).where(F.col("_rule").isNotNull()).select(
        *by, "flow_id", F.col("_rule").alias("rule_id"), evidence.alias("evidence"))
