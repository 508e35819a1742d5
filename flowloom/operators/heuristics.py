"""Burst heuristics over rolling windows and their precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom import constants as K
from flowloom.functions.text import contains_any
from flowloom.operators.slices import rolling_count, rolling_distinct

WINDOW_US = 60_000_000


def _info() -> Column:
    return F.lower(F.coalesce("info", F.lit("")))


def is_ssh_event() -> Column:
    return (F.col("dst_port") == 22) | _info().contains("ssh") | _info().contains(":22")


def brute_label(port: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for number, (label, _) in K.BRUTE_PORTS.items():
        out = out.when(port == number, label)
    return out


def brute_indicator(port: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for number, (_, indicator) in K.BRUTE_PORTS.items():
        out = out.when(port == number, indicator)
    return out


def ssh_bursts(events: DataFrame, min_events: int = 8, window_us: int = WINDOW_US, ts: str = "ts_us",
               tie: str = "seq") -> DataFrame:
    """Events that complete a burst toward the remote shell, with the count so far."""
    counted = rolling_count(events.where(is_ssh_event()), "src_ip", ts, window_us, "n", tie)
    return counted.where(F.col("n") >= min_events).withColumn(
        "confidence", F.round(F.least(F.lit(0.95), 0.5 + F.col("n") * 0.04), 2))


def auth_bursts(events: DataFrame, min_events: int = 10, window_us: int = WINDOW_US, ts: str = "ts_us",
                tie: str = "seq", ports=tuple(K.BRUTE_PORTS)) -> DataFrame:
    counted = rolling_count(events.where(F.col("dst_port").isin(*ports)), ["src_ip", "dst_port"], ts, window_us,
                            "n", tie)
    return counted.where(F.col("n") >= min_events).withColumn(
        "confidence", F.round(F.least(F.lit(0.92), 0.45 + F.col("n") * 0.04), 2))


def port_diversity(events: DataFrame, min_ports: int = 15, window_us: int = WINDOW_US, ts: str = "ts_us",
                   tie: str = "seq") -> DataFrame:
    tcp = events.where((F.upper(F.coalesce("protocol", F.lit("TCP"))) == "TCP") & (F.col("dst_port") > 0))
    counted = rolling_distinct(tcp, "src_ip", ts, "dst_port", window_us, "n", tie)
    return counted.where(F.col("n") >= min_ports).withColumn(
        "confidence", F.round(F.least(F.lit(0.9), 0.4 + F.col("n") * 0.03), 2))


def keyword_hit() -> Column:
    """Free-text hit: ``scan`` first, then a brute-force tool on an authentication port."""
    return F.when(contains_any(F.col("info"), K.SCAN_KEYWORDS), "scan").when(
        F.col("dst_port").isin(*K.BRUTE_PORTS) & contains_any(F.col("info"), K.BRUTE_KEYWORDS), "brute")


def triage(events: DataFrame, window_us: int = WINDOW_US, min_ssh: int = 8, min_auth: int = 10,
           min_ports: int = 15, ts: str = "ts_us", tie: str = "seq", settled: str | None = None) -> DataFrame:
    """All heuristics in their order of precedence, one hit per event at most; ``rule`` names it.

    A counter only sees the events that no earlier check answered. The three rolling passes run one
    after the other over all rows; in each, only the rows still open feed the window.

    ``settled`` names a flag of rows judged before (the recent rows of a stream): their ``rule`` is
    in ``known_rule`` and is taken over instead of being worked out from a shortened past.
    """
    rows = events.where((F.coalesce("src_ip", F.lit("")) != "") & (F.coalesce("dst_ip", F.lit("")) != ""))
    port = F.col("dst_port")
    judged: list[str] = []

    def or_known(hit: Column, *names: str) -> Column:
        judged.extend(names)
        if settled is None:
            return hit
        return F.when(F.col(settled), F.when(F.col("known_rule").isin(*judged), F.col("known_rule"))).otherwise(hit)

    step = rows.withColumn("_hit", or_known(keyword_hit(), "scan", "brute"))

    def passed(counted: DataFrame, feeds: Column, minimum: int, name: str) -> DataFrame:
        fresh = F.when(F.col("_hit").isNull() & feeds & (F.col(f"_{name}") >= minimum), name).otherwise(F.col("_hit"))
        return counted.withColumn("_hit", or_known(fresh, name))

    ssh_feed = F.col("_hit").isNull() & F.coalesce(is_ssh_event(), F.lit(False))
    step = passed(rolling_count(step, "src_ip", ts, window_us, "_ssh", tie, feeds=ssh_feed),
                  F.coalesce(is_ssh_event(), F.lit(False)), min_ssh, "ssh")
    on_auth = F.coalesce(port.isin(*K.BRUTE_PORTS), F.lit(False))
    step = passed(rolling_count(step, ["src_ip", "dst_port"], ts, window_us, "_auth", tie,
                                feeds=F.col("_hit").isNull() & on_auth), on_auth, min_auth, "auth")
    tcp = F.coalesce((F.upper(F.coalesce("protocol", F.lit("TCP"))) == "TCP") & (port > 0), F.lit(False))
    step = passed(rolling_distinct(step, "src_ip", ts, "dst_port", window_us, "_ports", tie,
                                   feeds=F.col("_hit").isNull() & tcp), tcp, min_ports, "ports")

    hit = F.col("_hit")

    def rate(cap: float, base: float, slope: float, name: str) -> Column:
        return F.round(F.least(F.lit(cap), base + F.col(f"_{name}") * slope), 2)

    def counted(prefix, name: str) -> Column:
        start = prefix if isinstance(prefix, Column) else F.lit(prefix)
        return F.concat(start, F.lit("="), F.col(f"_{name}").cast("string"))

    return step.where(hit.isNotNull()).select(
        *rows.columns, hit.alias("rule"),
        F.when(hit.isin("scan", "ports"), "PortScan").when(hit == "ssh", "SSH-Patator").otherwise(brute_label(port)).alias("attack_type"),
        F.when(hit == "ports", "medium").otherwise("high").alias("severity"),
        F.when(hit == "scan", 0.85).when(hit == "brute", 0.88).when(hit == "ssh", rate(0.95, 0.5, 0.04, "ssh"))
        .when(hit == "auth", rate(0.92, 0.45, 0.04, "auth")).otherwise(rate(0.9, 0.4, 0.03, "ports")).alias("confidence"),
        F.when(hit == "scan", "nmap_scan_signature")
        .when(hit == "brute", F.concat(brute_indicator(port), F.lit(",brute_tool_signature")))
        .when(hit == "ssh", counted("ssh_syn_burst,count", "ssh"))
        .when(hit == "auth", counted(F.concat(brute_indicator(port), F.lit(",burst")), "auth"))
        .otherwise(counted("port_scan_entropy,unique_ports", "ports")).alias("indicators"))


def rolling_port_entropy(events: DataFrame, window_us: int = 300_000_000, ts: str = "ts_us", tie: str = "seq",
                         out: str = "dst_port_entropy") -> DataFrame:
    """Entropy of each source's destination ports over the trailing window, this event included."""
    from flowloom.operators.slices import rolling_entropy

    return rolling_entropy(events, "src_ip", ts, "dst_port", window_us, out, tie)
