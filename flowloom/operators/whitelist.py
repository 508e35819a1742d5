"""Whitelists, suppression reasons and network membership joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom import constants as K
from flowloom.functions import net
from flowloom.functions.text import matches_domain
from flowloom.session import broadcast_if_small, literal_frame

BLOCK_BITS = 16


def flow_hosts() -> Column:
    """Every name a flow mentions: queried names, HTTP hosts and the TLS server name."""
    empty = F.array().cast("array<string>")
    return F.concat(
        F.coalesce(F.col("dns_queries"), empty), F.coalesce(F.col("http_hosts"), empty),
        F.when(F.coalesce(F.col("tls_sni"), F.lit("")) != "", F.array("tls_sni")).otherwise(empty),
    )


def host_whitelisted(hosts: Column, patterns: list[str]) -> Column:
    def any_pattern(host: Column) -> Column:
        hit = F.lit(False)
        for pattern in patterns:
            hit = hit | matches_domain(host, pattern)
        return hit

    return F.exists(hosts, any_pattern) if patterns else F.lit(False)


def port_listed(port: Column, protocol: Column, pairs: list[tuple[int, str]]) -> Column:
    hit = F.lit(False)
    for number, name in pairs:
        hit = hit | ((port == number) & (protocol == name))
    return F.coalesce(hit, F.lit(False))


def mark_whitelisted(flows: DataFrame, cidrs=K.WHITELIST_CIDRS, domains=K.WHITELIST_DOMAINS,
                     ports=K.WHITELIST_PORTS, out: str = "is_whitelisted") -> DataFrame:
    """Flag flows whose destination network, any host name, or (port, protocol) is listed.

    Short lists become literals, so the flag costs no join. For long network lists use
    :func:`mark_networks`.
    """
    numbered = flows.withColumn("_ip", net.ip_number(F.col("dst_ip")))
    flag = (
        net.in_cidrs(F.col("_ip"), cidrs)
        | port_listed(F.col("dst_port"), F.col("protocol"), ports)
        | host_whitelisted(flow_hosts(), domains)
    )
    return numbered.withColumn(out, F.coalesce(flag, F.lit(False))).drop("_ip")


def networks_frame(spark, cidrs: list[str]) -> DataFrame:
    rows = [(c, *net.cidr_bounds(c)) for c in cidrs]
    return literal_frame(spark, rows, "cidr STRING, lo BIGINT, hi BIGINT")


def disjoint_blocks(networks: DataFrame) -> DataFrame:
    """Split networks at /16 borders and keep only the widest of nested ones in each block."""
    size = 1 << BLOCK_BITS
    cut = networks.select(
        "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))).alias("block")
    ).select(
        "block",
        F.greatest("lo", F.col("block") * size).alias("lo"),
        F.least("hi", F.col("block") * size + (size - 1)).alias("hi"),
    ).distinct()
    seen = (Window.partitionBy("block").orderBy(F.col("lo"), F.col("hi").desc())
            .rowsBetween(Window.unboundedPreceding, -1))
    return (cut.withColumn("_covered", F.max("hi").over(seen))
            .where(F.col("_covered").isNull() | (F.col("hi") > F.col("_covered"))).drop("_covered"))


def mark_networks(df: DataFrame, ip: str, networks: DataFrame, out: str = "in_network",
                  max_broadcast: int = 200_000) -> DataFrame:
    """Range join of addresses with a network table (``lo``, ``hi``) as an equi join on /16 blocks.

    An address meets at most one of the disjoint pieces of its block, so no row is repeated.
    """
    pieces = broadcast_if_small(
        disjoint_blocks(networks).withColumnsRenamed({"lo": "_lo", "hi": "_hi", "block": "_block"}),
        max_broadcast)
    num = net.ip_number(F.col(ip))
    left = df.withColumn("_num", num).withColumn(
        "_key", F.shiftright(F.col("_num"), BLOCK_BITS))
    cond = (F.col("_key") == F.col("_block")) & F.col("_num").between(F.col("_lo"), F.col("_hi"))
    return (left.join(pieces, cond, "left").withColumn(out, F.col("_block").isNotNull())
            .drop("_num", "_key", "_block", "_lo", "_hi"))


def mark_cdn(flows: DataFrame, cidrs=K.CDN_CIDRS, ports=K.CDN_PORTS, out: str = "is_cdn") -> DataFrame:
    """Destination inside a CDN range, web ports only."""
    numbered = flows.withColumn("_ip", net.ip_number(F.trim("dst_ip")))
    flag = F.col("dst_port").isin(*ports) & net.in_cidrs(F.col("_ip"), cidrs)
    return numbered.withColumn(out, F.coalesce(flag, F.lit(False))).drop("_ip")


def matching_hosts(hosts: DataFrame, patterns: DataFrame, host: str = "host",
                   max_broadcast: int = 200_000) -> DataFrame:
    """Rows whose host matches a pattern table (``pattern``): an equi semi join on name suffixes.

    A host offers itself and each of its parent suffixes as keys; ``*.suffix`` patterns are keyed
    by the suffix, exact ones by the full name.
    """
    labels = F.split(F.col(host), r"\.")
    n = F.size(labels)
    keys = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(
            F.array_join(F.slice(labels, i, n - i + 1), ".").alias("key"), (i == 1).alias("whole")),
    )
    wild = F.col("pattern").startswith("*.")
    table = patterns.select(
        F.when(wild, F.substr(F.col("pattern"), F.lit(3))).otherwise(F.col("pattern")).alias("key"),
        wild.alias("wild")).distinct()
    table = broadcast_if_small(table.groupBy("key").agg(F.bool_or("wild").alias("wild")), max_broadcast)
    probes = hosts.select(F.col(host), F.explode(keys).alias("k")).select(host, "k.key", "k.whole")
    hits = probes.join(table, "key").where(F.col("wild") | F.col("whole")).select(host).distinct()
    return hosts.join(hits, host, "left_semi")


def suppress_reason(strict: bool = True) -> Column:
    """Why an anomaly alert is not raised; null when it is. Needs ``is_cdn`` and ``is_whitelisted``."""
    listed = F.when(F.col("is_whitelisted"), "whitelisted flow")
    if not strict:
        return listed
    src, dst = F.col("src_ip"), F.col("dst_ip")
    # each address is looked at once, the source only behind an internal destination; LAN services
    # (net.is_lan_service) have internal destinations, so they are named as such
    inside = F.when(net.is_internal_ip(src), "local-only endpoints").otherwise("internal destination")
    return F.when(net.is_internal_ip(dst), inside).otherwise(
        F.coalesce(F.when(F.col("is_cdn"), "known CDN endpoint"), listed))


def with_suppression(flows: DataFrame, strict: bool = True) -> DataFrame:
    """Add ``suppress_reason`` to flows that carry ``is_whitelisted``; the first rule that fits wins."""
    return mark_cdn(flows).withColumn("suppress_reason", suppress_reason(strict)).drop("is_cdn")


def unsuppressed_signatures(alerts: DataFrame, **lists) -> DataFrame:
    """Signature alerts are withheld only by the whitelist."""
    missing = [c for c in ("dns_queries", "http_hosts") if c not in alerts.columns]
    padded = alerts
    for name in missing:
        padded = padded.withColumn(name, F.array().cast("array<string>"))
    if "tls_sni" not in alerts.columns:
        padded, missing = padded.withColumn("tls_sni", F.lit(None).cast("string")), [*missing, "tls_sni"]
    return (mark_whitelisted(padded, **lists).where(~F.col("is_whitelisted"))
            .drop("is_whitelisted", *missing))
