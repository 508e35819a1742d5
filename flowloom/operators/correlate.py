"""Correlation of signature hits with anomalies, and of alerts with attack windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom import constants as K
from flowloom.functions.text import pair_key
from flowloom.operators.slices import first_of_other
from flowloom.session import broadcast_if_small

WINDOW_US = 120_000_000


def correlate(signatures: DataFrame, anomalies: DataFrame, window_us: int = WINDOW_US, once: bool = True,
              width_us: int | None = None) -> DataFrame:
    """Signature hits and flagged flows of one unordered host pair within the window.

    Whichever comes second reports the pair with its oldest partner in the trailing window. Both
    feeds form one timeline per pair, sorted once, and every event makes a single look-up in it, so a pair with
    many events of both kinds never yields their product. With ``once`` the first report of a pair
    in each fixed window of the same length is kept.

    ``signatures`` needs ``ts_us, src_ip, dst_ip, signature`` and may have ``signature_id, category``;
    ``anomalies`` needs ``ts_us, src_ip, dst_ip, flow_id, anomaly_score, flagged`` and may have
    ``explanation``; ports and protocol are carried from either.
    """
    rule, flow = {"signature": "string", "signature_id": "string", "category": "string"}, {
        "flow_id": "bigint", "anomaly_score": "double", "explanation": "string"}
    ends = {"src_ip": "string", "dst_ip": "string", "src_port": "int", "dst_port": "int", "protocol": "string"}
    held = {**rule, **flow, **ends}

    def side(df: DataFrame, own: dict, is_sig: bool) -> DataFrame:
        values = [(F.col(n) if n in {**own, **ends} and n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in held.items()]
        return df.select(pair_key(F.col("src_ip"), F.col("dst_ip")).alias("pair"), F.col("ts_us"), F.lit(is_sig).alias("is_sig"), *values)

    timeline = side(signatures, rule, True).unionByName(side(anomalies.where("flagged"), flow, False))
    payload = F.struct("ts_us", *held)

    def pick(name: str, side: Column) -> Column:
        return F.when(side, F.col(name)).otherwise(F.col(f"partner.{name}")).alias(name)

    found = first_of_other(timeline, "pair", "ts_us", window_us, "is_sig", payload, "partner", width_us)
    sig = F.col("is_sig")
    # the flow names the ends; ports and protocol that it lacks come from the signature hit
    shown = [F.coalesce(pick(n, ~sig), pick(n, sig)).alias(n) for n in ends]
    out = found.select("pair", "ts_us", F.col("partner.ts_us").alias("partner_ts_us"),
                       *[pick(n, sig) for n in rule], *[pick(n, ~sig) for n in flow], *shown)
    if not once:
        return out
    first = out.groupBy("pair", F.floor(F.col("ts_us") / window_us).alias("window")).agg(
        F.min(F.struct("ts_us", "partner_ts_us", *held)).alias("r"))
    return first.select("pair", "r.*")


def pattern_labels(pattern: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in K.LAB_PATTERNS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, pattern), pattern)


def coverage(windows: DataFrame, alerts: DataFrame, slice_us: int = 3_600_000_000,
             max_broadcast: int = 200_000) -> DataFrame:
    """Which attack patterns saw alerts while they ran.

    The range join of alerts with windows (``pattern, start_us, end_us``) is an equi join on time
    slices with the exact bounds behind it; hits are counted per window before patterns are formed.
    Patterns without alerts stay.
    """
    w = windows.withColumn("_w", F.xxhash64("pattern", "start_us", "end_us"))
    cut = w.select("_w", "start_us", "end_us", F.explode(F.sequence(
        F.floor(F.col("start_us") / slice_us), F.floor(F.col("end_us") / slice_us))).alias("_slice"))
    kinds = alerts.where(F.lower("type").isin("ml", "suricata")).select(
        "ts_us", F.lower("type").alias("kind"), F.floor(F.col("ts_us") / slice_us).alias("_slice"))
    inside = (F.col("ts_us") > F.col("start_us")) & (F.col("ts_us") <= F.col("end_us"))
    hits = kinds.join(broadcast_if_small(cut, max_broadcast), "_slice").where(inside).groupBy("_w").agg(
        F.count_if(F.col("kind") == "ml").alias("ml"), F.count_if(F.col("kind") == "suricata").alias("sig"))
    joined = w.join(hits, "_w", "left")
    return joined.groupBy("pattern").agg(
        F.coalesce(F.bool_or(F.col("ml") > 0), F.lit(False)).alias("alerted_ml"),
        F.coalesce(F.bool_or(F.col("sig") > 0), F.lit(False)).alias("alerted_signature"),
        F.lit(True).alias("completed")).withColumn("label", pattern_labels(F.col("pattern")))
