"""The live path: sensor events to alerts, correlations and incidents per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowloom.functions import values
from flowloom.operators import alerts as A
from flowloom.operators import incidents as I
from flowloom.operators import whitelist as W
from flowloom.operators.intel import with_verdict
from flowloom.sources import sensor


def watermarked(stream: DataFrame, ts: str = "time", delay: str = "2 minutes") -> DataFrame:
    """Event time with a bound on lateness; rows later than it are dropped by stateful operators."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def idle_flow_stream(packets: DataFrame, idle_seconds: float = 5, delay: str = "5 seconds") -> DataFrame:
    """Directed flows, each emitted once its idle gap is over, with the columns of the batch form."""
    from flowloom.streaming.idle import stream_idle_flows

    return stream_idle_flows(watermarked(packets, "time", delay), idle_seconds)


def signature_threshold_stream(packets: DataFrame, port: int, count: int, window: str = "60 seconds",
                               delay: str = "60 seconds") -> DataFrame:
    from flowloom.operators.rules import signature_threshold

    return signature_threshold(watermarked(packets, "time", delay), port, count, window)


def live_alerts(events: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float = 5.0,
                session_id: str = "", strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Anomaly alerts, signature alerts and scored flows of one set of sensor events.

    ``score`` adds ``anomaly_score`` to flows with their features, for example a trained forest's.
    """
    flows, hits = sensor.route(events)
    empty = F.array().cast("array<string>")
    named = flows.withColumns({"dns_queries": empty, "http_hosts": empty, "tls_sni": F.lit(None).cast("string")})
    marked = W.with_suppression(W.mark_whitelisted(named), strict)
    scored = score(marked)
    anomalies = A.anomaly_alerts(scored, threshold, session_id)
    kept = W.unsuppressed_signatures(hits).withColumn("ts_us", F.unix_micros("time"))
    return anomalies, A.signature_alerts(kept, session_id), scored


def run_live(spark: SparkSession, events: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
             threshold: float = 5.0, session_id: str = "", trigger: dict | None = None) -> StreamingQuery:
    """Start the live query: per batch, alerts and incident parts are appended under their batch id.

    Paths carry the batch id, so a repeated batch replaces what it wrote. Read the results with
    :func:`read_alerts` and :func:`read_incidents`.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        anomalies, signatures, _ = live_alerts(batch, score, threshold, session_id)
        merged = A.all_alerts(anomalies, signatures)
        merged.write.mode("overwrite").parquet(f"{out}/alerts/batch={batch_id}")
        saved = spark.read.schema(merged.schema).parquet(f"{out}/alerts/batch={batch_id}")
        rows = saved.withColumns({"confidence": F.lit(None).cast("double"), "attack_type": F.lit(None).cast("string"),
                                  "models": F.lit(None).cast("string")})
        I.merge_incidents(I.incident_from_alert(rows)).write.mode("overwrite").parquet(f"{out}/incidents/batch={batch_id}")

    return (events.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "2 seconds"})).start())


def read_alerts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/alerts").drop("batch")


def read_incidents(spark: SparkSession, out: str) -> DataFrame:
    return I.fold_incidents(spark.read.parquet(f"{out}/incidents").drop("batch"))


def enrich_alerts(alerts: DataFrame, providers: DataFrame, allowed=("info", "medium", "high", "critical")) -> DataFrame:
    """Alerts patched with the verdict about their destination (stream-static join).

    ``providers`` holds one row per value. A malicious verdict raises the severity to high when the
    result is an allowed severity.
    """
    verdicts = with_verdict(providers).select(
        F.col("value").alias("_value"), "is_malicious", F.col("confidence").alias("intel_confidence"), "signals")
    joined = alerts.join(verdicts, F.col("dst_ip") == F.col("_value"), "left").drop("_value")
    better = F.when(F.coalesce("is_malicious", F.lit(False)) & (values.merge_rank(F.col("severity")) < 2), "high")
    patched = F.when(better.isin(*allowed), better)
    return joined.withColumn("severity", F.coalesce(patched, F.col("severity")))


def chunk_tables(decoded: DataFrame) -> dict[str, DataFrame]:
    """Flows, names, observables and skipped frames of decoded chunks, each under its chunk's analysis id."""
    from flowloom.operators import flows as FL
    from flowloom.sources import capture

    def of_file(df: DataFrame) -> DataFrame:
        return df.withColumn("analysis_id", F.substring(F.sha2("file", 256), 1, 16))

    packets = capture.ip_packets(decoded.where("skipped IS NULL"))
    return {"flows": of_file(FL.build_flows(packets)), "names": of_file(FL.flow_names(packets)),
            "arp": of_file(capture.arp_events(decoded)), "skipped": of_file(capture.skipped_packets(decoded))}


def analyse_chunks(files: DataFrame, out: str | Callable[[DataFrame, str], None], checkpoint: str,
                   trigger: dict | None = None) -> StreamingQuery:
    """Run the capture analysis on every new chunk file; the analysis id is the hash of its path.

    ``files`` is a binaryFile stream. Chunks of a micro-batch are decoded in ranges and analysed in
    parallel; their tables (:func:`chunk_tables`) are written below ``out``, and an analysis that comes
    again, after a failure or in another run, replaces its own partitions alone, so each is there once.
    Instead of a path a function of the decoded packets, with ``analysis_id``, and the batch id may be given.
    """
    from flowloom.operators.sinks import persist_analyses
    from flowloom.session import stored
    from flowloom.sources import capture

    def process(batch: DataFrame, batch_id: int) -> None:
        decoded = stored(capture.decode_files(batch), "chunks")
        if callable(out):
            packets = decoded.where("skipped IS NULL").drop("skipped")
            out(packets.withColumn("analysis_id", F.substring(F.sha2("file", 256), 1, 16)), str(batch_id))
        else:
            persist_analyses(out, **chunk_tables(decoded))

    return (files.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
