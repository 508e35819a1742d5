"""The live path in one query: sensor events to scored flows, alerts, correlations and incidents.

Per micro-batch: flows get their rolling port entropy, are judged by the whitelist and scored; signature hits
and flagged flows of a host pair are correlated; anomaly, signature and correlation alerts share one greedy
limit; what passes is enriched, becomes incidents and is counted. Entropy, correlation and limit look back at
the batches before through :class:`~flowloom.streaming.rolling.Context`, so the result is that of one batch
over all events (:meth:`LivePath.tables`). Everything is written under the batch's id, and a repeated batch
replaces what it wrote.

Time is when the sensor logged an event. An event of a later batch that was logged before events of an
earlier one still sees them as context, but does not change what they were answered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowloom.operators import alerts as A
from flowloom.operators import incidents as I
from flowloom.operators import whitelist as W
from flowloom.operators.correlate import correlate
from flowloom.operators.heuristics import rolling_port_entropy
from flowloom.session import broadcast_if_small, stored
from flowloom.sources import sensor
from flowloom.streaming import rolling
from flowloom.streaming.live import enrich_alerts

_ENDS = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")
_ENTROPY_NEEDS = ["ts_us", "flow_id", "src_ip", "dst_port"]


@dataclass
class LivePath:
    """``score`` adds ``anomaly_score`` (and perhaps ``explanation``) to flows with ``dst_port_entropy``.

    ``providers`` holds one row of intelligence per address; without it alerts are not enriched. A session
    admits ``limit`` alerts in ``limit_us``; an alert comes before the correlation that it completes.
    """

    score: Callable[[DataFrame], DataFrame]
    threshold: float = 5.0
    session_id: str = ""
    strict: bool = True
    limit: int = 60
    limit_us: int = 60_000_000
    correlation_us: int = 120_000_000
    entropy_us: int = 300_000_000
    providers: DataFrame | None = None
    allowed: tuple[str, ...] = ("info", "medium", "high", "critical")

    # ---- steps shared by the stream and the batch form

    def flows(self, events: DataFrame) -> DataFrame:
        return sensor.to_flows(events).withColumnRenamed("logged_us", "ts_us")

    def hits(self, events: DataFrame) -> DataFrame:
        return sensor.to_alerts(events).withColumn("ts_us", F.unix_micros("time"))

    def judged(self, flows: DataFrame) -> DataFrame:
        """Flows flagged ``fresh``, with entropy, suppression and score; the others are context."""
        empty = F.array().cast("array<string>")
        known = rolling_port_entropy(flows, self.entropy_us, tie="flow_id").where("fresh").drop("fresh")
        named = known.withColumns({"dns_queries": empty, "http_hosts": empty, "tls_sni": F.lit(None).cast("string")})
        scored = self.score(W.with_suppression(W.mark_whitelisted(named), self.strict))
        return scored.drop("dns_queries", "http_hosts", "tls_sni").withColumn("fresh", F.lit(True))

    def feeds(self, scored: DataFrame, hits: DataFrame) -> DataFrame:
        """Both sides of the correlation, suppressed or not, as one timeline."""
        sig = hits.select("ts_us", *_ENDS, "signature", F.col("signature_id").cast("string").alias("signature_id"),
                          "category", F.lit("signature").alias("feed"))
        told = [c for c in ("explanation",) if c in scored.columns]
        ano = scored.where(F.col("anomaly_score") >= self.threshold).select(
            "ts_us", *_ENDS, "flow_id", "anomaly_score", *told, F.lit("anomaly").alias("feed"))
        return sig.unionByName(ano, allowMissingColumns=True)

    def candidates(self, scored: DataFrame, hits: DataFrame, matches: DataFrame) -> DataFrame:
        """All alerts before the limit, with their order within an instant."""
        alerts = A.all_alerts(A.anomaly_alerts(scored, self.threshold, self.session_id, "ts_us"),
                              A.signature_alerts(W.unsuppressed_signatures(hits), self.session_id),
                              A.correlation_alerts(matches, self.session_id))
        late = F.when(F.col("type") == "correlation", "1").otherwise("0")
        return alerts.withColumn("_order", F.concat(late, "id"))

    def enriched(self, admitted: DataFrame) -> DataFrame:
        alerts = admitted.drop("_order")
        if self.providers is None:
            return alerts
        # the limit keeps a batch's alerts few, so the table of providers is filtered where it lies
        wanted = broadcast_if_small(alerts.select(F.col("dst_ip").alias("value")).distinct())
        return enrich_alerts(alerts, self.providers.join(wanted, "value", "left_semi"), self.allowed)

    @staticmethod
    def incidents(alerts: DataFrame) -> DataFrame:
        rows = alerts.withColumns({"confidence": F.lit(None).cast("double"), "attack_type": F.lit(None).cast("string"),
                                   "models": F.lit(None).cast("string")})
        return I.merge_incidents(I.incident_from_alert(rows))

    @staticmethod
    def counts(scored: DataFrame, alerts: DataFrame) -> DataFrame:
        flows = scored.agg(F.lit("flows").alias("what"), F.count(F.lit(1)).alias("n"))
        return flows.unionByName(alerts.groupBy(F.col("type").alias("what")).agg(F.count(F.lit(1)).alias("n")))

    # ---- the two forms

    def tables(self, events: DataFrame) -> dict[str, DataFrame]:
        """Batch form: what the stream has written after all of these events."""
        hits = self.hits(events)
        scored = stored(self.judged(self.flows(events).withColumn("fresh", F.lit(True))).drop("fresh"), "live-scored")
        feeds = self.feeds(scored, hits)
        matches = correlate(feeds.where("feed = 'signature'"), feeds.where("feed = 'anomaly'").withColumn("flagged", F.lit(True)),
                            self.correlation_us)
        admitted = A.greedy_cap(self.candidates(scored, hits, matches), "session_id", "ts_us", self.limit, self.limit_us, "_order")
        alerts = stored(self.enriched(admitted), "live-alerts")
        return {"scored": scored, "alerts": alerts, "incidents": self.incidents(alerts), "counts": self.counts(scored, alerts)}

    def process(self, batch: DataFrame, batch_id: int, out: str) -> None:
        events = sensor.routed(batch).persist()  # read as flows and as hits
        hits = self.hits(events)
        scored = rolling.Rolling(self.judged, "ts_us", self.entropy_us, f"{out}/scored", f"{out}/context/flows",
                                 columns=_ENTROPY_NEEDS).process(self.flows(events), batch_id)
        matches = rolling.correlation_stream(f"{out}/matches", f"{out}/context/feeds", self.correlation_us).process(
            self.feeds(scored, hits), batch_id)
        limit = rolling.rate_limit_stream(f"{out}/admitted", f"{out}/context/admitted", "session_id", self.limit, self.limit_us, "_order")
        limit.columns = ["session_id", "ts_us", "_order"]
        admitted = limit.process(self.candidates(scored, hits, matches), batch_id)
        found = self.enriched(admitted)
        found.write.mode("overwrite").parquet(f"{out}/alerts/batch={batch_id}")
        alerts = batch.sparkSession.read.schema(found.schema).parquet(f"{out}/alerts/batch={batch_id}")
        self.incidents(alerts).write.mode("overwrite").parquet(f"{out}/incidents/batch={batch_id}")
        self.counts(scored, alerts).write.mode("overwrite").parquet(f"{out}/counts/batch={batch_id}")
        events.unpersist()

    def start(self, events: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        return (events.writeStream.foreachBatch(lambda batch, batch_id: self.process(batch, batch_id, out))
                .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "2 seconds"})).start())


def read_counts(spark: SparkSession, out: str) -> DataFrame:
    """The session's counters: flows seen and alerts by type, over all batches."""
    return spark.read.parquet(f"{out}/counts").groupBy("what").agg(F.sum("n").alias("n"))
