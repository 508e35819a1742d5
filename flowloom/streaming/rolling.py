"""Rolling operators on streams.

A micro-batch is answered by the same DataFrame operator as a batch: the new rows together with the
recent rows that their windows reach back to. What has to be remembered of a batch is written once, cut
into time slices, and never again; a later batch reads only the slices in its reach, and slices out of
every reach are deleted. So what a batch writes follows the batch, not the window. A repeated batch reads
what earlier batches left and overwrites its own part. A source with most of the traffic is cut into
slices as in a batch, instead of being one key's state in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


SLICES_IN_SPAN = 4


def _folder(spark: SparkSession, path: str):
    """Hadoop's file system and path object, for the few things Spark has no reader or writer for."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _folder(spark, path)
    return system.exists(where)


class Context:
    """Recent rows on shared storage, in ``slice=<time slice>/batch=<batch>``, written once."""

    def __init__(self, path: str, ts: str, span: int):
        self.path, self.ts, self.span, self.width = path, ts, span, max(1, span // SLICES_IN_SPAN)

    def recall(self, spark: SparkSession, schema, low: int, batch_id: int) -> DataFrame | None:
        """Rows of earlier batches from ``low`` on; other slices are not read."""
        if not exists(spark, self.path):
            return None
        kept = spark.read.schema(f"{_ddl(schema)}, slice BIGINT, batch BIGINT").parquet(self.path)
        return kept.where((F.col("slice") >= low // self.width) & (F.col("batch") < batch_id) & (F.col(self.ts) >= low)).drop("slice", "batch")

    def remember(self, rows: DataFrame, batch_id: int) -> None:
        """Append a batch's rows; the same batch again replaces its own."""
        (rows.withColumns({"slice": F.floor(F.col(self.ts) / self.width).cast("bigint"), "batch": F.lit(batch_id).cast("bigint")})
         .write.partitionBy("slice", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path))

    def expire(self, spark: SparkSession, before: int) -> None:
        """Delete the slices that end before a time."""
        system, where = _folder(spark, self.path)
        if not system.exists(where):
            return
        for entry in system.listStatus(where):
            name = entry.getPath().getName()
            if name.startswith("slice=") and name[6:].lstrip("-").isdigit() and (int(name[6:]) + 1) * self.width <= before:
                system.delete(entry.getPath(), True)


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


@dataclass
class Rolling:
    """``operator`` gets the rows with a flag ``fresh`` and returns rows that still carry it.

    ``keep`` says what to remember of a batch, from its own rows and its result (all its rows without
    ``keep``); ``memo`` names a text column that remembered rows carry and fresh rows have as null.
    ``columns`` are those that remembered rows need; their other columns come back as null.
    """

    operator: Callable[[DataFrame], DataFrame]
    ts: str
    span: int
    out: str
    context: str
    keep: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    memo: str | None = None
    columns: list[str] | None = None

    def process(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Answer one micro-batch; gives what was written of it."""
        spark = batch.sparkSession
        if self.memo:
            batch = batch.withColumn(self.memo, F.lit(None).cast("string"))
        batch = batch.persist()  # read by its bounds, the operator and the memory of recent rows
        context = Context(self.context, self.ts, self.span)
        first, newest = batch.agg(F.min(self.ts), F.max(self.ts)).first()
        rows = batch.withColumn("fresh", F.lit(True))
        if first is not None:
            held = batch.select(*(self.columns or batch.columns)).schema
            earlier = context.recall(spark, held, first - self.span, batch_id)
            if earlier is not None:
                rows = rows.unionByName(earlier.withColumn("fresh", F.lit(False)), allowMissingColumns=True)
        result = self.operator(rows).where("fresh").drop("fresh")
        target = f"{self.out}/batch={batch_id}"
        result.write.mode("overwrite").parquet(target)
        passed = spark.read.schema(result.schema).parquet(target)
        if first is not None:
            recent = (self.keep(batch, passed) if self.keep else batch).select(*(self.columns or batch.columns))
            context.remember(recent.where(F.col(self.ts) >= newest - 2 * self.span), batch_id)
            context.expire(spark, newest - 2 * self.span)
        batch.unpersist()
        return passed

    def start(self, stream: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        return (stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True})).start())


def rolling_entropy_stream(out: str, context: str, span_us: int = 300_000_000) -> Rolling:
    """Per-source port entropy over the trailing span."""
    from flowloom.operators.heuristics import rolling_port_entropy

    return Rolling(lambda rows: rolling_port_entropy(rows, span_us), "ts_us", span_us, out, context)


def triage_stream(out: str, context: str, span_us: int = 60_000_000, tie: str = "seq", **limits) -> Rolling:
    """Burst heuristics with their precedence; remembered rows keep the rule that answered them."""
    from flowloom.operators.heuristics import triage

    def judge(rows: DataFrame) -> DataFrame:
        marked = rows.withColumn("_settled", ~F.col("fresh"))
        return triage(marked, span_us, tie=tie, settled="_settled", **limits).drop("_settled", "known_rule")

    def remember(rows: DataFrame, passed: DataFrame) -> DataFrame:
        return rows.drop("known_rule").join(passed.select(tie, F.col("rule").alias("known_rule")), tie, "left").select(*rows.columns)

    return Rolling(judge, "ts_us", span_us, out, context, keep=remember, memo="known_rule")


def rate_limit_stream(out: str, context: str, session: str, limit: int, window_us: int = 60_000_000, tie: str = "id") -> Rolling:
    """Greedy alert limit; the context holds the alerts admitted in the last window."""
    from flowloom.operators.alerts import greedy_cap

    def admit(rows: DataFrame) -> DataFrame:
        marked = rows.withColumn("_passed", ~F.col("fresh"))
        return greedy_cap(marked, session, "ts_us", limit, window_us, tie, admitted="_passed")

    def admitted(rows: DataFrame, passed: DataFrame) -> DataFrame:
        return passed.select(*rows.columns)

    return Rolling(admit, "ts_us", window_us, out, context, keep=admitted)


def correlation_stream(out: str, context: str, window_us: int = 120_000_000) -> Rolling:
    """Signature hits and flagged flows (column ``feed``: ``signature`` or ``anomaly``) of one pair.

    Each new event looks up its oldest partner; a pair is reported once per window.
    """
    from flowloom.operators.correlate import correlate

    def match(rows: DataFrame) -> DataFrame:
        sig = rows.where("feed = 'signature'")
        ano = rows.where("feed = 'anomaly'").withColumn("flagged", F.lit(True))
        fresh = rows.where("fresh").agg(F.min("ts_us").alias("_from"))
        return (correlate(sig, ano, window_us).crossJoin(F.broadcast(fresh))  # one row
                .withColumn("fresh", F.col("ts_us") >= F.col("_from")).drop("_from"))

    return Rolling(match, "ts_us", 2 * window_us, out, context)
