"""Writes: per-analysis tables, daily logs, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def persist_analysis(path: str, analysis_id: str, **tables: DataFrame) -> None:
    """Write flows, observables and findings below ``analysis_id=…``.

    Ids are deterministic and only the analysis' own partition is replaced, so a repeated run leaves
    the same rows.
    """
    persist_analyses(path, **{name: df.withColumn("analysis_id", F.lit(analysis_id)) for name, df in tables.items()})


#: Analyses that a task writes side by side, and the bytes each may buffer; beyond it rows are sorted by analysis.
OPEN_ANALYSES, BUFFER_BYTES = 48, 8 << 20
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def persist_analyses(path: str, **tables: DataFrame) -> None:
    """Write tables that carry their ``analysis_id``, all analyses in one partitioned write each.

    Only the partitions of analyses that have rows are replaced. Rows are not sorted by analysis first,
    which would spill a large table: a task keeps a file open for each of its analyses.
    """
    for name, df in tables.items():
        conf = df.sparkSession.conf
        before = conf.get(_WRITERS, None)
        conf.set(_WRITERS, str(OPEN_ANALYSES))
        try:
            (df.write.mode("overwrite").option("parquet.block.size", BUFFER_BYTES)
             .option("partitionOverwriteMode", "dynamic").partitionBy("analysis_id").parquet(f"{path}/{name}"))
        finally:
            conf.unset(_WRITERS) if before is None else conf.set(_WRITERS, before)


def write_daily_json(stream: DataFrame, path: str, checkpoint: str, ts: str = "time",
                     trigger: dict | None = None) -> StreamingQuery:
    """Append-only JSON lines, one folder per UTC day."""
    dated = stream.withColumn("date", F.date_format(F.col(ts), "yyyyMMdd"))
    return (dated.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
            .partitionBy("date").trigger(**(trigger or {"availableNow": True})).start())


def write_export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", "true").csv(path) if fmt == "csv" else writer.json(path))
