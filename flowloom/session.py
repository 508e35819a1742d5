"""Session defaults and the few places where a job touches shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(app: str = "flowloom", cpus: int | str = "*", **conf) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        **DEFAULTS,
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "8g"),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local run may do without the setting; a temporary folder takes its place then.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getCheckpointDir()
        if named is None:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="flowloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For results that many branches read (scored flows, enriched flows): the table survives lost
    executors, keeps column pruning and file statistics for the readers, and cuts lineage.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Broadcast only after counting: beyond ``max_rows`` the join shuffles as usual.

    The probe stops reading after ``max_rows + 1`` rows.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def spread(df: DataFrame) -> DataFrame:
    """Rebalance an input that has fewer splits than the cluster has cores, before heavy per-row work.

    Large inputs have many splits and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not df.isStreaming and df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(cores)


def literal_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A parameter list as a local relation, so that it costs no job of its own."""
    import pyarrow as pa

    names = [field.strip().split(" ")[0] for field in schema.split(",")]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return spark.createDataFrame(pa.table({n: list(v) for n, v in zip(names, columns)}), schema)


def ship(spark: SparkSession) -> None:
    """Hand this package to the workers, once per application, for functions that run there.

    Spark's file distribution carries it, as ``--py-files`` would; the archive stays on the driver.
    """
    context = spark.sparkContext
    if getattr(context, "_flowloom_shipped", False):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="flowloom-")) / "flowloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in root.rglob("*.py"):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._flowloom_shipped = True
