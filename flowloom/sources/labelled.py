"""The labelled flow dataset and training-run documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom import constants as K
from flowloom.schemas import column_of, find_column


def with_label(df: DataFrame) -> DataFrame:
    """Add the trimmed ``Label`` column, whatever the label column is called."""
    found = find_column(df, K.LABEL_COLUMNS)
    if found is None:
        raise ValueError(f"no label column among {K.LABEL_COLUMNS}")
    return df.withColumn("Label", F.trim(column_of(found).cast("string")))


def wanted_columns(df: DataFrame, feature_set: str = "full") -> list[str]:
    """The columns a feature set needs, as the file spells them; the rest is never read."""
    aliases = K.FULL_FEATURE_COLUMNS if feature_set == "full" else K.COMPACT_SOURCE_COLUMNS
    found = [find_column(df, names) for names in [*aliases.values(), *([n] for n in K.LABEL_COLUMNS)]]
    return list(dict.fromkeys(c for c in found if c))


def read_labelled(spark: SparkSession, path: str, feature_set: str = "full", fmt: str = "parquet",
                  **options) -> DataFrame:
    """Labelled flows from parquet or CSV with only the needed columns."""
    reader = spark.read.options(**({"header": "true"} if fmt == "csv" else {}), **options)
    raw = reader.format(fmt).load(path)
    return with_label(raw.select(*[column_of(c) for c in wanted_columns(raw, feature_set)]))


def on_day(df: DataFrame, ts: str, day: str) -> DataFrame:
    """Rows of one calendar day, as a range so that file statistics can skip row groups."""
    start = F.lit(day).cast(df.schema[ts].dataType)
    end = F.date_add(F.lit(day).cast("date"), 1).cast(df.schema[ts].dataType)
    return df.where((F.col(ts) >= start) & (F.col(ts) < end))


RUN_SCHEMA = ("run_id STRING, started_at STRING, status STRING, "
              "phases ARRAY<STRUCT<name: STRING, status: STRING, metrics: MAP<STRING, STRING>>>")


def documents_of_runs(runs: DataFrame) -> DataFrame:
    """Run documents (``RUN_SCHEMA``) as rows with the metrics of their verification phase."""
    verify = F.get(F.filter("phases", lambda p: p["name"].contains("verif")), F.lit(0))
    metric = {m: F.try_element_at(verify["metrics"], F.lit(m)).cast("double").alias(m)
              for m in ("accuracy", "precision", "recall", "f1")}
    return runs.select("run_id", "started_at", "status", *metric.values())


def all_training_runs(spark: SparkSession, path: str) -> DataFrame:
    """All training-run documents, one a file, newest first, with the metrics of their verification phase."""
    runs = spark.read.option("multiLine", "true").schema(RUN_SCHEMA).json(path)
    return documents_of_runs(runs).orderBy(F.desc("started_at"), F.asc("run_id"))


def training_runs(spark: SparkSession, path: str, newest: int = 10) -> DataFrame:
    """The list of the ``newest`` training runs; :func:`all_training_runs` reads every one."""
    return all_training_runs(spark, path).limit(newest)
