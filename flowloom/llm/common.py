"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def arrow_map(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand on the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def text_of(column: str | Column) -> Column:
    """A text; null counts as empty."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def fold_of(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds


def with_row_key(docs: DataFrame, name: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Add a hash of id and text: rows that differ in either are told apart, whatever their ids."""
    return docs.withColumn(name, F.xxhash64(F.col(f"`{id_column}`").cast("string"), text_of(F.col(f"`{text_column}`"))))
