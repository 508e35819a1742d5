"""Shards and slots from a Feistel permutation of global row numbers.

Every row gets a number from 0 to n - 1 that depends on the rows alone, not on files or partitions: rows
fall into hash buckets, are ranked inside their bucket, and a bucket's offset is the sum of the counts
before it. A keyed four-round Feistel network over the next power of four permutes the numbers; values
outside the range walk on through the network until they are inside. Position p goes to shard p mod s,
slot p div s, so shards differ by at most one row and slots have no gaps. ``locate`` inverts the way: it
tells which row number is at a shard's slot without reading anything.

Equal rows are counted before anything is shuffled and take consecutive numbers, so no number of repeated
rows makes a large bucket. Bucket counts, 2**20 at most, are what the driver sees.

Edge cases: null texts have no bytes (size 1, crc 0); null ids rank first; an empty table has no rows.
Columns that clash with the result's names are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from flowloom.llm.bytewords import mix
from flowloom.llm.common import text_of
from flowloom.session import ship

ROUNDS = 4
BUCKET_ROWS = 1 << 16
MAX_BUCKETS = 1 << 20
RESULT = ("row_number", "shard", "slot")


def _half_bits(n: int) -> int:
    return max(1, -(-max(1, int(n - 1).bit_length()) // 2))


def _keys(seed: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & (2**63 - 1)))


def _network(x: np.ndarray, half: int, keys: np.ndarray, back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for key in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (mix(left + key) & mask), left
        else:
            left, right = right, left ^ (mix(right + key) & mask)
    return (left << shift) | right


def permute(numbers: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """The position of each row number, or with ``back`` the row number at each position."""
    half, keys = _half_bits(n), _keys(seed)
    x = _network(np.asarray(numbers).astype(np.uint64), half, keys, back)
    out = np.flatnonzero(x >= np.uint64(n))
    while len(out):
        x[out] = _network(x[out], half, keys, back)
        out = out[x[out] >= np.uint64(n)]
    return x.astype(np.int64)


def locate(shard, slot, n: int, shards: int, seed: int = 0) -> np.ndarray:
    """Row numbers at the given shards and slots."""
    return permute(np.asarray(slot, np.int64) * shards + np.asarray(shard, np.int64), n, seed, back=True)


def size_of(text: str) -> Column:
    """UTF-8 bytes of a text plus one for its separator."""
    return F.octet_length(text_of(text)).cast("bigint") + 1


def crc_of(text: str) -> Column:
    return F.crc32(text_of(text).cast("binary"))


def number_rows(rows: DataFrame, id_column: str = "doc_id") -> tuple[DataFrame, int]:
    """``rows`` with their global number as ``row_number``, and how many there are."""
    rows = rows.drop("row_number")
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    n = rows.count()
    buckets = int(min(MAX_BUCKETS, max(16, -(-n // BUCKET_ROWS))))
    bucket = F.pmod(whole, F.lit(buckets)).cast("int")
    counts = np.zeros(buckets, np.int64)
    for at, held in rows.groupBy(bucket.alias("bucket")).count().collect():
        counts[at] = held
    begin = pd.DataFrame({"__bucket": np.arange(buckets, dtype=np.int32), "__begin": np.cumsum(counts) - counts})
    offsets = F.broadcast(rows.sparkSession.createDataFrame(begin, "__bucket int, __begin bigint"))
    names = [F.col(f"`{c}`") for c in rows.columns]
    distinct = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__times")).withColumn("__hash", whole).withColumn("__bucket", bucket)
    ranked = Window.partitionBy("__bucket").orderBy(F.col(f"`{id_column}`"), "__hash")
    before = F.coalesce(F.sum("__times").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = distinct.withColumn("__first", before).join(offsets, "__bucket").withColumn("__first", F.col("__first") + F.col("__begin"))
    each = F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("__times") - 1))
    return placed.select(*names, each.alias("row_number")), n


def shard_rows(rows: DataFrame, shards: int = 8, seed: int = 20240607, id_column: str = "doc_id") -> DataFrame:
    """``rows`` with row_number, shard and slot."""
    ship(rows.sparkSession)
    numbered, n = number_rows(rows.drop(*RESULT), id_column)

    @F.pandas_udf(T.LongType())
    def position(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    placed = numbered.withColumn("__position", position("row_number"))
    return placed.withColumns({
        "shard": F.pmod("__position", F.lit(shards)).cast("int"),
        "slot": F.expr(f"__position div {int(shards)}"),
    }).drop("__position")
