"""Exact top-k inner products by distributed histogram selection.

Components become integers, floor(1024 x), so scores are exact. Queries are worked off in blocks of bounded
size, each block against all rows. Every pass scores everything: tasks count their scores into histograms
over the current range of each query, the histograms are summed, and the bin that holds a query's k-th score
becomes its next range, until a bin is one score wide. A task leaves out bins below its own k-th score, which
cannot hold the global one. A last pass keeps scores above the k-th value and, of those equal to it, each
task's k smallest ids; the rank by score and id then is deterministic.

What the driver sees is one query block and one bin per query of it.

Edge cases: vectors that are null or hold null or non-finite components take no part, neither do rows
without id. Vectors of different lengths are compared on their common components. Rows with the query's own
id are not its candidates. Repeated query rows give one list; repeated candidate rows each take a place. With
fewer than k candidates all are returned; empty tables give an empty result. Scores beyond 64 bits are held
at the type's limits. Other columns do not matter.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.llm.common import arrow_map
from flowloom.session import shared_dir

SCALE = 1024
QUERY_BLOCK = 512
BINS = 2048
ROWS_AT_ONCE = 1024
LOW, HIGH = -(2**63), 2**63 - 1
RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"


@dataclass(frozen=True)
class Queries:
    ids: np.ndarray
    vectors: np.ndarray
    largest: int


def _whole(ids, lists) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and scaled vectors of the rows that take part, in runs of equal length where possible."""
    import pyarrow as pa

    lists = lists.cast(pa.list_(pa.float64()))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    child = lists.values
    values = child.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])  # nulls read as NaN
    use = (bad[offsets[1:]] == bad[offsets[:-1]]) & ~lists.is_null().to_numpy(zero_copy_only=False)
    use &= ~ids.is_null().to_numpy(zero_copy_only=False)
    kept = np.flatnonzero(use)
    return ids.take(pa.array(kept)).to_numpy().astype(np.int64), [values[offsets[i]:offsets[i + 1]] for i in kept]


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, vector in zip(out, vectors):
        n = min(width, len(vector))
        row[:n] = np.floor(vector[:n] * float(SCALE))
    return out


def _scores(queries: Queries, rows: np.ndarray) -> np.ndarray:
    """(queries, rows) integer inner products, in the cheapest exact arithmetic."""
    width = max(1, queries.vectors.shape[1])
    bound = queries.largest * int(np.abs(rows).max(initial=0.0)) * width
    if bound < 2**53:
        return (queries.vectors.astype(np.float64) @ rows.T).astype(np.int64)
    exact = np.frompyfunc(int, 1, 1)
    wide = np.dot(exact(queries.vectors), exact(rows).T)
    return np.clip(wide, LOW, HIGH).astype(np.int64)


def _scored(batches, queries: Queries):
    """Ids and scores of the batches' rows, some rows at a time."""
    width = queries.vectors.shape[1]
    for batch in batches:
        ids, vectors = _whole(batch.column(0), batch.column(1))
        for at in range(0, len(ids), ROWS_AT_ONCE):
            own = ids[at:at + ROWS_AT_ONCE]
            scores = _scores(queries, _matrix(vectors[at:at + ROWS_AT_ONCE], width))
            yield own, scores, own[None, :] != queries.ids[:, None]


def _select(rows: DataFrame, queries: Queries, low: np.ndarray, span: int, width: int, missing: np.ndarray) -> dict[int, tuple[int, int]]:
    """Per query (number), among the scores from ``low`` to ``low + span``, the bin of its k-th score and the scores above that bin; too few candidates: none."""
    import pyarrow as pa

    shared = rows.sparkSession.sparkContext.broadcast((queries, low, missing))

    def run(batches):
        queries, low, missing = shared.value
        n = len(queries.ids)
        counts = np.zeros(n * BINS, np.int64)
        for _, scores, other in _scored(batches, queries):
            # differences in unsigned arithmetic cannot overflow
            beyond = scores.view(np.uint64) - low.view(np.uint64)[:, None]
            hit = other & (scores >= low[:, None]) & (beyond < np.uint64(span))
            place = beyond // np.uint64(width)
            query, _ = np.nonzero(hit)
            counts += np.bincount(query * BINS + place[hit].astype(np.int64), minlength=n * BINS)
        counts = counts.reshape(n, BINS)
        above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
        query, at = np.nonzero((counts > 0) & (above < missing[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(at), pa.array(counts[query, at])], ["query", "bin", "count"])

    counted = arrow_map(rows, run, "query bigint, bin bigint, count bigint").groupBy("query", "bin").agg(F.sum("count").alias("count"))
    down = Window.partitionBy("query").orderBy(F.col("bin").desc())
    summed = counted.withColumn("reached", F.sum("count").over(down))
    need = rows.sparkSession.createDataFrame([(i, int(m)) for i, m in enumerate(missing)], "query bigint, missing bigint")
    found = summed.join(F.broadcast(need), "query").where("reached >= missing").groupBy("query").agg(
        F.max_by(F.struct("bin", (F.col("reached") - F.col("count")).alias("above")), "bin").alias("at"))
    return {r["query"]: (r["at"]["bin"], r["at"]["above"]) for r in found.collect()}


def _kth(rows: DataFrame, queries: Queries, bound: int, k: int) -> np.ndarray:
    """Each query's k-th highest score; the lowest number where there are fewer."""
    n = len(queries.ids)
    low = np.full(n, max(LOW, -bound), np.int64)
    missing = np.full(n, k, np.int64)
    span = min(HIGH, bound) - int(low[0]) + 1
    short = np.zeros(n, bool)
    while True:
        width = -(-span // BINS)
        at = _select(rows, queries, low, min(span, 2**64 - 1), width, missing)
        for i in range(n):
            if i in at:
                low[i] = int(low[i]) + at[i][0] * width
                missing[i] -= at[i][1]
            else:
                short[i] = True
        if width == 1:
            low[short] = LOW
            return low
        span = width


def _finish(rows: DataFrame, queries: Queries, kth: np.ndarray, k: int) -> DataFrame:
    import pyarrow as pa

    shared = rows.sparkSession.sparkContext.broadcast((queries, kth))

    def run(batches):
        queries, kth = shared.value
        equal: dict[int, list[int]] = {}
        schema = ["query_id", "vec_id", "score"]
        for ids, scores, other in _scored(batches, queries):
            query, row = np.nonzero(other & (scores > kth[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(queries.ids[query]), pa.array(ids[row]), pa.array(scores[query, row])], schema)
            query, row = np.nonzero(other & (scores == kth[:, None]))
            for q in np.unique(query):
                equal[q] = sorted([*equal.get(q, []), *ids[row[query == q]].tolist()])[:k]
        query = np.repeat(list(equal), [len(v) for v in equal.values()]).astype(np.int64)
        ids = np.array([i for v in equal.values() for i in v], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(queries.ids[query]), pa.array(ids), pa.array(kth[query])], schema)

    found = arrow_map(rows, run, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, asked: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for all rows where ``asked`` holds, against all rows."""
    spark = vectors.sparkSession
    pair = [F.col(f"`{id_column}`").cast("bigint").alias("vec_id"), F.col(f"`{vector_column}`").cast("array<double>").alias("vector")]
    rows = vectors.select(*pair)
    wanted = vectors.where(asked).select(*pair).where("vec_id is not null and vector is not null").distinct()
    number = wanted.count()
    blocks = -(-number // (QUERY_BLOCK // 2)) if number > QUERY_BLOCK else 1
    largest = F.array_max(F.transform("vector", lambda x: F.abs(F.floor(x.cast("decimal(38,10)") * SCALE))))
    top = rows.where(F.forall("vector", lambda x: F.coalesce(F.abs(x) < 1e15, F.lit(False)))).agg(F.max(largest)).first()[0] or 0
    unbounded = not rows.where(F.exists("vector", lambda x: (F.abs(x) >= 1e15) & (F.abs(x) < float("inf")))).isEmpty()
    path = os.path.join(shared_dir(spark), f"topk-{uuid.uuid4().hex[:12]}")
    spark.createDataFrame([], RESULT).write.parquet(path)
    for block in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)) == block).orderBy("vec_id", "vector").toArrow().combine_chunks()
        ids, lists = _whole(part["vec_id"].combine_chunks(), part["vector"].combine_chunks())
        if not len(ids):
            continue
        matrix = _matrix(lists, max(map(len, lists)))
        mine = int(np.abs(matrix).max(initial=0.0))
        queries = Queries(ids, matrix, mine)
        bound = HIGH if unbounded else min(HIGH, max(1, mine) * max(1, int(top)) * matrix.shape[1] + 1)
        _finish(rows, queries, _kth(rows, queries, bound, k), k).write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)
