"""Centroid clustering with an incremental matrix of exact integer dot products.

Vectors become integers, floor(scale * x). A table holds, per vector, its components and its dot product
with every centroid. When the centroids move, a product changes only by the components that moved, so each
round adds ``component * change`` for these alone, writes the table anew and takes the nearest centroid from
|c|^2 - 2 v.c. Tasks sum the components of each cluster before anything is shuffled: k rows a task leave it,
and k * width sums reach the driver, whatever the number of vectors.

Each round's table is written to the shared folder, so a lost executor costs one round at most.

Edge cases: vectors that are null, have another length than ``width`` or hold null or non-finite components
take no part; neither do vectors with a component beyond ``LARGEST``, whose squared distance would not fit a
long. A null id counts as the empty text in the choice of the first centroids; of rows with the same id all
take part, and ties in that choice go to the smaller vector. Fewer vectors than centroids: as many centroids
as vectors. An empty table gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import arrow_map
from flowloom.session import literal_frame, stored

LARGEST = 1 << 27
STATE = "vec_id bigint, v array<int>, dots array<bigint>"


def whole_vectors(vectors: DataFrame, width: int, scale: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Id and integer components of the rows that take part, computed inside the JVM."""
    x = F.col("_x")
    fits = (F.size(x) == width) & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= float(LARGEST / scale)))
    return (vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("_x"))
            .where(x.isNotNull() & fits)
            .select("vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("int")).alias("v")))


def first_centroids(whole: DataFrame, k: int, salt: str = "1") -> np.ndarray:
    """The k vectors with the smallest hash of ``salt:id``, in ascending hash order."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = whole.orderBy(key, "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), len(rows[0]["v"]) if rows else 0)


def _matrix(column, width: int) -> np.ndarray:
    """(rows, width) of an Arrow list column whose lists all have ``width`` entries."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _products(v: np.ndarray, change: np.ndarray) -> np.ndarray:
    """(rows, k) exact products of integer vectors with the centroids' changes, moved components alone."""
    out = np.zeros((len(v), len(change)), np.int64)
    largest = int(np.abs(v).max(initial=0)) * int(np.abs(change).max(initial=0)) * v.shape[1]
    for k, moved in enumerate(change):
        at = np.flatnonzero(moved)
        if len(at):
            # below 2**53 floating-point products and sums of integers are exact, and much faster
            out[:, k] = (v[:, at].astype(np.float64) @ moved[at].astype(np.float64) if largest < 2**53
                         else v[:, at].astype(np.int64) @ moved[at])
    return out


def _nearest(dots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row (ties: smaller number) and its squared distance without the row's own norm."""
    partial = (centroids * centroids).sum(axis=1)[None, :] - 2 * dots
    best = partial.argmin(axis=1)
    return best, partial[np.arange(len(best)), best]


def _lists(matrix: np.ndarray, kind):
    import pyarrow as pa

    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, max(width, 1), dtype=np.int32)[:n + 1]),
                                    pa.array(matrix.reshape(-1), type=kind))


def _moved(state: DataFrame, change: np.ndarray) -> DataFrame:
    """The table with every dot product brought up to the centroids' change."""
    def run(batches):
        import pyarrow as pa

        k, width = change.shape
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), width)
            dots = _products(v, change)
            if "dots" in batch.schema.names:
                dots += _matrix(batch.column("dots"), k)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), _lists(dots, pa.int64())],
                                             names=["vec_id", "v", "dots"])

    return arrow_map(state, run, STATE)


def _sums(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of each cluster and the sums of their components; tasks add up their own rows first."""
    k, width = centroids.shape

    def run(batches):
        import pyarrow as pa

        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                best, _ = _nearest(_matrix(batch.column("dots"), k), centroids)
                v = _matrix(batch.column("v"), width).astype(np.int64)
                count += np.bincount(best, minlength=k)
                for c in np.unique(best):
                    total[c] += v[best == c].sum(axis=0)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(count[used], pa.int64()), _lists(total[used], pa.int64())],
            names=["cluster", "n", "total"])

    parts = arrow_map(state, run, "cluster int, n bigint, total array<bigint>")
    rows = (parts.select("cluster", "n", F.posexplode("total").alias("place", "part"))
            .groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).collect())
    count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
    for r in rows:
        count[r["cluster"]], total[r["cluster"], r["place"]] = r["n"], r["total"]
    return count, total


def _final(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        k, width = centroids.shape
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), width).astype(np.int64)
            best, partial = _nearest(_matrix(batch.column("dots"), k), centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(best, pa.int32()), pa.array((v * v).sum(axis=1) + partial, pa.int64())],
                names=["vec_id", "cluster", "distance"])

    return arrow_map(state, run, "vec_id bigint, cluster int, distance bigint")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64,
            id_column: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that takes part, and the final centroids."""
    whole = whole_vectors(vectors, width, scale, id_column, vector)
    centroids = first_centroids(whole, k)
    if not len(centroids):
        return whole.sparkSession.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), centroids
    state = stored(_moved(whole, centroids), "centroid-products")
    for _ in range(rounds):
        count, total = _sums(state, centroids)
        new = np.where(count[:, None] > 0, np.floor_divide(total, np.maximum(count, 1)[:, None]), centroids)
        if (new != centroids).any():
            state = stored(_moved(state, new - centroids), "centroid-products")
        centroids = new
    return _final(state, centroids), centroids


def described(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The assignment with each cluster's and the whole inertia and the hash of the cluster's centroid.

    The join's right side has one row per centroid.
    """
    assigned = stored(assigned, "centroid-clusters")
    inertia = {r["cluster"]: int(r["inertia"]) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    whole = sum(inertia.values())
    rows = [(c, _long(inertia[c]), _long(whole), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
            for c in sorted(inertia)]
    facts = literal_frame(assigned.sparkSession, rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _long(value: int) -> int:
    """Sums beyond a long are held at its limit."""
    return min(value, 2**63 - 1)
