"""Isolation Forest (Liu, Ting, Zhou 2008), trained and scored on the cluster.

Training: one pass sends each row to the few trees that sample it, each tree is grown from its own
bounded sample, and the node table is the model. Scoring: the node table, whose size is fixed by
trees and sample size, goes to every executor and an Arrow function walks all trees per batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.values import calibrated_score
from flowloom.session import broadcast_if_small, ship, stored

NODE_SCHEMA = "tree INT, node INT, feature INT, threshold DOUBLE, path DOUBLE"
MAX_MODEL_BYTES = 512 << 20
NODE_BYTES = 20  # a packed node: feature, threshold and path


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    big = 2.0 * (np.log(safe - 1.0) + 0.5772156649) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def _draw_splits(points: np.ndarray, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray,
                 rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random non-constant feature per node with its bounds; feature -1 where all are constant.

    Features are drawn and redrawn a few times; only nodes that keep meeting constants look at all.
    """
    count, width = len(starts), points.shape[1]
    chosen = np.full(count, -1)
    low, high = np.zeros(count), np.zeros(count)
    open_nodes = np.flatnonzero(sizes > 1)
    for _ in range(4):
        if not len(open_nodes):
            return chosen, low, high
        pick = rng.integers(0, width, len(open_nodes))
        lengths = sizes[open_nodes]
        edges = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        inside = np.arange(lengths.sum()) - np.repeat(edges, lengths) + np.repeat(starts[open_nodes], lengths)
        values = points[rows[inside], np.repeat(pick, lengths)]
        lo, hi = np.minimum.reduceat(values, edges), np.maximum.reduceat(values, edges)
        good = hi > lo
        hit = open_nodes[good]
        chosen[hit], low[hit], high[hit] = pick[good], lo[good], hi[good]
        open_nodes = open_nodes[~good]
    for node in open_nodes:
        block = points[rows[starts[node]:starts[node] + sizes[node]]]
        lo, hi = block.min(axis=0), block.max(axis=0)
        varied = np.flatnonzero(hi > lo)
        if len(varied):
            pick = rng.choice(varied)
            chosen[node], low[node], high[node] = pick, lo[pick], hi[pick]
    return chosen, low, high


def grow_tree(points: np.ndarray, seed: int) -> pd.DataFrame:
    """Grow one tree level by level; nodes are numbered as in a heap.

    Per level all open nodes are handled together: row numbers sorted by node, a random non-constant
    feature and a uniform threshold per node.
    """
    rng = np.random.default_rng(seed)
    limit = math.ceil(math.log2(max(len(points), 2)))
    rows = np.arange(len(points))
    node_of = np.zeros(len(points), dtype=np.int64)
    nodes, features, thresholds, paths = [], [], [], []

    def leaf(ids: np.ndarray, sizes: np.ndarray, depth: int) -> None:
        nodes.append(ids)
        features.append(np.full(len(ids), -1))
        thresholds.append(np.zeros(len(ids)))
        paths.append(depth + average_path(sizes))

    for depth in range(limit + 1):
        if not len(rows):
            break
        order = np.argsort(node_of, kind="stable")
        rows, node_of = rows[order], node_of[order]
        ids, starts, sizes = np.unique(node_of, return_index=True, return_counts=True)
        if depth == limit:
            leaf(ids, sizes, depth)
            break
        chosen, lo, hi = _draw_splits(points, rows, starts, sizes, rng)
        split = chosen >= 0
        leaf(ids[~split], sizes[~split], depth)
        cut = (lo + (hi - lo) * rng.random(len(ids))).astype(points.dtype)
        cut = np.where(cut >= hi, lo, cut)
        nodes.append(ids[split])
        features.append(chosen[split])
        thresholds.append(cut[split].astype(float))
        paths.append(np.zeros(int(split.sum())))
        which = np.repeat(np.arange(len(ids)), sizes)
        keep = split[which]
        rows, node_of, which = rows[keep], node_of[keep], which[keep]
        right = points[rows, chosen[which]] > cut[which]
        node_of = 2 * node_of + 1 + right
    return pd.DataFrame({
        "node": np.concatenate(nodes).astype("int32"), "feature": np.concatenate(features).astype("int32"),
        "threshold": np.concatenate(thresholds), "path": np.concatenate(paths),
    })


@dataclass
class Forest:
    """Node tables in heap layout: one row per tree, one column per possible node."""

    names: list[str]
    sample_size: int
    feature: np.ndarray
    threshold: np.ndarray
    path: np.ndarray
    depth: int
    offset: float = -0.5
    ranges: dict = field(default_factory=dict)

    def mean_paths(self, x: np.ndarray) -> np.ndarray:
        rows, width = x.shape
        flat = np.ascontiguousarray(x).ravel()
        base = np.arange(rows) * width
        total = np.zeros(rows)
        for feat, cut, path in zip(self.feature, self.threshold, self.path):
            node = np.zeros(rows, dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (flat[base + feat[node]] > cut[node])
            total += path[node]
        return total / len(self.feature)

    def decision(self, x: np.ndarray) -> np.ndarray:
        """Below 0 for anomalies."""
        scale = float(average_path(self.sample_size)) or 1.0
        return -np.power(2.0, -self.mean_paths(x) / scale) - self.offset


def _pack(node_rows: pd.DataFrame, names: list[str], sample_size: int) -> Forest:
    """Extend every leaf down to the deepest level, so that scoring walks a fixed number of steps."""
    trees = int(node_rows["tree"].nunique())
    depth = int(np.floor(np.log2(node_rows["node"].to_numpy() + 1)).max())
    width = 2 ** (depth + 1) - 1
    if trees * width * NODE_BYTES > MAX_MODEL_BYTES:
        raise ValueError("forest too large to hand to every executor; use fewer trees or smaller samples")
    index = node_rows["tree"].rank(method="dense").to_numpy().astype(int) - 1
    feature = np.zeros((trees, width), dtype=np.int32)
    threshold = np.full((trees, width), np.inf)
    path = np.zeros((trees, width))
    node = node_rows["node"].to_numpy()
    inner = node_rows["feature"].to_numpy() >= 0
    feature[index[inner], node[inner]] = node_rows["feature"].to_numpy()[inner]
    threshold[index[inner], node[inner]] = node_rows["threshold"].to_numpy()[inner]
    path[index, node] = node_rows["path"].to_numpy()
    for i in range(width // 2):  # a leaf's threshold is +inf: its rows always turn left
        stop = np.isinf(threshold[:, i])
        path[stop, 2 * i + 1] = path[stop, i]
    return Forest(names, sample_size, feature, threshold, path, depth)


def assign_to_trees(df: DataFrame, keys: list[str], rows: int, trees: int, sample_size: int,
                    seed: int = 42) -> DataFrame:
    """Rows repeated for the trees that sample them; most rows of a large input are dropped here.

    The expected draws per row are ``trees * sample_size / rows``; draws and tree ids come from
    hashes of the row's key, so a retried task picks the same rows. A row's trees differ: they lie a step apart
    that shares no divisor with the number of trees, so a tree's sample is drawn without replacement.
    """
    if rows <= sample_size:
        return df.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn(
            "_draw", F.lit(0).cast("bigint"))
    # a margin of three standard deviations, so that nearly every tree reaches its sample size
    rate = trees * (sample_size + 3.2 * math.sqrt(sample_size)) / rows
    whole, part = int(rate), rate - int(rate)
    u = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    draws = F.least(F.lit(trees), F.lit(whole) + (u < part).cast("int"))
    steps = F.array(*[F.lit(s) for s in range(1, trees + 1) if math.gcd(s, trees) == 1])
    step = F.get(steps, F.pmod(F.xxhash64(*keys, F.lit(seed + 2)), F.size(steps)).cast("int"))
    first = F.pmod(F.xxhash64(*keys, F.lit(seed + 3)), F.lit(trees))
    picked = df.withColumn("_k", draws).where(F.col("_k") > 0)
    slots = F.explode(F.sequence(F.lit(1), F.col("_k")))
    hashed = F.xxhash64(*keys, F.col("_i"), F.lit(seed + 1))
    return (picked.withColumn("_i", slots).withColumn("_draw", hashed)
            .withColumn("tree", F.pmod(first + F.col("_i") * step, F.lit(trees)).cast("int")).drop("_k", "_i"))


def train_nodes(df: DataFrame, names: list[str], keys: list[str], rows: int, trees: int = 300,
                sample_size: int = 4096, seed: int = 42) -> DataFrame:
    """Node table of the forest; every group is one tree's bounded sample.

    Values travel in single precision, which halves the shuffle and is enough to place splits.
    """
    ship(df.sparkSession)
    psi = min(sample_size, rows)
    vector = F.array(*[F.col(n).cast("float") for n in names]).alias("x")
    sampled = assign_to_trees(df.select(*keys, vector), keys, rows, trees, psi, seed)
    width = len(names)

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        tree = int(key[0].as_py())
        points = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        if len(points) > psi:
            points = points[np.argsort(table["_draw"].to_numpy(), kind="stable")[:psi]]
        grown = grow_tree(points, seed * 100_003 + tree)
        grown.insert(0, "tree", np.int32(tree))
        return pa.Table.from_pandas(grown, preserve_index=False)

    return sampled.select("tree", "_draw", "x").groupBy("tree").applyInArrow(grow, NODE_SCHEMA)


def load_forest(nodes: DataFrame, names: list[str], sample_size: int) -> Forest:
    """The node table on the driver: at most trees x (2 x sample_size - 1) rows, and never more than a model may have."""
    most = MAX_MODEL_BYTES // NODE_BYTES
    rows = nodes.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError("forest too large to hand to every executor; use fewer trees or smaller samples")
    return _pack(rows, names, sample_size)


def score(df: DataFrame, forest: Forest, out: str = "decision") -> DataFrame:
    """Add the decision value. Batches stream through an Arrow function; nothing is cached or cut."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def decide(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = shared.value
        for columns in batches:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            yield pd.Series(model.decision(x))

    return df.withColumn(out, decide(*[F.col(n).cast("double") for n in forest.names]))


def score_by_joins(df: DataFrame, keys: list[str], nodes: DataFrame, names: list[str], sample_size: int,
                   offset: float = 0.0, out: str = "decision") -> DataFrame:
    """(keys, decision) from the node table by joins alone: every row walks every tree, a level a join.

    The plain form of :func:`score`, without a function in Python and without the forest on the driver. It
    costs rows x trees per level; ``keys`` must tell rows apart. The node table is bounded by trees and sample
    size and is broadcast behind a check of its size.
    """
    levels = int(nodes.agg(F.max(F.floor(F.log2(F.col("node") + 1.0)))).first()[0])
    trees = nodes.select("tree").distinct()
    table = broadcast_if_small(nodes, 2_000_000)
    at = df.select(*keys, F.array(*[F.col(n).cast("double") for n in names]).alias("_x")).join(broadcast_if_small(trees)).withColumns(
        {"node": F.lit(0), "_path": F.lit(None).cast("double")})
    for _ in range(levels + 1):
        met = at.join(table, ["tree", "node"], "left")
        inner = F.col("feature") >= 0
        step = (F.get("_x", F.col("feature")) > F.col("threshold")).cast("int")
        at = met.select(*keys, "_x", "tree", F.when(inner, 2 * F.col("node") + 1 + step).otherwise(-1).alias("node"),
                        F.coalesce("_path", F.when(~inner, F.col("path"))).alias("_path"))
    scale = float(average_path(sample_size)) or 1.0
    return at.groupBy(*keys).agg((-F.pow(F.lit(2.0), -F.avg("_path") / scale) - offset).alias(out))


def fit(df: DataFrame, names: list[str], keys: list[str], trees: int = 300, sample_size: int = 4096,
        contamination: float = 0.08, seed: int = 42) -> Forest:
    """Train on ``df`` (benign rows) and place the boundary so that ``contamination`` of it is flagged.

    The boundary is a quantile of all training scores (rank error 1/10,000).
    """
    rows = df.count()
    if rows == 0:
        raise ValueError("no rows to train on")
    forest = load_forest(train_nodes(df, names, keys, rows, trees, sample_size, seed), names, min(sample_size, rows))
    forest.offset = 0.0
    raw = score(df, forest).agg(F.percentile_approx("decision", contamination, 10_000)).first()[0]
    forest.offset = float(raw)
    return forest


def hash_sample(df: DataFrame, keys: list[str], rows: int, wanted: int, seed: int = 42) -> DataFrame:
    """About ``wanted`` rows, the same ones on every run; all rows when there are no more."""
    if rows <= wanted:
        return df
    bound = int((1 << 30) * wanted / rows)
    return df.where(F.pmod(F.xxhash64(*keys, F.lit(seed + 7)), F.lit(1 << 30)) < bound)


def calibration_bounds(scored: DataFrame, accuracy: int | None = None) -> DataFrame:
    """d_min, d_max with their headroom, and quantiles of benign decision values, in one row.

    Quantiles are exact or, with ``accuracy``, have a rank error of 1/accuracy.
    """
    cuts = [0.001, 0.01, 0.05, 0.5, 0.95, 0.99, 0.999]
    quantiles = F.percentile("decision", F.array(*map(F.lit, cuts))) if accuracy is None else \
        F.percentile_approx("decision", cuts, accuracy)
    base = scored.agg(F.min("decision").alias("lo"), F.max("decision").alias("hi"), quantiles.alias("q"))
    names = ["p0_1", "p1", "p5", "p50", "p95", "p99", "p99_9"]
    return base.select(
        F.when(F.col("lo") < 0, F.col("lo") * 1.5).otherwise(-0.1).alias("d_min"),
        F.when(F.col("hi") > 0, F.col("hi")).otherwise(0.1).alias("d_max"),
        F.col("lo").alias("score_min"), F.col("hi").alias("score_max"),
        *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names)])


def anomaly_scores(df: DataFrame, forest: Forest, d_min: float | Column | None = None,
                   d_max: float | Column | None = None, threshold: float = 5.0) -> DataFrame:
    """Decision value, calibrated 0-10 score and flag for every row."""
    out = score(df, forest).withColumn("anomaly_score", calibrated_score(F.col("decision"), d_min, d_max))
    return out.withColumn("flagged", F.col("anomaly_score") >= threshold)


def fit_and_score_batch(df: DataFrame, names: list[str], keys: list[str], trees: int = 100,
                        contamination: float = 0.05, sample_size: int = 256, seed: int = 42,
                        threshold: float = 5.0) -> DataFrame:
    """No trained model: train on four fifths of the batch (by key hash), then score all of it."""
    rows = df.count()
    train = hash_sample(df, keys, rows, max(10, int(rows * 0.8)), seed)
    forest = fit(train, names, keys, trees, sample_size, contamination, seed)
    return anomaly_scores(df, forest, threshold=threshold)


def save(nodes: DataFrame, name: str = "forest-nodes") -> DataFrame:
    """Keep the node table in the shared folder so that scoring jobs can load it."""
    return stored(nodes, name)
