"""Model workflow: clean, scale, train, calibrate, tune and evaluate on labelled flows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.values import calibrated_score
from flowloom.operators import evaluate as E
from flowloom.operators import features as FT
from flowloom.operators import forest as IF
from flowloom.session import stored

# fixed values: row limits of the workflow's presets
PRESETS = {"quick": 100_000, "standard": 2_000_000, "all": None}


@dataclass
class Model:
    forest: IF.Forest
    ranges: dict[str, tuple[float, float]]
    medians: dict[str, float]
    d_min: float
    d_max: float
    threshold: float = 5.0
    history: dict = field(default_factory=dict)

    def score(self, features: DataFrame) -> DataFrame:
        """Scaled features, decision value, 0-10 score and flag."""
        return IF.anomaly_scores(FT.scale(features, self.ranges), self.forest, self.d_min, self.d_max, self.threshold)


def train(benign: DataFrame, names: list[str], keys: list[str], trees: int = 300, sample_size: int = 4096,
          contamination: float = 0.08, seed: int = 42, median_accuracy: int | None = 10_000) -> Model:
    """Scaler bounds, medians, forest and calibration from benign rows.

    One pass yields bounds and medians, one the tree samples, one the calibration scores of all rows.
    ``median_accuracy`` None asks for exact medians.
    """
    model = grown(benign, names, keys, trees, sample_size, seed, median_accuracy)
    return calibrated(model, IF.score(FT.scale(benign.select(*names), model.ranges), model.forest), contamination)


def grown(benign: DataFrame, names: list[str], keys: list[str], trees: int = 300, sample_size: int = 4096,
          seed: int = 42, median_accuracy: int | None = 10_000) -> Model:
    """Bounds, medians and forest; the boundary is 0 until :func:`calibrated` places it."""
    stats = benign.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.min(n).cast("double").alias(f"lo_{i}") for i, n in enumerate(names)],
        *[F.max(n).cast("double").alias(f"hi_{i}") for i, n in enumerate(names)],
        *[(F.percentile(n, 0.5) if median_accuracy is None else F.percentile_approx(n, 0.5, median_accuracy)).cast("double").alias(f"m_{i}")
          for i, n in enumerate(names)]).first()
    rows = stats["rows"]
    ranges = {n: (stats[f"lo_{i}"], stats[f"hi_{i}"]) for i, n in enumerate(names)}
    medians = {n: stats[f"m_{i}"] for i, n in enumerate(names)}
    scaled = FT.scale(benign.select(*{*keys, *names}), ranges)
    nodes = IF.train_nodes(scaled, names, keys, rows, trees, sample_size, seed)
    forest = IF.load_forest(nodes, names, min(sample_size, rows))
    forest.offset = 0.0
    return Model(forest, ranges, medians, -0.1, 0.1)


def calibrated(model: Model, raw: DataFrame, contamination: float = 0.08) -> Model:
    """Boundary and score bounds from the training rows' decision values, taken before there was a boundary."""
    found = raw.agg(
        F.percentile_approx("decision", contamination, 10_000).alias("cut"), F.min("decision").alias("lo"),
        F.max("decision").alias("hi")).first()
    model.forest.offset = float(found["cut"])
    lo, hi = found["lo"] - model.forest.offset, found["hi"] - model.forest.offset
    model.d_min, model.d_max = lo * 1.5 if lo < 0 else -0.1, hi if hi > 0 else 0.1
    return model


def evaluate(model: Model, labelled: DataFrame, keys: list[str], label: str = "Label", keep: bool = True) -> dict[str, DataFrame]:
    """Sweep, recommended threshold, confusion and per-label metrics from one scored table."""
    scored = model.score(E.attack_label_frame(labelled, label)).select(
        *keys, F.col("anomaly_score").alias("score"), "is_attack", F.col(label).alias("label"))
    return measured(model, stored(scored, "scored") if keep else scored)


def measured(model: Model, scored: DataFrame) -> dict[str, DataFrame]:
    """The evaluation of rows that have their ``score``, ``is_attack`` and ``label``."""
    sweep = E.threshold_sweep(scored)
    return {"scored": scored, "sweep": sweep, "recommended": E.recommend_threshold(sweep),
            "confusion": E.confusion(scored, model.threshold), "by_label": E.per_label(scored, model.threshold)}


def run(labelled: DataFrame, names: list[str], keys: list[str], label: str = "Label", preset: str = "all",
        **options) -> tuple[Model, dict[str, DataFrame]]:
    """Train on the benign rows, then evaluate on all of them; a preset bounds the training rows.

    Cleaning ends in a shuffle over whole rows and every later step reads its result, so the cleaned
    rows are written once. Every row walks the trees once: calibration and evaluation read the same
    decision values.
    """
    cleaned = stored(FT.clean_dataset(labelled.select(*dict.fromkeys([*keys, *names, label])), names), "cleaned")
    contamination = options.pop("contamination", 0.08)
    limit = PRESETS[preset]

    def training_rows(rows: DataFrame) -> DataFrame:
        benign = rows.where(FT.is_benign(F.col(label)))
        return IF.hash_sample(benign, keys, benign.count(), limit) if limit else benign

    model = grown(training_rows(cleaned), names, keys, **options)
    columns = list(dict.fromkeys([*keys, label]))
    raw = stored(IF.score(FT.scale(cleaned, model.ranges), model.forest).select(*columns, "decision"), "decisions")
    model = calibrated(model, training_rows(raw), contamination)
    score = calibrated_score(F.col("decision") - model.forest.offset, model.d_min, model.d_max)
    scored = E.attack_label_frame(raw, label).select(*keys, score.alias("score"), "is_attack", F.col(label).alias("label"))
    return model, measured(model, scored)
