"""Model quality: confusion, per-label metrics, threshold sweep and deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(0.0)


def _with_metrics(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    f1 = _ratio(2 * tp, 2 * tp + fp + fn)
    return counts.withColumns({
        "samples": tp + fp + fn + tn, "attacks": tp + fn, "benign": fp + tn, "predicted": tp + fp,
        "accuracy": _ratio(tp + tn, tp + fp + fn + tn), "precision": precision, "recall": recall, "f1": f1,
    })


def _confusion(score: str, attack: str, threshold: float) -> list[Column]:
    hit, bad = F.col(score) >= threshold, F.col(attack)
    return [F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"),
            F.count_if(~hit & bad).alias("fn"), F.count_if(~hit & ~bad).alias("tn")]


def confusion(scored: DataFrame, threshold: float = 5.0, score: str = "score", attack: str = "is_attack") -> DataFrame:
    """One row: confusion matrix, accuracy, precision, recall and F1 (0 where undefined)."""
    return _with_metrics(scored.agg(*_confusion(score, attack, threshold)))


def per_label(scored: DataFrame, threshold: float = 5.0, min_rows: int = 0, score: str = "score",
              attack: str = "is_attack", label: str = "label") -> DataFrame:
    """Metrics of each label with at least ``min_rows`` rows, and of all attacks together, in one pass.

    The all-attacks row is summed from the label counts, not from the data again.
    """
    counts = scored.groupBy(label, attack).agg(*_confusion(score, attack, threshold))
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]
    by_label = counts.groupBy(label).agg(*sums)
    attacks = counts.where(F.col(attack)).agg(*sums).select(F.lit("all_attacks").alias(label), "tp", "fp", "fn", "tn")
    both = _with_metrics(by_label.unionByName(attacks))
    return both.where(F.col("samples") >= min_rows)


def top_labels(metrics: DataFrame, n: int = 12, label: str = "label") -> DataFrame:
    return metrics.where(F.col(label) != "all_attacks").orderBy(F.desc("recall"), F.asc(label)).limit(n)


def threshold_sweep(scored: DataFrame, start: float = 3.0, stop: float = 9.0, step: float = 0.25,
                    score: str = "score", attack: str = "is_attack") -> DataFrame:
    """Quality at every threshold from a histogram of scores.

    The data collapse to one row per (threshold step, class) before thresholds enter, so the sweep
    costs one partial aggregation whatever the number of thresholds.
    """
    steps = int(round((stop - start) / step))
    bucket = F.least(F.lit(steps), F.floor((F.col(score) - start) / step)).cast("int")
    histogram = scored.where(F.col(score).isNotNull()).groupBy(bucket.alias("_b"), F.col(attack).alias("_a")).agg(
        F.count(F.lit(1)).alias("_n"))
    grid = scored.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("_t"))
    above = F.col("_b") >= F.col("_t")

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("_n"))), F.lit(0))

    # both sides are tiny: thresholds x histogram buckets
    counts = grid.join(F.broadcast(histogram)).groupBy("_t").agg(
        total(above & F.col("_a")).alias("tp"), total(above & ~F.col("_a")).alias("fp"),
        total(~above & F.col("_a")).alias("fn"), total(~above & ~F.col("_a")).alias("tn"))
    m = _with_metrics(counts)
    return m.select(
        (F.lit(start) + F.col("_t") * step).alias("threshold"),
        F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"),
        F.round("f1", 4).alias("f1"),
        F.round(_ratio(F.col("fp"), F.col("fp") + F.col("tn")), 4).alias("benign_fp_rate"))


def recommend_threshold(sweep: DataFrame, max_fp_rate: float = 0.10) -> DataFrame:
    """Best F1 among thresholds within the false-positive cap, else best F1; ties go to the lowest."""
    within = (F.col("benign_fp_rate") <= max_fp_rate)
    return sweep.withColumn("within_cap", within).orderBy(
        F.desc("within_cap"), F.desc("f1"), F.asc("threshold")).limit(1)


def _draw(keys: list[str], seed: int) -> Column:
    """15 hexadecimal digits of a hash of the row's key, which other engines compute alike."""
    told = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed)))
    return F.substring(F.md5(told), 1, 15)


def sample_rows(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """n rows that are the same on every run: the smallest key hashes."""
    return df.withColumn("_h", _draw(keys, seed)).orderBy("_h", *keys).limit(n).drop("_h")


def stratified_sample(df: DataFrame, n: int, keys: list[str], attack: str = "is_attack", seed: int = 42) -> DataFrame:
    """At most a fifth attacks, the rest benign.

    Each stratum is first thinned in place to hashes under a bound that a little more rows than wanted
    have, so the exact cut by the same hash sorts about as many rows as it returns.
    """
    sizes = {bool(r[attack]): r["count"] for r in df.groupBy(attack).count().collect()}  # two rows
    attacks_wanted = min(sizes.get(True, 0), n // 5)
    wanted = {True: attacks_wanted, False: n - attacks_wanted}
    parts = []
    for value, count in wanted.items():
        stratum = df.where(F.col(attack) == value)
        share = (count * 1.1 + 6 * count ** 0.5 + 50) / max(sizes.get(value, 0), 1)
        if share < 1:
            stratum = stratum.where(_draw(keys, seed) < f"{int(share * (1 << 60)):015x}")
        parts.append(sample_rows(stratum, count, keys, seed))
    return parts[1].unionByName(parts[0])


def attack_label_frame(df: DataFrame, label: str = "Label") -> DataFrame:
    from flowloom.operators.features import is_attack

    return df.withColumn("is_attack", is_attack(F.col(label)))
