"""Incident rows: built from alerts and verdicts, merged per connection, filtered and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom import constants as K
from flowloom.functions import values
from flowloom.functions.text import connection_key
from flowloom.session import literal_frame


def source_name(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce(values.lookup(K.SOURCE_NAMES, low, None), low)


def normal_sources(names: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(names, source_name), lambda s: s != ""))


def known_disposition(status: Column) -> Column:
    low = F.lower(F.coalesce(status, F.lit("open")))
    return F.when(low.isin(*K.DISPOSITIONS), low).otherwise("open")


def incident_from_alert(alerts: DataFrame) -> DataFrame:
    """Registry row of an alert: source, attack text, confidence rule and first disposition."""
    source = source_name(F.coalesce("type", F.lit("ml")))
    score, given = F.col("anomaly_score"), F.col("confidence")
    text = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("attack_type", "signature", "explanation")],
                      F.lit("Alert"))
    attack = F.when(source == "ml", F.concat(
        F.lit("ML anomaly ("), F.coalesce(score.cast("string"), F.lit("?")), F.lit(")"))).otherwise(text)
    no_confidence = F.coalesce(given, F.lit(0.0)) == 0
    confidence = F.when((F.coalesce(score, F.lit(0.0)) != 0) & no_confidence, score / 10.0).otherwise(
        F.when(no_confidence, 0.5).otherwise(given))
    both = F.array_compact(F.array(
        source, F.when((source == "llm") & F.coalesce(F.col("models").contains("heuristic"), F.lit(False)), "heuristic")))
    return alerts.select(
        connection_key(*[F.col(c) for c in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")]).alias("connection"),
        "ts_us", "src_ip", "dst_ip", "src_port", "dst_port", F.coalesce("protocol", F.lit("TCP")).alias("protocol"),
        both.alias("sources"), F.substring(attack, 1, 120).alias("attack_type"),
        F.coalesce("severity", F.lit("medium")).alias("severity"), F.round(confidence, 3).alias("confidence"),
        F.when(source == "llm", "true_positive").otherwise("open").alias("disposition"),
        F.substring(F.coalesce("explanation", F.lit("")), 1, 500).alias("summary"), F.col("id").alias("alert_id"))


def _last(column: str, order: str) -> Column:
    value = F.col(column)
    return F.max_by(value, F.when(F.coalesce(value.cast("string"), F.lit("")) != "", F.col(order)))


def merge_incidents(rows: DataFrame, order: str = "ts_us") -> DataFrame:
    """One incident per connection: union of sources, highest severity and confidence, last text.

    Every measure is a mergeable aggregate, so a connection with very many alerts combines in the
    tasks first. ``alert_ids`` is the number of distinct alerts; the ids stay in the alert table.
    """
    known = F.when(F.col("attack_type") != "Unknown", F.col("attack_type"))
    rank = values.merge_rank(F.col("severity"))
    tagged = rows.withColumn("_attack", known).withColumn("_rank", rank)
    # Sources come from a fixed list of names, so the set is small.
    grouped = tagged.groupBy("connection").agg(
        F.min(order).alias("first_ts_us"), F.max(order).alias("last_ts_us"),
        F.min_by("src_ip", order).alias("src_ip"), F.min_by("dst_ip", order).alias("dst_ip"),
        F.min_by("src_port", order).alias("src_port"), F.min_by("dst_port", order).alias("dst_port"),
        F.min_by("protocol", order).alias("protocol"), F.min_by("disposition", order).alias("disposition"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
        F.max("_rank").alias("_rank"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("alerts"),
        F.coalesce(_last("_attack", order), F.lit("Unknown")).alias("attack_type"),
        _last("summary", order).alias("summary"))
    return grouped.withColumn("severity", values.severity_of_rank(F.col("_rank"))).withColumn(
        "from_ai", F.array_contains("sources", "llm")).drop("_rank")


def incident_alerts(rows: DataFrame) -> DataFrame:
    """The distinct (connection, alert) pairs behind the incidents."""
    return rows.select("connection", "alert_id").distinct()


def fold_incidents(deltas: DataFrame) -> DataFrame:
    """Incidents from several already merged parts, such as one per micro-batch.

    All measures are mergeable, so parts are only ever appended and folded when read.
    """
    attack = F.when(F.col("attack_type") != "Unknown", F.col("attack_type"))
    tagged = deltas.withColumn("_attack", attack).withColumn("_rank", values.merge_rank(F.col("severity")))

    def first(name: str) -> Column:
        return F.min_by(name, "first_ts_us").alias(name)

    grouped = tagged.groupBy("connection").agg(
        F.min("first_ts_us").alias("_first"), F.max("last_ts_us").alias("_last"),
        *[first(n) for n in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "disposition")],
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
        F.max("_rank").alias("_rank"), F.max("confidence").alias("confidence"), F.sum("alerts").alias("alerts"),
        F.coalesce(_last("_attack", "last_ts_us"), F.lit("Unknown")).alias("attack_type"),
        _last("summary", "last_ts_us").alias("summary"))
    return grouped.withColumnsRenamed({"_first": "first_ts_us", "_last": "last_ts_us"}).withColumn(
        "severity", values.severity_of_rank(F.col("_rank"))).withColumn(
        "from_ai", F.array_contains("sources", "llm")).drop("_rank")


def search_incidents(incidents: DataFrame, since_us: int | None = None, disposition: str | None = None,
                     source: str | None = None, text: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest incidents first; an incident's time is that of its first alert."""
    out = incidents
    if since_us:
        out = out.where(F.col("first_ts_us") > since_us)
    if disposition:
        out = out.where(F.col("disposition") == disposition)
    if source:
        out = out.where(F.array_contains("sources", source))
    if text and text.strip():
        hay = F.lower(F.concat_ws(" ", "src_ip", "dst_ip", "attack_type", "summary", "protocol", "disposition"))
        out = out.where(F.contains(hay, F.lit(text.strip().lower())))
    out = out.orderBy(F.desc("first_ts_us"), F.asc("connection"))
    return out.limit(limit) if limit else out


def disposition_counts(incidents: DataFrame) -> DataFrame:
    """Incidents per disposition, all six listed."""
    counts = incidents.groupBy(F.coalesce("disposition", F.lit("open")).alias("disposition")).agg(
        F.count(F.lit(1)).alias("n"))
    names = literal_frame(incidents.sparkSession, [(d,) for d in K.DISPOSITIONS], "disposition STRING")
    return names.join(counts, "disposition", "left").select("disposition", F.coalesce("n", F.lit(0)).alias("n"))


def source_counts(incidents: DataFrame) -> DataFrame:
    return incidents.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def apply_verdicts(incidents: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Analysts' dispositions and notes; the newest one per connection wins."""
    newest = verdicts.groupBy("connection").agg(
        F.max_by(known_disposition(F.col("disposition")), "ts_us").alias("_d"),
        F.max_by("analyst_note", "ts_us").alias("analyst_note"))
    return incidents.join(newest, "connection", "left").withColumn(
        "disposition", F.coalesce("_d", "disposition")).drop("_d")


# ---- verdicts of several models about one item ---------------------------------------------

def merge_verdicts(outputs: DataFrame, min_confidence: float = 0.55) -> DataFrame:
    """Items that models call suspicious: best confidence high enough, or at least two agree."""
    bad = outputs.where("suspicious")
    rank = values.merge_rank(F.coalesce("severity", F.lit("medium")), 1)
    merged = bad.withColumn("_rank", rank).groupBy("item").agg(
        F.count(F.lit(1)).alias("votes"), F.max("confidence").alias("confidence"), F.max("_rank").alias("_rank"),
        F.array_join(F.array_sort(F.collect_set("model")), ", ").alias("models"),
        F.max_by("ai_status", F.struct("confidence", F.col("ai_status"))).alias("ai_status"))
    return merged.where((F.col("confidence") >= min_confidence) | (F.col("votes") >= 2)).select(
        "item", "votes", "confidence", values.severity_of_rank(F.col("_rank")).alias("severity"), "models", "ai_status")


def preferred_models(outputs: DataFrame, order: dict[str, list[str]]) -> DataFrame:
    """Pivot model rows into named slots; the first listed model that answered fills a slot."""
    wide = outputs.groupBy("item").agg(*[
        F.max(F.when(F.col("model") == m, F.col("ai_status"))).alias(f"_{m}")
        for m in {m for names in order.values() for m in names}])
    return wide.select("item", *[F.coalesce(*[F.col(f"_{m}") for m in names]).alias(slot) for slot, names in order.items()])


def complete_batches(answers: DataFrame, batch: str = "batch", body: str = "body", size: str = "batch_size") -> DataFrame:
    """Parsed entries of answers that cover every index of their batch; other batches are rejected.

    The answer is one JSON document per batch, so the check stays inside the row.
    """
    schema = "results ARRAY<STRUCT<index: INT, ai_status: STRING, severity: STRING, confidence: DOUBLE>>"
    parsed = answers.withColumn("_r", F.from_json(body, schema)["results"])
    indexed = F.filter("_r", lambda e: e["index"].isNotNull())
    indices = F.array_distinct(F.transform(indexed, lambda e: e["index"]))
    entries = parsed.where(F.size(indices) == F.col(size)).select(batch, F.explode(indexed).alias("e"))
    status = F.lower(F.coalesce("e.ai_status", F.lit("open")))
    return entries.select(
        batch, F.col("e.index").cast("bigint").alias("index"), status.alias("ai_status"),
        (status == "true_positive").alias("suspicious"), F.coalesce("e.severity", F.lit("info")).alias("severity"),
        F.coalesce("e.confidence", F.lit(0.0)).alias("confidence"))


def triage_rows(packets: DataFrame) -> DataFrame:
    """Registry row per packet from its merged verdict, heuristic hit and primary model answer.

    Columns: ``merged_*``, ``heur_*`` and ``prim_*`` for attack, severity, confidence, summary;
    ``ai_status``; ``merged_indicators`` and ``heur_indicators`` arrays.
    """
    def pick(name: str, default) -> Column:
        return F.coalesce(F.col(f"merged_{name}"), F.col(f"heur_{name}"), F.col(f"prim_{name}"), F.lit(default))

    heuristic = F.col("heur_attack").isNotNull()
    status = F.lower(F.coalesce("ai_status", F.lit("")))
    base = F.when(status != "", known_disposition(status)).when(F.col("merged_attack").isNotNull(), "true_positive") \
        .otherwise("open")
    reopened = heuristic & base.isin("true_negative", "benign", "open")
    shown = F.when(status != "", status).otherwise(base)
    line = F.when(reopened & shown.isin("true_negative", "benign"), "open").otherwise(shown)
    empty = F.array().cast("array<string>")
    return packets.select(
        "item", F.when(reopened, "open").otherwise(base).alias("disposition"), line.alias("ai_status"),
        F.substring(pick("attack", "Unknown"), 1, 120).alias("attack_type"),
        F.lower(pick("severity", "info")).alias("severity"), F.round(pick("confidence", 0.0), 3).alias("confidence"),
        F.coalesce("merged_summary", "prim_summary", "heur_summary", F.lit("")).alias("summary"),
        F.array_join(F.concat(F.coalesce("merged_indicators", empty), F.coalesce("heur_indicators", empty)), ",")
        .alias("indicators"))


def triage_gate(rows: DataFrame, min_heuristic: float = 0.75) -> DataFrame:
    """Rows that become alerts: a suspicious verdict with a model behind it, else a sure heuristic."""
    by_model = F.coalesce("verdict_suspicious", F.lit(False)) & (F.coalesce("model_answers", F.lit(0)) > 0)
    by_heuristic = F.coalesce("heur_confidence", F.lit(0.0)) >= min_heuristic
    return rows.where(by_model | by_heuristic).withColumn("gate", F.when(by_model, "model").otherwise("heuristic"))
