"""From raw documents to shuffled shards in five stages over the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import decontaminate, langid, mixing, neardup, sharding
from flowloom.llm.common import table
from flowloom.session import stored

#: Texts with a smaller share of known letter sequences than this are in no language that was learned.
LEAST_LANGUAGE_SCORE = 0.2
#: Texts of fewer letter sequences say too little to be rejected by their share.
LEAST_GRAMS = 20
SOURCE_POWER = 0.5
SHARDS = 8
SEED = 20240607


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under private column names, which no operator's columns can clash with, and the name of each column."""
    names = {c: f"__column{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; null texts, texts without letters and unknown languages go.

    A low share rejects no text too short to tell, and none labelled with a language of too few rows to learn.
    """
    model = langid.learn(langid.teaching_rows(docs))
    given, names = _apart(docs)
    judged = langid.predict(given, model, names["text"])
    unsure = (F.col(langid.GRAMS) < LEAST_GRAMS) | F.coalesce(F.col(names["lang"]).isin(*model.thin), F.lit(False))
    kept = judged.where((F.col("lang_pred") != langid.UNKNOWN) & (unsure | (F.col("score") >= LEAST_LANGUAGE_SCORE)))
    return kept.select(*names.values()).toDF(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares at least 0.8 of its five-word shingles stays."""
    return neardup.keep_one(docs, k=5, percent=80)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its source's rate draws, in shuffled order."""
    given, names = _apart(docs)
    weights = mixing.tempered(docs, SOURCE_POWER)
    mixed = mixing.mix_sources(given, weights, id_column=names["doc_id"], text_column=names["text"], source_column=names["source"])
    return mixed.select(*names.values()).toDF(*names)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with row_number, shard and slot."""
    return sharding.shard_rows(docs, SHARDS, SEED)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_to_weights),
    ("sharding", assign_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# Learned language filters, sketches and the latent search have no SQL form; tests compare the stages instead.
ORACLE_SQL = None
