"""Mixing sources to target weights by Poisson replication, in built-in functions only.

A source's rate is its target share of the rows asked for, divided by the rows it has. Every document draws
its number of copies from the Poisson distribution with that rate by inverting the distribution at a uniform
number, which is a hash of the seed and the document's id. The draw needs no other row, is the same in every
run and on every cluster, and copies of different documents are independent. A rate over 16 is split into
equal parts with draws of their own, whose sum has the same distribution, so tables of the distribution stay
short and any rate works. The copies then go to partitions, and to places in them, by another hash.

Edge cases: null sources are a source of their own; documents with a null id draw by the hash of their text;
null texts count as empty there. Repeated rows draw alike and each is replicated. Sources without a target
weight, and with weight null or not above zero, get no copies. Input columns named part, copy or shuffle_key
are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import text_of
from flowloom.session import broadcast_if_small

PART_RATE = 16
TERMS = 96
MAX_BROADCAST_SOURCES = 10_000  # of about a kilobyte each
RESULT = ("part", "copy", "shuffle_key")


def tempered(docs: DataFrame, power: float = 0.5, source_column: str = "source") -> DataFrame:
    """Target weights (source, weight) that are a power of the sources' row counts."""
    sizes = docs.groupBy(F.col(f"`{source_column}`").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    return sizes.select("source", F.pow(F.col("rows").cast("double"), F.lit(power)).alias("weight"))


def rates(docs: DataFrame, weights: DataFrame, rows_wanted: float | None = None, source_column: str = "source") -> DataFrame:
    """(source, parts, rate of a part, distribution of a part) for every source with a positive weight."""
    sizes = docs.groupBy(F.col(f"`{source_column}`").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    wanted = weights.where("weight > 0").groupBy("source").agg(F.sum("weight").alias("weight"))
    met = sizes.join(wanted, sizes["source"].eqNullSafe(wanted["source"])).select(sizes["source"], "rows", "weight")
    weight = met.agg(F.sum("weight")).first()[0] or 1.0
    if rows_wanted is None:
        rows_wanted = sizes.agg(F.sum("rows")).first()[0] or 0
    rate = F.lit(float(rows_wanted)) * F.col("weight") / F.lit(float(weight)) / F.col("rows")
    split = met.select("source", rate.alias("rate")).withColumn(
        "parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE)).cast("int"))
    return split.withColumn("rate", F.col("rate") / F.col("parts")).withColumn("cumulated", _distribution(F.col("rate")))


def _distribution(rate: Column) -> Column:
    """P(X <= k) for k from 0 to TERMS, by the recurrence of the terms."""
    start = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("all"))

    def step(s, k):
        term = s["term"] * rate / k
        total = s["total"] + term
        return F.struct(term.alias("term"), total.alias("total"), F.concat(s["all"], F.array(total)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["all"])


def _hash(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a hash of the seed and the parts."""
    return F.conv(F.substring(_hash(seed, *parts), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def mix_sources(docs: DataFrame, weights: DataFrame, rows_wanted: float | None = None, seed: int = 11,
                id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """Copies of ``docs`` in shuffled order, with part, copy (from 0 within the part) and shuffle_key."""
    docs = docs.drop(*RESULT)
    table = rates(docs, weights, rows_wanted, source_column).select(
        F.col("source").alias("__source"), F.col("parts").alias("__parts"), F.col("cumulated").alias("__cumulated"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    key = F.coalesce(F.col(f"`{id_column}`").cast("string"), F.md5(text_of(text_column).cast("binary")))
    # a row a source: broadcast while that is few, so that no text is shuffled by its source
    rated = docs.join(broadcast_if_small(table, MAX_BROADCAST_SOURCES), F.col(f"`{source_column}`").cast("string").eqNullSafe(F.col("__source")))
    drawn = rated.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).withColumn("__key", key)
    u = uniform(seed, F.col("__key"), F.col("part").cast("string"))
    times = drawn.withColumn("__u", u).withColumn("__times", F.size(F.filter("__cumulated", lambda c: c <= F.col("__u"))))
    copies = times.where("__times > 0").select(*own, "part", "__key", F.explode(F.sequence(F.lit(0), F.col("__times") - 1)).alias("copy"))
    keyed = copies.select(*own, "part", "copy", _hash(
        seed + 1, F.col("__key"), F.col("part").cast("string"), F.col("copy").cast("string")).alias("shuffle_key"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
