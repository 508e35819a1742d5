"""Threat intelligence: latest verdicts per observable, joins, upserts and pluggable look-ups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions import net, values
from flowloom.session import ship

VERDICT_FIELDS = ["vt", "abuse", "new_domain", "pulses", "sandbox", "scanner", "known_good", "vulns"]


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Newest row per key. ``max`` of a struct combines on the map side, so a hot key stays cheap."""
    rest = [c for c in df.columns if c not in keys and c != version]
    newest = df.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in [version, *rest]])


def latest_by_column(df: DataFrame, keys: list[str], version: str, columns: list[str]) -> DataFrame:
    """Patched view: per key and column the newest value that is not null."""
    return df.groupBy(*keys).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(version))).alias(c) for c in columns])


def fresh_intel(intel: DataFrame, now: Column, ttl_hours: int = 24) -> DataFrame:
    """Newest answer per (type, value, provider) that is younger than the time to live."""
    young = intel.where(F.col("fetched_at") > now - F.expr(f"interval {ttl_hours} hours"))
    return latest(young, ["type", "value", "provider"], "fetched_at")


def enrich(observables: DataFrame, intel: DataFrame, providers: list[str], payload: str = "score") -> DataFrame:
    """Observables with one column per provider; internal addresses are not looked up."""
    wide = intel.groupBy("type", "value").pivot("provider", providers).agg(F.max(payload))
    looked_up = (F.col("type") != "ip") | net.is_external_ip(F.col("value"))
    outside = observables.withColumn("_key", F.when(looked_up, F.col("value")))
    table = wide.withColumnsRenamed({"type": "_t", "value": "_v"})
    joined = outside.join(table, (F.col("type") == F.col("_t")) & (F.col("_key") == F.col("_v")), "left")
    return joined.drop("_key", "_t", "_v")


def with_verdict(df: DataFrame) -> DataFrame:
    """Add ``is_malicious``, ``confidence`` and ``signals`` from the provider columns."""
    c = {name: F.col(name) for name in VERDICT_FIELDS}
    return df.withColumns({
        "is_malicious": values.intel_malicious(c["vt"], c["abuse"], c["new_domain"], c["pulses"], c["sandbox"],
                                               c["scanner"]),
        "confidence": values.intel_confidence(*[c[n] for n in VERDICT_FIELDS]),
        "signals": values.intel_signals(c["vt"], c["abuse"], c["new_domain"], c["pulses"], c["sandbox"],
                                        c["scanner"], c["vulns"]),
    })


def upsert_observables(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert new observables and merge known ones.

    Counts of a known observable stay, the malicious flag follows the newest answer, the confidence
    is the larger one and the intel maps merge with the incoming keys winning. Incoming rows must be
    unique per (type, value), see :func:`latest`.
    """
    key = ["type", "value"]
    a, b = current.alias("a"), incoming.alias("b")
    cond = (F.col("a.type") == F.col("b.type")) & (F.col("a.value") == F.col("b.value"))
    empty = F.create_map().cast("map<string,string>")
    theirs = F.coalesce("b.intel", empty)
    ours = F.map_filter(F.coalesce("a.intel", empty), lambda k, _: ~F.map_contains_key(theirs, k))
    return a.join(b, cond, "full").select(
        *[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key],
        F.coalesce("a.occurrence_count", F.lit(1)).cast("bigint").alias("occurrence_count"),
        F.coalesce("b.is_malicious", "a.is_malicious", F.lit(False)).alias("is_malicious"),
        F.greatest(F.coalesce("a.confidence", F.lit(0.0)), F.coalesce("b.confidence", F.lit(0.0))).alias("confidence"),
        F.map_concat(ours, theirs).alias("intel"),
        F.when(F.col("b.value").isNotNull(), "complete").otherwise(F.col("a.status")).alias("status"))


def enrich_with(df: DataFrame, key: str, fn: Callable[[pd.Series], pd.DataFrame], schema: str,
                lookups_at_once: int | None = None) -> DataFrame:
    """Call a caller's look-up on the distinct keys only and return its rows.

    ``fn`` gets a batch of keys and returns a frame in ``schema``. ``lookups_at_once`` bounds the
    number of tasks, and so of concurrent callers.
    """
    ship(df.sparkSession)
    distinct = df.select(key).where(F.col(key).isNotNull()).distinct()
    if lookups_at_once:
        distinct = distinct.repartition(lookups_at_once, key)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield fn(batch[key])

    return distinct.mapInPandas(call, schema)


def compact_intel(provider: Column, payload: Column, keep: dict[str, list[str]], budget: int | None = None) -> Column:
    """Per provider only the listed payload fields (``payload`` is JSON).

    With a ``budget`` an answer of more characters is left out as a whole and its length stands for it, so what
    is returned always parses.
    """
    out = payload
    for name, fields in keep.items():
        slim = F.to_json(F.struct(*[F.get_json_object(payload, f"$.{f}").alias(f) for f in fields]))
        out = F.when(provider == name, slim).otherwise(out)
    error = F.get_json_object(payload, "$.error")
    failed = F.to_json(F.struct(error.alias("error")))
    whole = F.when(error.isNotNull(), failed).otherwise(out)
    if budget is None:
        return whole
    return F.when(F.length(whole) > budget, F.to_json(F.struct(F.length(whole).alias("omitted_chars")))).otherwise(whole)
