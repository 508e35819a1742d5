"""Ordered operators that stay distributed when one key holds much of the data.

A window partitioned by a key alone puts the whole key into one task. Here the key's timeline is
cut into slices; a row is copied into a neighbouring slice only where that slice needs it as
context. Rolling values come from running sums of arrivals (+1) and expiries (-1), so a slice
costs one sort and one pass, never a scan of the frame per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES_PER_SPAN = 8


def _names(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def sliced(df: DataFrame, ts: str, width: int, lookback: int = 0, lookahead: int = 0) -> DataFrame:
    """Add ``_own`` and ``_slice``; copy rows that a later (earlier) slice looks back (ahead) to."""
    t = F.col(ts)
    own = F.floor(t / width).cast("bigint")
    if not lookback and not lookahead:
        return df.withColumn("_own", own).withColumn("_slice", own)
    first = F.floor((t - lookahead) / width).cast("bigint")
    last = F.floor((t + lookback) / width).cast("bigint")
    return df.withColumn("_own", own).withColumn("_slice", F.explode(F.sequence(first, last)))


def _entries(ts: str, span: int, arrival: Column, expiry: Column) -> Column:
    """A row's entries: ``arrival`` is added at its time, ``expiry`` (when not 0) ``span`` later.

    The row itself travels with the arrival. An expiry sorts after arrivals of the same instant, so
    both ends of the frame are inclusive.
    """
    first = F.struct(F.col(ts).alias("at"), F.lit(0).alias("phase"), arrival.cast("int").alias("d"),
                     F.col("_row").alias("row"))
    last = F.struct((F.col(ts) + span).alias("at"), F.lit(1).alias("phase"), expiry.cast("int").alias("d"),
                    F.lit(None).alias("row"))
    return F.explode(F.when(expiry != 0, F.array(first, last)).otherwise(F.array(first)))


def _arrivals_and_expiries(df: DataFrame, keys: list[str], ts: str, span: int, tie: str, width: int,
                           extra: dict[str, Column] | None = None, feeds: Column | None = None) -> DataFrame:
    """Two entries per row and slice; a row that does not feed the window only looks at it."""
    payload = F.struct(*[F.col(c) for c in df.columns])
    base = sliced(df.withColumn("_row", payload), ts, width, lookback=span)
    counts = F.lit(1) if feeds is None else F.coalesce(feeds, F.lit(False)).cast("int")
    if feeds is not None:  # copies into the next slice are context: only feeding rows are needed there
        base = base.withColumn("_feeds", counts).where((F.col("_feeds") == 1) | (F.col("_slice") == F.col("_own")))
        counts = F.col("_feeds")
    entry = _entries(ts, span, counts, -counts)
    keep = [F.col(k) for k in keys] + [F.col(tie).alias("_tie"), "_own", "_slice"]
    for name, expr in (extra or {}).items():
        keep.append(expr.alias(name))
    return base.select(*keep, entry.alias("_e")).select(
        *keys, "_tie", "_own", "_slice", *(extra or {}),
        F.col("_e.at").alias("_at"), F.col("_e.phase").alias("_phase"),
        F.col("_e.d").alias("_d"), F.col("_e.row").alias("_row"),
    )


def _own_rows(entries: DataFrame, *values: Column) -> DataFrame:
    kept = entries.where((F.col("_phase") == 0) & (F.col("_slice") == F.col("_own")))
    return kept.select("_row.*", *values)


def rolling_count(df: DataFrame, keys, ts: str, span: int, out: str = "n", tie: str | None = None,
                  width: int | None = None, feeds: Column | None = None) -> DataFrame:
    """Rows of the key in ``[ts - span, ts]`` that came no later than this row.

    ``ts`` and ``span`` are integers of one unit. ``tie`` orders rows of the same instant. With
    ``feeds`` only such rows are counted, while all rows come back with the count.
    """
    keys, tie = _names(keys), tie or ts
    entries = _arrivals_and_expiries(df, keys, ts, span, tie, width or span * SLICES_PER_SPAN, feeds=feeds)
    w = (Window.partitionBy(*keys, "_slice").orderBy("_at", "_phase", "_tie")
         .rowsBetween(Window.unboundedPreceding, 0))
    return _own_rows(entries.withColumn("_n", F.sum("_d").over(w)),
                     F.col("_n").cast("bigint").alias(out))


def forward_count(df: DataFrame, keys, ts: str, span: int, out: str = "n",
                  tie: str | None = None, width: int | None = None) -> DataFrame:
    """Rows of the key in ``[ts, ts + span]`` from this row on: the rolling count of reversed time."""
    flipped = df.withColumn("_rev", -F.col(ts)).withColumn("_revtie", -F.col(tie or ts))
    counted = rolling_count(flipped, keys, "_rev", span, out, "_revtie", width)
    return counted.drop("_rev", "_revtie")


def rolling_distinct(df: DataFrame, keys, ts: str, value: str, span: int, out: str = "n",
                     tie: str | None = None, width: int | None = None, feeds: Column | None = None) -> DataFrame:
    """Distinct ``value`` of the key in ``[ts - span, ts]``.

    A value is present from an occurrence until ``span`` after it; an occurrence that falls inside
    the previous one's span prolongs the presence instead of starting another.
    """
    keys, tie = _names(keys), tie or ts
    width = width or span * SLICES_PER_SPAN
    counts = F.lit(True) if feeds is None else F.coalesce(feeds, F.lit(False))
    base = sliced(df.withColumn("_row", F.struct(*df.columns)).withColumn("_feeds", counts), ts, width, lookback=span)
    base = base.where(F.col("_feeds") | (F.col("_slice") == F.col("_own"))).repartition(*keys, "_slice")
    near = Window.partitionBy(*keys, "_slice", value, "_feeds").orderBy(ts, tie)
    fresh = F.coalesce(F.col(ts) - F.lag(ts).over(near) > span, F.lit(True))
    ends = F.coalesce(F.lead(ts).over(near) - F.col(ts) > span, F.lit(True))
    marked = base.withColumn("_fresh", (F.col("_feeds") & fresh).cast("int")).withColumn(
        "_ends", -(F.col("_feeds") & ends).cast("int"))
    entries = marked.select(
        *keys, "_own", "_slice", F.col(tie).alias("_tie"),
        _entries(ts, span, F.col("_fresh"), F.col("_ends")).alias("_e")).select(
        *keys, "_own", "_slice", "_tie", F.col("_e.at").alias("_at"),
        F.col("_e.phase").alias("_phase"), F.col("_e.d").alias("_d"), F.col("_e.row").alias("_row"))
    w = (Window.partitionBy(*keys, "_slice").orderBy("_at", "_phase", "_tie")
         .rowsBetween(Window.unboundedPreceding, 0))
    return _own_rows(entries.withColumn("_n", F.sum("_d").over(w)),
                     F.col("_n").cast("bigint").alias(out))


def rolling_entropy(df: DataFrame, keys, ts: str, value: str, span: int, out: str = "entropy",
                    tie: str | None = None, width: int | None = None) -> DataFrame:
    """Shannon entropy (bits) of ``value`` over the key's rows in ``[ts - span, ts]``.

    With ``c`` the count of each value and ``N`` their total, entropy is
    ``log2 N - (Σ c·log2 c) / N``; every arrival or expiry changes one ``c`` by one.
    """
    keys, tie = _names(keys), tie or ts
    entries = _arrivals_and_expiries(df, keys, ts, span, tie, width or span * SLICES_PER_SPAN,
                                     {"_value": F.col(value)}).repartition(*keys, "_slice")
    order = ("_at", "_phase", "_tie")
    per_value = (Window.partitionBy(*keys, "_slice", "_value").orderBy(*order)
                 .rowsBetween(Window.unboundedPreceding, 0))
    per_key = (Window.partitionBy(*keys, "_slice").orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, 0))

    def weight(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(0.0)

    c = F.col("_c")
    stepped = entries.withColumn("_c", F.sum("_d").over(per_value)).withColumn(
        "_step", weight(c) - weight(c - F.col("_d")))
    summed = stepped.withColumn("_n", F.sum("_d").over(per_key)).withColumn(
        "_s", F.sum("_step").over(per_key))
    n = F.col("_n").cast("double")
    return _own_rows(summed, F.greatest(F.lit(0.0), F.log2(n) - F.col("_s") / n).alias(out))


def recent_gap(df: DataFrame, keys, ts: str, max_gap: int, out: str = "gap", tie: str | None = None,
               width: int | None = None) -> DataFrame:
    """Distance to the key's previous row when it is at most ``max_gap``, else null."""
    keys, tie = _names(keys), tie or ts
    base = sliced(df, ts, width or max_gap * SLICES_PER_SPAN, lookback=max_gap)
    w = Window.partitionBy(*keys, "_slice").orderBy(ts, tie)
    gap = F.col(ts) - F.lag(ts).over(w)
    return (base.withColumn(out, gap).where(F.col("_slice") == F.col("_own"))
            .withColumn(out, F.when(F.col(out) <= max_gap, F.col(out))).drop("_own", "_slice"))


def first_after(events: DataFrame, keys, ts: str, span: int, is_probe: str, payload: Column,
                out: str, width: int | None = None) -> DataFrame:
    """For each probe row the oldest non-probe row of the key in ``[ts - span, ts]``.

    Every probe looks up from the start of its span: a marker at ``ts - span`` takes the first
    candidate at or after it, found as the last one met when reading the slice backwards.
    """
    keys = _names(keys)
    width = width or span * SLICES_PER_SPAN
    tagged = events.withColumn("_row", F.struct(*events.columns)).withColumn("_payload", payload)
    base = sliced(tagged, ts, width, lookback=span)
    probe = F.col(is_probe)
    at = F.when(probe, F.col(ts) - span).otherwise(F.col(ts))
    base = base.withColumn("_at", at).where(~probe | (F.col("_slice") == F.col("_own")))
    backwards = (Window.partitionBy(*keys, "_slice")
                 .orderBy(F.col("_at").desc(), probe.cast("int").asc())
                 .rowsBetween(Window.unboundedPreceding, 0))
    candidate = F.when(~probe, F.struct(F.col(ts).alias("at"), F.col("_payload").alias("hit")))
    found = base.withColumn("_found", F.last(candidate, ignorenulls=True).over(backwards))
    hits = found.where(probe & F.col("_found").isNotNull() & (F.col("_found.at") <= F.col(ts)))
    return hits.select("_row.*", F.col("_found.hit").alias(out))


def first_of_other(events: DataFrame, keys, ts: str, span: int, side: str, payload: Column, out: str,
                   width: int | None = None) -> DataFrame:
    """For each row the oldest row of the key on the other ``side`` (a flag) in ``[ts - span, ts]``.

    :func:`first_after` for both directions in one exchange and one sort: every row is a candidate, and a
    probe that looks up from the start of its span; reading backwards carries the last candidate of each side.
    """
    keys = _names(keys)
    base = sliced(events.withColumn("_payload", payload), ts, width or span * SLICES_PER_SPAN, lookback=span)

    # columns stay flat here: structs pruned through an explode and a window trip the optimizer
    own = F.col("_slice") == F.col("_own")
    probes = F.explode(F.when(own, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = base.withColumn("_probe", probes).withColumn("_at", F.col(ts) - F.col("_probe") * span)
    backwards = (Window.partitionBy(*keys, "_slice").orderBy(F.col("_at").desc(), F.col("_probe").asc())
                 .rowsBetween(Window.unboundedPreceding, 0))

    def last_on(flag: bool) -> Column:
        candidate = F.when((F.col("_probe") == 0) & (F.col(side) == flag), F.struct(F.col(ts).alias("at"), F.col("_payload").alias("hit")))
        return F.last(candidate, ignorenulls=True).over(backwards)

    found = rows.withColumns({"_true": last_on(True), "_false": last_on(False)}).where("_probe = 1").withColumn(
        "_found", F.when(F.col(side), F.col("_false")).otherwise(F.col("_true")))
    hits = found.where(F.col("_found").isNotNull() & (F.col("_found.at") <= F.col(ts)))
    return hits.select(*events.columns, F.col("_found.hit").alias(out))
