"""Alert rows, filters, rate limits and push payloads."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions import values
from flowloom.session import ship, stored


def _alert_id(kind: str, session_id: str, *parts: str) -> Column:
    """The kind, the session and what tells the alert apart from others of its moment."""
    told = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    return F.concat_ws("-", F.lit(kind), F.nullif(F.lit(session_id), F.lit("")), F.substring(F.sha2(told, 256), 1, 20))


_CONNECTION = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")


def anomaly_alerts(scored: DataFrame, threshold: float = 5.0, session_id: str = "", at_us: str | None = None) -> DataFrame:
    """Alert rows of flagged flows that nothing suppresses, at the flow's start or the time in column ``at_us``."""
    flagged = scored.where((F.col("anomaly_score") >= threshold) & F.col("suppress_reason").isNull())
    explanation = F.col("explanation") if "explanation" in scored.columns else F.lit("")
    return flagged.select(
        _alert_id("ml", session_id, "flow_id", "start_time", *_CONNECTION).alias("id"), F.lit(session_id).alias("session_id"),
        F.lit("ml").alias("type"), (F.col(at_us) if at_us else F.unix_micros("start_time")).alias("ts_us"),
        values.alert_severity(F.col("anomaly_score"), threshold).alias("severity"), "anomaly_score",
        explanation.alias("explanation"), "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
        F.col("packets_sent").alias("total_fwd_packets"), F.col("packets_recv").alias("total_bwd_packets"),
        F.col("bytes_sent").alias("total_fwd_bytes"), F.col("bytes_recv").alias("total_bwd_bytes"),
        F.col("duration_ms").alias("flow_duration"), "flow_id")


def signature_alerts(hits: DataFrame, session_id: str = "") -> DataFrame:
    category = F.coalesce("category", F.lit(""))
    text = F.concat(F.lit("Signature hit: "), "signature",
                    F.when(category != "", F.concat(F.lit(" ("), category, F.lit(")"))).otherwise(""))
    return hits.select(
        _alert_id("sig", session_id, "signature_id", "signature", "ts_us", *_CONNECTION).alias("id"),
        F.lit(session_id).alias("session_id"), F.lit("suricata").alias("type"), "ts_us",
        F.coalesce("severity", F.lit("medium")).alias("severity"), "signature", "signature_id",
        category.alias("category"), text.alias("explanation"),
        "src_ip", "dst_ip", "src_port", "dst_port", "protocol")


def correlation_alerts(matches: DataFrame, session_id: str = "") -> DataFrame:
    text = F.concat(F.lit("Signature '"), "signature", F.lit("' and an anomaly (score "),
                    F.col("anomaly_score").cast("string"), F.lit(") on the same host pair"))
    return matches.select(
        _alert_id("corr", session_id, "flow_id", "signature", "ts_us", *_CONNECTION).alias("id"), F.lit(session_id).alias("session_id"),
        F.lit("correlation").alias("type"), "ts_us", F.lit("critical").alias("severity"), "anomaly_score",
        "signature", text.alias("explanation"), "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "flow_id")


def all_alerts(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def filter_alerts(alerts: DataFrame, since_us: int | None = None, severities: list[str] | None = None,
                  types: list[str] | None = None) -> DataFrame:
    out = alerts
    if since_us is not None:
        out = out.where(F.col("ts_us") > since_us)
    if severities:
        out = out.where(F.lower("severity").isin(*[s.lower() for s in severities]))
    if types:
        out = out.where(F.lower("type").isin(*[t.lower() for t in types]))
    return out


def find_alert(alerts: DataFrame, alert_id: str) -> DataFrame:
    return alerts.where((F.col("id") == alert_id) | (F.col("finding_id") == alert_id))


def alert_counts(alerts: DataFrame, since_us: int = 0) -> DataFrame:
    """Alerts after a time by type and severity."""
    kind, sev = F.lower(F.coalesce("type", F.lit(""))), F.lower(F.coalesce("severity", F.lit("unknown")))
    return alerts.where(F.col("ts_us") > since_us).groupBy(sev.alias("severity")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(kind == "ml").alias("ml"),
        F.count_if(kind == "suricata").alias("signature"))


def patched(log: DataFrame, keys: list[str], version: str, columns: list[str]) -> DataFrame:
    """Current view of an append-only alert log with later patches."""
    from flowloom.operators.intel import latest_by_column

    return latest_by_column(log, keys, version, columns)


# ---- rate limits ---------------------------------------------------------------------------

def cap_per_window(alerts: DataFrame, keys: list[str], ts_us: str, limit: int, window_us: int = 60_000_000,
                   tie: str = "id") -> DataFrame:
    """First ``limit`` alerts per key and fixed window: the declarative form of the limit."""
    bucket = F.floor(F.col(ts_us) / window_us)
    w = Window.partitionBy(*keys, bucket).orderBy(ts_us, tie)
    return alerts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def greedy_admit(times, limit: int, window_us: int, recent: deque | None = None) -> tuple[list[bool], deque]:
    """Admit while fewer than ``limit`` admissions lie in the trailing window; refusals do not count."""
    recent = deque() if recent is None else recent
    verdicts = []
    for t in times:
        while recent and recent[0] < t - window_us:
            recent.popleft()
        ok = len(recent) < limit
        if ok:
            recent.append(t)
        verdicts.append(ok)
    return verdicts, recent


WINDOWS_PER_SLICE = 24


def _limited(rows: DataFrame, session: str, ts_us: str, tie: str, limit: int, window_us: int, slice_us: int,
             names: list[str] | None = None) -> DataFrame:
    """Run the limiter over each slice on its own, its rows sorted by Spark and streamed with ``limit`` times of state.

    Rows flagged ``_before`` count as admitted. Gives the admitted rows' ``names``, or without them each
    slice's state at its end: the admissions that the next slice still sees.
    """
    ship(rows.sparkSession)
    kind = rows.schema[session].dataType.simpleString()
    schema = rows.select(*names).schema if names else f"{session} {kind}, _slot bigint, _out array<bigint>"
    ordered = rows.repartition(session, "_slot").sortWithinPartitions(session, "_slot", F.desc("_before"), ts_us, tie)

    def admit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent, ended = None, deque(), []

        def close():
            if current is not None:
                end = (current[1] + 1) * slice_us
                ended.append((*current, [t for t in recent if t >= end - window_us]))

        for pdf in batches:
            keep = []
            for key, slot, t, before in zip(pdf[session], pdf["_slot"], pdf[ts_us], pdf["_before"]):
                if (key, slot) != current:
                    close()
                    current, recent = (key, slot), deque()
                if before:
                    recent.append(t)
                    keep.append(False)
                else:
                    verdict, recent = greedy_admit([t], limit, window_us, recent)
                    keep.append(verdict[0])
            if names:
                yield pdf.loc[keep, names]
            elif len(ended) >= 10_000:
                yield pd.DataFrame(ended, columns=[session, "_slot", "_out"])
                ended = []
        close()
        if not names and ended:
            yield pd.DataFrame(ended, columns=[session, "_slot", "_out"])

    return ordered.mapInPandas(admit, schema)


def greedy_cap(alerts: DataFrame, session: str, ts_us: str, limit: int, window_us: int = 60_000_000,
               tie: str = "id", admitted: str | None = None, slice_us: int = 3_600_000_000) -> DataFrame:
    """Greedy trailing-window limit per session.

    ``admitted`` names a flag of rows that passed earlier (the last window of a stream); they count
    but are not returned.

    Each decision depends on the ones before it. A session's timeline is cut into slices that run in
    parallel, each from an empty limiter, and those whose predecessor ended in another state than they
    began with run again from it, until all states meet. A silence longer than the window empties the
    limiter, so a wrong beginning reaches no further than the next one; without any silence the repair
    moves on by a slice a round, for all sessions at once. No task holds more than slices, and a slice is
    streamed. A slice holds at least ``WINDOWS_PER_SLICE`` windows, so only the one before it matters and most
    slices see a silence or meet the same admissions whatever they began with.
    """
    slice_us = max(slice_us, WINDOWS_PER_SLICE * window_us)
    before = F.coalesce(F.col(admitted), F.lit(False)) if admitted else F.lit(False)
    rows = alerts.withColumns({"_slot": F.floor(F.col(ts_us) / slice_us).cast("bigint"), "_before": before})
    narrow = stored(rows.select(session, "_slot", F.col(ts_us).cast("bigint").alias(ts_us), tie, "_before"), "limited")
    none = F.array().cast("array<bigint>")

    def beginnings(states: DataFrame, name: str) -> DataFrame:
        """What a slice begins with, as rows that passed before it."""
        return states.select(session, "_slot", F.explode(name).alias(ts_us)).withColumn("_before", F.lit(True))

    def run(part: DataFrame) -> DataFrame:
        return _limited(part, session, ts_us, tie, limit, window_us, slice_us)

    states = stored(run(narrow).withColumn("_in", none), "limiter")
    while True:
        lead = states.select(F.col(session).alias("_session"), (F.col("_slot") + 1).alias("_next"), F.col("_out").alias("_lead"))
        met = states.join(lead, F.col(session).eqNullSafe(F.col("_session")) & (F.col("_slot") == F.col("_next")), "left").select(
            session, "_slot", "_in", "_out", F.coalesce("_lead", none).alias("_lead"))
        stale = stored(met.where(F.col("_in") != F.col("_lead")).select(session, "_slot", "_lead"), "limiter")
        if stale.isEmpty():
            break
        keys = stale.select(F.col(session).alias("_session"), F.col("_slot").alias("_wanted"), "_lead")
        same = F.col(session).eqNullSafe(F.col("_session")) & (F.col("_slot") == F.col("_wanted"))
        again = run(narrow.join(keys, same, "left_semi").unionByName(beginnings(stale, "_lead"), allowMissingColumns=True))
        fixed = again.join(keys, same).select(session, "_slot", "_out", F.col("_lead").alias("_in"))
        states = stored(states.join(keys, same, "left_anti").unionByName(fixed), "limiter")
    names = [n for n in alerts.columns if n != admitted]
    whole = rows.unionByName(beginnings(states, "_in"), allowMissingColumns=True)
    return _limited(whole, session, ts_us, tie, limit, window_us, slice_us, names)


# ---- push ----------------------------------------------------------------------------------

def passes_filters(severities: list[str], sources: list[str], ai_statuses: list[str]) -> Column:
    """The push filter: each list holds lower-case names or ``all``."""
    kind = F.lower(F.coalesce("type", F.lit("ml")))

    def allowed(value: Column, names: list[str]) -> Column:
        return F.lit(True) if "all" in names else value.isin(*names)

    status = F.lower(F.coalesce("ai_status", F.lit("open")))
    return (allowed(F.lower(F.coalesce("severity", F.lit("medium"))), severities) & allowed(kind, sources)
            & ((kind != "llm") | allowed(status, ai_statuses)))


def alert_title() -> Column:
    """One line per kind of alert: a label and the field that says most."""
    score = F.coalesce(F.col("anomaly_score").cast("string"), F.lit("unknown"))
    rule = F.coalesce("signature", F.lit("unnamed rule"))
    lines = {
        "suricata": [F.lit("Rule matched"), rule],
        "correlation": [F.lit("Rule and outlier agree"), rule, score],
        "llm": [F.lit("Model verdict"), F.coalesce("ai_status", F.lit("open")), F.coalesce("attack_type", F.lit("unnamed attack"))],
    }
    kind, line = F.lower(F.coalesce("type", F.lit("ml"))), F.concat_ws(": ", F.lit("Outlier flow"), score)
    for name, parts in lines.items():
        line = F.when(kind == name, F.concat_ws(": ", *parts)).otherwise(line)
    return line


def push_payloads(alerts: DataFrame, severities=("all",), sources=("all",), ai_statuses=("all",)) -> DataFrame:
    """Filtered alerts with title and JSON payload, ready for a caller's delivery function."""
    def shown(name: str, default: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(default))

    severity = F.upper(F.coalesce("severity", F.lit("medium")))
    connection = F.concat(shown("src_ip", "?"), F.lit(":"), shown("src_port", "*"), F.lit(" → "),
                          shown("dst_ip", "?"), F.lit(":"), shown("dst_port", "*"),
                          F.lit(" ("), shown("protocol", "?"), F.lit(")"))
    kept = alerts.where(passes_filters(list(severities), list(sources), list(ai_statuses)))
    payload = F.struct(
        F.concat(F.lit("**"), severity, F.lit("** — "), alert_title()).alias("content"),
        F.substring(alert_title(), 1, 256).alias("title"),
        F.substring(F.coalesce("explanation", F.lit("")), 1, 1000).alias("description"),
        connection.alias("connection"), severity.alias("severity"), F.upper("type").alias("source"))
    return kept.select("id", alert_title().alias("title"), F.to_json(payload).alias("payload"))


def compact_event(fields: list[str], info: str = "info", info_len: int = 160, budget: int = 900) -> Column:
    """Listed fields as JSON without nulls; the text is shown to ``info_len`` and left out where it exceeds the budget."""
    short = F.substring(F.coalesce(info, F.lit("")), 1, info_len)
    whole = F.to_json(F.struct(*fields, F.when(short != "", short).alias("info")))
    return F.when(F.length(whole) <= budget, whole).otherwise(F.to_json(F.struct(*fields)))
