"""Idle flows on a stream, with the statistics of the gaps between their packets.

State per flow are counts, extremes and the moments (count, mean, sum of squared deviations) of lengths
and gaps, which merge. A micro-batch's packets of a flow are sorted, cut where the flow was idle, summed
with numpy and merged into the state; an event-time timer ends a flow whose idle time has passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions import net
from flowloom.session import ship

KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
_STATE = ["start", "stop", "bytes", "len_min", "len_max", "len_n", "len_mean", "len_m2", "gap_n", "gap_mean", "gap_m2", "gap_min", "gap_max"]
_WHOLE = {"start", "stop", "bytes", "len_min", "len_max", "len_n", "gap_n", "gap_min", "gap_max"}
STATE = ", ".join(f"{n} {'BIGINT' if n in _WHOLE else 'DOUBLE'}" for n in _STATE)


def _moments(values: np.ndarray) -> tuple[int, float, float]:
    if not len(values):
        return 0, 0.0, 0.0
    mean = float(values.mean())
    return len(values), mean, float(((values - mean) ** 2).sum())


def _joined(a: tuple, b: tuple) -> tuple[int, float, float]:
    """Moments of two sets together."""
    n = a[0] + b[0]
    if not n:
        return 0, 0.0, 0.0
    step = b[1] - a[1]
    return n, a[1] + step * b[0] / n, a[2] + b[2] + step * step * a[0] * b[0] / n


def summed(us: np.ndarray, lengths: np.ndarray) -> dict:
    """State of packets in time order; only gaps above zero count."""
    gaps = np.diff(us)
    gaps = gaps[gaps > 0]
    len_n, len_mean, len_m2 = _moments(lengths.astype(np.float64))
    gap_n, gap_mean, gap_m2 = _moments(gaps.astype(np.float64))
    return dict(zip(_STATE, (int(us[0]), int(us[-1]), int(lengths.sum()), int(lengths.min()), int(lengths.max()), len_n, len_mean, len_m2,
                             gap_n, gap_mean, gap_m2, int(gaps.min()) if gap_n else 0, int(gaps.max()) if gap_n else 0)))


def merged(a: dict, b: dict) -> dict:
    """State of two parts of a flow, ``b`` after ``a``; the gap between them counts."""
    out = {"start": min(a["start"], b["start"]), "stop": max(a["stop"], b["stop"]), "bytes": a["bytes"] + b["bytes"],
           "len_min": min(a["len_min"], b["len_min"]), "len_max": max(a["len_max"], b["len_max"])}
    between = b["start"] - a["stop"]
    parts = [s for s in (a, b) if s["gap_n"]]
    if between > 0:
        parts.append({"gap_n": 1, "gap_mean": float(between), "gap_m2": 0.0, "gap_min": between, "gap_max": between})
    total = (0, 0.0, 0.0)
    for part in parts:
        total = _joined(total, (part["gap_n"], part["gap_mean"], part["gap_m2"]))
    lengths = _joined(*((s["len_n"], s["len_mean"], s["len_m2"]) for s in (a, b)))
    return out | dict(zip(("len_n", "len_mean", "len_m2"), lengths)) | dict(zip(("gap_n", "gap_mean", "gap_m2"), total)) | {
        "gap_min": min((p["gap_min"] for p in parts), default=0), "gap_max": max((p["gap_max"] for p in parts), default=0)}


def stream_idle_flows(packets: DataFrame, idle_seconds: float = 5, mirror: bool = True) -> DataFrame:
    """The columns of :func:`flowloom.operators.flows.idle_flows` for a stream with a watermark on ``time``.

    Packets of a flow are expected in time order from batch to batch up to the watermark.
    """
    ship(packets.sparkSession)
    idle = int(idle_seconds * 1e6)
    fields = {f.name: f.dataType.simpleString() for f in packets.schema}
    out = ", ".join(f"{k} {fields[k]}" for k in KEY) + ", " + STATE

    def closed(key: tuple, held: list[dict]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *(h[n] for n in _STATE)) for h in held], columns=[*KEY, *_STATE])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = dict(zip(_STATE, state.get))
            state.remove()
            yield closed(key, [held])
            return
        frames = list(batches)
        us = np.concatenate([f["_us"].to_numpy(np.int64) for f in frames])
        lengths = np.concatenate([f["length"].fillna(0).to_numpy(np.int64) for f in frames])
        order = np.argsort(us, kind="stable")
        us, lengths = us[order], lengths[order]
        cuts = np.flatnonzero(np.diff(us) >= idle) + 1
        parts = [summed(u, n) for u, n in zip(np.split(us, cuts), np.split(lengths, cuts))]
        if state.exists:
            before = dict(zip(_STATE, state.get))
            near = parts[0]["start"] - before["stop"] < idle
            parts = [merged(before, parts[0]), *parts[1:]] if near else [before, *parts]
        last = parts.pop()
        state.update(tuple(last[n] for n in _STATE))
        # a timer has to lie beyond the watermark
        state.setTimeoutTimestamp(max((last["stop"] + idle) // 1000, state.getCurrentWatermarkMs() + 1))
        if parts:
            yield closed(key, parts)

    rows = packets.where((F.col("src_ip") != "") & (F.col("dst_ip") != "")).select(
        *KEY, "time", F.unix_micros("time").alias("_us"), F.col("length").cast("bigint").alias("length"))
    flows = rows.groupBy(*KEY).applyInPandasWithState(step, out, STATE, "append", "EventTimeTimeout")
    return _shown(flows, mirror)


def _shown(flows: DataFrame, mirror: bool) -> DataFrame:
    def seconds(name: str):
        return F.col(name) / 1e6

    def deviation(prefix: str):
        return F.when(F.col(f"{prefix}_n") > 0, F.sqrt(F.col(f"{prefix}_m2") / F.col(f"{prefix}_n"))).otherwise(0.0)

    received = (F.col("len_n"), F.col("bytes")) if mirror else (F.lit(0), F.lit(0))
    return flows.select(
        *KEY, F.col("len_n").alias("packets_sent"), F.col("bytes").alias("bytes_sent"), F.col("len_min").alias("pkt_len_min"),
        F.col("len_max").alias("pkt_len_max"), deviation("len").alias("pkt_len_std"), F.timestamp_micros("start").alias("start_time"),
        F.timestamp_micros("stop").alias("end_time"), seconds("gap_mean").alias("iat_mean"), (deviation("gap") / 1e6).alias("iat_std"),
        seconds("gap_max").alias("iat_max"), seconds("gap_min").alias("iat_min"), (F.col("gap_n") * F.col("gap_mean") / 1e6).alias("fwd_iat_total"),
        F.floor((F.col("stop") - F.col("start")) / 1000).cast("bigint").alias("duration_ms"), received[0].cast("bigint").alias("packets_recv"),
        received[1].cast("bigint").alias("bytes_recv"), seconds("gap_mean").alias("fwd_iat_mean"), net.is_external_ip(F.col("dst_ip")).alias("is_external_dst"))
