"""Idle flows of a stream over several micro-batches equal the batch form in all columns."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from flowloom.operators import flows as FL
from flowloom.streaming import idle, live


def test_states_merge_like_one():
    rng = np.random.default_rng(1)
    us, n = np.sort(rng.integers(0, 500, 60)), rng.integers(0, 90, 60)
    whole = idle.summed(us, n)
    for cut in (1, 17, 59):
        both = idle.merged(idle.summed(us[:cut], n[:cut]), idle.summed(us[cut:], n[cut:]))
        assert all(abs(both[k] - whole[k]) < 1e-6 for k in whole)


def test_stream_equals_batch(spark, tmp_path):
    rng, rows = random.Random(5), []
    for host in ("10.0.0.1", "10.0.0.2", "8.8.8.8"):
        at = dt.datetime(2026, 1, 1)
        for _ in range(80):
            at += dt.timedelta(milliseconds=rng.choice([0, 100, 1500, 4999, 5000, 9000]))
            rows.append((host, "1.2.3.4", 1, 443, "TCP", rng.randrange(90), at))
    rows.sort(key=lambda r: r[-1])
    rows.append(("9.9.9.9", "1.2.3.4", 1, 443, "TCP", 1, dt.datetime(2026, 1, 2)))  # moves the watermark beyond all
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, src_port int, dst_port int, protocol string, length bigint, time timestamp")
    for i in range(4):
        part = rows[i * 62:(i + 1) * 62]
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    flows = live.idle_flow_stream(stream, 5, "0 seconds")
    query = (flows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    assert query.exception() is None
    batch = FL.idle_flows(df).where("src_ip <> '9.9.9.9'")
    names = sorted(batch.columns)
    assert names == sorted(flows.columns)

    def told(frame):
        shown = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in frame.select(*names).dtypes]
        return sorted(tuple(r) for r in frame.select(*shown).collect())

    assert told(spark.read.schema(flows.schema).parquet(str(tmp_path / "out"))) == told(batch)
