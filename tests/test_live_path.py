import json
import random

from pyspark.sql import functions as F

from flowloom.sources import sensor
from flowloom.streaming import live
from flowloom.streaming.path import LivePath, read_counts

START = 1_735_689_600


def line(i, second, kind, src, dst, port, packets):
    stamp = f"2025-01-01T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}.{i:06d}+0000"
    body = {"timestamp": stamp, "event_type": kind, "src_ip": src, "dest_ip": dst, "src_port": 1000 + i % 7, "dest_port": port, "proto": "TCP", "flow_id": i}
    if kind == "alert":
        body["alert"] = {"signature": f"sig {i % 3}", "signature_id": i % 3, "severity": 1 + i % 3}
    else:
        body["flow"] = {"pkts_toserver": packets, "pkts_toclient": 1, "bytes_toserver": 9, "bytes_toclient": 9, "start": stamp, "end": stamp}
    return json.dumps(body)


def lines(n, seed=3):
    rng = random.Random(seed)
    second = 0
    for i in range(n):
        second += rng.choice([0, 1, 1, 2, 90 if i % 40 == 0 else 3])
        yield line(i, second, rng.choice(["flow", "flow", "alert"]), f"10.0.0.{rng.randrange(4)}", f"9.9.9.{rng.randrange(5)}",
                   rng.choice([4444, 4445, 5001, 9001]), rng.randrange(100))


def path(spark, **options):
    n = F.lit(None)
    providers = spark.createDataFrame([(f"9.9.9.{i}", 5 * (i % 2)) for i in range(9)], "value string, vt bigint").withColumns({
        **{c: n.cast("bigint") for c in ("abuse", "pulses", "sandbox", "vulns")},
        **{c: n.cast("boolean") for c in ("new_domain", "known_good")}, "scanner": n.cast("string")})
    varied = F.when(F.round("dst_port_entropy", 6) > 1.4, 1.0).otherwise(0.0)
    return LivePath(lambda flows: flows.withColumn("anomaly_score", F.col("packets_sent") / 12 + varied),
                    limit=8, limit_us=60_000_000, providers=providers, **options)


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def streamed(spark, tmp_path, text, parts):
    src = tmp_path / f"log{parts}"
    src.mkdir()
    size = -(-len(text) // parts)
    import os
    for p in range(parts):
        (src / f"{p}.json").write_text("\n".join(text[p * size:(p + 1) * size]))
        os.utime(src / f"{p}.json", (START + p, START + p))  # files are taken in the order of their times
    out = str(tmp_path / f"out{parts}")
    query = path(spark).start(sensor.stream_events(spark, str(src), 1), out, str(tmp_path / f"cp{parts}"), {"availableNow": True})
    query.awaitTermination()
    assert query.exception() is None
    return out


def test_stream_equals_batch_over_micro_batches(spark, tmp_path):
    text = list(lines(500))
    whole = path(spark).tables(sensor.parse_lines(spark.createDataFrame([(x,) for x in text], "value string")))
    kinds = {r.what: r.n for r in whole["counts"].collect()}
    limit_met = whole["alerts"].count()
    assert kinds["flows"] > 250 and kinds["correlation"] > 5 and kinds["ml"] > 20 and kinds["suricata"] > 20
    feeds = path(spark, session_id="")
    assert limit_met < feeds.candidates(whole["scored"], feeds.hits(sensor.parse_lines(spark.createDataFrame([(x,) for x in text], "value string"))),
                                        spark.createDataFrame([], "ts_us bigint, anomaly_score double, signature string, flow_id bigint, src_ip string, dst_ip string, "
                                                                  "src_port int, dst_port int, protocol string")).count()
    out = streamed(spark, tmp_path, text, 3)
    scored = spark.read.parquet(f"{out}/scored").drop("batch")
    drift = scored.join(whole["scored"].select("flow_id", F.col("dst_port_entropy").alias("_e")), "flow_id")
    assert drift.where(F.abs(F.col("_e") - F.col("dst_port_entropy")) > 1e-9).isEmpty() and drift.count() == kinds["flows"]
    assert rows_of(live.read_alerts(spark, out)) == rows_of(whole["alerts"])
    assert {r.what: r.n for r in read_counts(spark, out).collect()} == kinds
    key = ["connection", "alerts", "severity", "sources", "first_ts_us", "last_ts_us", "confidence"]
    assert rows_of(live.read_incidents(spark, out).select(*key)) == rows_of(whole["incidents"].select(*key))


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    out, run = str(tmp_path / "out"), path(spark)
    batch = sensor.parse_lines(spark.createDataFrame([(x,) for x in lines(60)], "value string"))
    run.process(batch, 0, out)
    first = rows_of(live.read_alerts(spark, out))
    run.process(batch, 0, out)
    assert rows_of(live.read_alerts(spark, out)) == first and first


def test_no_events_no_intelligence_and_unknown_addresses(spark, tmp_path):
    out = str(tmp_path / "out")
    none = sensor.parse_lines(spark.createDataFrame([], "value string"))
    bare = LivePath(lambda flows: flows.withColumn("anomaly_score", F.lit(9.0)))
    bare.process(none, 0, out)
    assert live.read_alerts(spark, out).count() == 0
    assert {r.what: r.n for r in read_counts(spark, out).collect()} == {"flows": 0}
    odd = [line(1, 5, "flow", None, "9.9.9.1", 4444, 3), line(2, 6, "alert", None, None, 4444, 0), line(3, 7, "flow", "10.0.0.1", "1.2.3.4", 4444, 3)]
    bare.process(sensor.parse_lines(spark.createDataFrame([(x,) for x in odd], "value string")), 1, out)
    assert sorted(r.type for r in live.read_alerts(spark, out).collect()) == ["ml", "suricata"]
    assert {r.what: r.n for r in read_counts(spark, out).collect()} == {"flows": 1, "ml": 1, "suricata": 1}
