"""Sensor lines are dealt out before they are built, their framing is looked at once, and only routed events are kept."""

import datetime
import itertools
import json

from pyspark.sql import functions as F

from flowloom import constants as K
from flowloom.functions import net
from flowloom.operators import whitelist as W
from flowloom.plans.adapters import Tables
from flowloom.plans.catalog import live
from flowloom.sources import sensor
from flowloom.streaming.path import LivePath

FRAMING = r"^\s*\[?\s*(?=[{\"])|(?<=[}\"])[\s,\]]+$"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_framing_is_taken_off_as_by_the_expression(spark):
    heads = ["", " ", "[", " [ ", "\t[\n", "[[", "x", " ", "]", "\x0b\f", "\xa0"]
    tails = ["", ",", " ,\r\n", "]", "},", "}}bad{", " x", " ", ", ", ",\u0085 ", ",\xa0", "],", "\"", "\n\n"]
    bodies = ["", "{}", '"{}"', '{"a":"ü]"}', "{", "}", '"', "[]", '{"a":1},{"a":2}', " ,]"]
    text = [(a + b + c,) for a, b, c in itertools.product(heads, bodies, tails)] + [(None,)]
    out = spark.createDataFrame(text, "value string").select(
        "value", sensor._bare(F.col("value")).alias("got"), F.regexp_replace("value", FRAMING, "").alias("want")).collect()
    assert [r for r in out if r.got != r.want] == [] and len(out) == len(text)


def test_a_line_is_searched_once(spark):
    lines = spark.createDataFrame([('{"event_type":"flow"},',), ('"{\\"event_type\\":\\"dns\\"}"',), ("[",), (None,)], "value string")
    parsed = sensor.parse_lines(lines)
    assert plan_of(parsed).count("(?<=") == 1
    assert sorted(r.event_type for r in parsed.collect()) == ["dns", "flow"]


def test_rows_are_dealt_out_before_their_lines_are_built(spark, tmp_path):
    start = datetime.datetime(2025, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=i), i % 7, "view", 1.5, json.dumps({"k": i % 90})) for i in range(180)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(
        1).write.parquet(str(tmp_path / "events.parquet"))
    t = Tables(spark, str(tmp_path))
    for tables in (t, live.stream_of(t, "events")):
        plan = plan_of(live.sensor_lines(tables)) if tables is t else live.sensor_lines(tables)._jdf.queryExecution().analyzed().toString()
        assert plan.index("Repartition") > max(plan.rindex(text) for text in ("date_format", "}}bad{"))
    kinds = {r.event_type: r["count"] for r in sensor.parse_lines(live.sensor_lines(t)).groupBy("event_type").count().collect()}
    names = ["flow", "alert", "dns", "http", "tls", "anomaly"]
    assert kinds == {n: sum(i % 6 == j and i % 45 != 4 for i in range(180)) for j, n in enumerate(names)}


def test_only_flows_and_alerts_are_kept_for_both_readers(spark, tmp_path):
    kept = []

    class Watched(LivePath):
        def flows(self, events):
            kept.extend(r.event_type for r in events.select("event_type").distinct().collect())
            return super().flows(events)

    stamp = "2025-01-01T00:00:01.000000+0000"
    text = [json.dumps({"timestamp": stamp, "event_type": kind, "src_ip": "10.0.0.1", "dest_ip": "9.9.9.9", "flow_id": 1,
                        "alert": {"signature": "s", "signature_id": 1, "severity": 1}}) for kind in ("flow", "alert", "dns", "http", "stats", None)]
    run = Watched(lambda flows: flows.withColumn("anomaly_score", F.lit(9.0)))
    run.process(sensor.parse_lines(spark.createDataFrame([(x,) for x in text], "value string")), 0, str(tmp_path / "out"))
    assert sorted(kept) == ["alert", "flow"]


def test_reasons_keep_their_order_of_precedence(spark):
    ends = ["10.0.0.1", "9.9.9.9", "224.0.0.1", "fe80::1", "2606:4700::1", "", None, "host"]
    rows = [(a, b, port, proto, cdn, listed) for a, b, port, proto, cdn, listed in itertools.product(
        ends, ends, [sorted(K.LAN_SERVICE_PORTS)[0], 443, None],
        ["UDP", None], [True, False], [True, False])]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, dst_port int, protocol string, is_cdn boolean, is_whitelisted boolean")
    src, dst = F.col("src_ip"), F.col("dst_ip")
    want = F.coalesce(
        F.when(net.is_local_only(src, dst), "local-only endpoints"), F.when(net.is_internal_ip(dst), "internal destination"),
        F.when(F.col("is_cdn"), "known CDN endpoint"),
        F.when(net.is_lan_service(dst, F.col("dst_port"), F.col("protocol")), "LAN service traffic"),
        F.when(F.col("is_whitelisted"), "whitelisted flow"))
    out = df.select(W.suppress_reason().alias("got"), want.alias("want")).collect()
    assert all(r.got == r.want for r in out) and len({r.want for r in out}) == 5
