"""Sensor event logs: parsing, mapping to flows, alerts and display rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions import net, values
from flowloom.schemas import SENSOR_EVENT


_BLANK = " \t\n\x0b\f\r"


def _bare(line: Column) -> Column:
    """A line without the framing of an array: an opening bracket, and what follows the record's end.

    Trimming does it for lines that end with a record; the regular expression, which looks at every
    character, is left for the others.
    """
    pattern = r"^\s*\[?\s*(?=[{\"])|(?<=[}\"])[\s,\]]+$"
    ended = F.rtrim(line, F.lit(_BLANK + ",]"))
    plain = ended.startswith("{") | ended.startswith('"')
    return (F.when(~(ended.endswith("}") | ended.endswith('"')), F.regexp_replace(line, pattern, ""))
            .when(plain, ended).otherwise(F.regexp_replace(ended, r"^\s*\[?\s*(?=[{\"])", "")))


def parse_lines(lines: DataFrame, column: str = "value", schema: str = SENSOR_EVENT) -> DataFrame:
    """Events from text lines, batch or stream.

    Takes plain JSON lines, the lines of a JSON array (framing brackets and trailing commas) and
    JSON packed into a JSON string. Lines that hold no event are skipped.
    """
    lines, bare = lines.select(_bare(F.col(column)).alias("_bare")), F.col("_bare")
    quoted = F.get_json_object(F.concat(F.lit('{"s":'), bare, F.lit("}")), "$.s")
    text = F.when(bare.startswith('"'), quoted).otherwise(bare)
    # As part of an array, a record followed by anything but another record fails to parse, and a
    # failed line explodes to nothing; a whole array on one line gives all its events.
    record = T.ArrayType(T.DataType.fromDDL(schema))
    parsed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), record)
    return lines.select(F.explode(parsed).alias("e")).where(F.col("e").isNotNull()).select("e.*")


def read_events(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Events of a log folder. ``multi_line`` is for files that are one array or pretty-printed objects."""
    if multi_line:
        return spark.read.option("multiLine", "true").schema(SENSOR_EVENT).json(path)
    return parse_lines(spark.read.text(path))


def stream_events(spark: SparkSession, path: str, max_files: int = 16) -> DataFrame:
    """Events of rotated log files as they appear; the checkpoint remembers what was read."""
    lines = spark.readStream.option("maxFilesPerTrigger", str(max_files)).text(path)
    return parse_lines(lines)


def tail(events: DataFrame, n: int, by: str, tie: str) -> DataFrame:
    return events.orderBy(F.desc(by), F.asc(tie)).limit(n)


def event_type_counts(events: DataFrame) -> DataFrame:
    kind = F.coalesce("event_type", F.lit("unknown"))
    return events.agg(
        F.count_if(kind == "flow").alias("flow_events"), F.count_if(kind == "alert").alias("alert_events"),
        F.count_if(~kind.isin("flow", "alert")).alias("other_events"))


def _text(name: str, default: str = "") -> Column:
    return F.coalesce(F.when(F.col(name) != "", F.col(name)), F.lit(default))


def _int(*names: str) -> Column:
    return F.coalesce(*[F.when(F.col(n) != 0, F.col(n)) for n in names], F.lit(0)).cast("bigint")


def _ends() -> list[Column]:
    return [_text("src_ip").alias("src_ip"), F.coalesce(F.when(F.col("dest_ip") != "", F.col("dest_ip")), F.col("dst_ip"),
            F.lit("")).alias("dst_ip"), _int("src_port").alias("src_port"), _int("dest_port", "dst_port").alias("dst_port")]


def to_flows(events: DataFrame) -> DataFrame:
    """Flow rows of the sensor's flow events; events without a source are left out.

    ``logged_us`` is when the sensor wrote the event, which is after the flow's end.
    """
    start = values.parse_time(F.coalesce("flow.start", "timestamp"))
    end = values.parse_time(F.coalesce("flow.end", "timestamp"))
    flows = events.where((F.col("event_type") == "flow") & (F.coalesce("src_ip", F.lit("")) != ""))
    ms = F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000).cast("bigint")

    def seen(flag: str) -> Column:
        return F.when(F.col(f"tcp.{flag}").isNotNull(), F.col(f"tcp.{flag}").cast("bigint"))

    mapped = flows.select(
        F.coalesce("flow_id", "tx_id").alias("flow_id"), *_ends(), F.upper(_text("proto", "TCP")).alias("protocol"),
        start.alias("start_time"), end.alias("end_time"), F.unix_micros(values.parse_time(F.col("timestamp"))).alias("logged_us"), F.greatest(F.lit(0), F.coalesce(ms, F.lit(0))).alias("duration_ms"),
        _int("flow.bytes_toserver").alias("bytes_sent"), _int("flow.bytes_toclient").alias("bytes_recv"),
        _int("flow.pkts_toserver").alias("packets_sent"), _int("flow.pkts_toclient").alias("packets_recv"),
        F.coalesce("flow.mean_delta", F.lit(0.0)).alias("iat_mean"), F.lit(0.0).alias("iat_std"), F.lit(0.0).alias("iat_max"),
        F.lit(0.0).alias("fwd_iat_mean"), seen("syn").alias("syn_count"), seen("fin").alias("fin_count"),
        seen("rst").alias("rst_count"))
    return mapped.withColumn("is_external_dst", net.is_external_ip(F.col("dst_ip")))


def to_alerts(events: DataFrame) -> DataFrame:
    """Alert rows of the sensor's signature hits; an empty signature is no alert."""
    name = F.trim(F.col("alert.signature"))
    return events.where((F.col("event_type") == "alert") & (F.coalesce(name, F.lit("")) != "")).select(
        name.alias("signature"), F.col("alert.signature_id").alias("signature_id"), _text("alert.category").alias("category"),
        values.signature_severity(F.col("alert.severity"), "alert").alias("severity"), _text("alert.action").alias("action"),
        *_ends(), F.upper(_text("proto", "TCP")).alias("protocol"), _text("app_proto").alias("app_proto"),
        values.parse_time(F.col("timestamp")).alias("time"))


def to_display(events: DataFrame, info_chars: int = 120) -> DataFrame:
    """Any event as the eleven-column display row; events without a type and addresses are left out.

    Severity is told from the whole text; the row shows ``info_chars`` of web, name and other texts.
    """
    kind = _text("event_type", "unknown")
    base = events.select("*", *[c.alias(f"_{n}") for c, n in zip(_ends(), ("src", "dst", "sport", "dport"))],
                         kind.alias("_kind"), F.upper(_text("proto", "—")).alias("_proto"))
    app = _text("app_proto")
    total = _int("flow.bytes_toserver") + _int("flow.bytes_toclient")
    packets = _int("flow.pkts_toserver") + _int("flow.pkts_toclient")
    state = F.coalesce(F.when(app != "", app), F.when(F.col("flow.state") != "", F.col("flow.state")))
    flow_info = F.concat_ws(" · ", F.lit("Flow end"), F.concat(packets.cast("string"), F.lit(" pkts")),
                            F.concat(total.cast("string"), F.lit(" B")), state)
    query = F.coalesce(F.when(F.col("dns.rrname") != "", F.col("dns.rrname")), F.when(F.col("dns.type") != "", F.col("dns.type")), F.lit("DNS"))
    dns_info = F.concat(F.lit("DNS "), F.coalesce("dns.type", F.lit("query")), F.lit(": "), query)
    method = F.coalesce(F.when(F.col("http.http_method") != "", F.col("http.http_method")), F.when(F.col("http.method") != "", F.col("http.method")), F.lit("HTTP"))
    http_info = F.trim(F.concat(method, F.lit(" "), _text("http.hostname"), _text("http.url")))
    server = F.coalesce(F.when(F.col("tls.sni") != "", F.col("tls.sni")), F.when(F.col("tls.subject") != "", F.col("tls.subject")), F.lit("TLS handshake"))
    listed = kind.isin("anomaly", "drop", "ssh", "smtp", "ftp", "fileinfo", "stats")
    other_info = F.trim(F.concat(kind, F.lit(": "), F.coalesce(F.when(app != "", app), F.col("reason"), F.lit(""))))

    def choose(default, **by_kind) -> Column:
        out = None
        for name, value in by_kind.items():
            cond = F.col("_kind") == name
            out = F.when(cond, value) if out is None else out.when(cond, value)
        return out.when(listed, default[0]).otherwise(default[1])

    info = choose((other_info, F.concat(F.col("_kind"), F.lit(" event"))),
                  alert=_text("alert.signature", "Suricata alert"), flow=flow_info, dns=dns_info,
                  http=http_info, tls=server)
    shown = F.when(listed | F.col("_kind").isin("http", "tls"), F.left("_info", F.lit(info_chars))).otherwise(F.col("_info"))
    rows = base.withColumn("_info", info)
    internal = net.is_internal_ip(F.col("_dst"))
    port_class = net.packet_severity(F.col("_dst"), F.col("_dport"), F.when(F.col("_kind") == "http", "TCP").otherwise(F.col("_proto")), F.col("_info"))
    severity = choose((F.when(kind.isin("anomaly", "drop"), "medium").otherwise("info"), F.lit("info")),
                      alert=values.signature_severity(F.col("alert.severity"), "display"), flow=port_class,
                      dns=F.when(query.endswith(".local") | query.endswith(".arpa"), "info").otherwise("medium"),
                      http=port_class, tls=F.when(internal, "info").otherwise("medium"))
    protocol = F.when(F.col("_kind").isin("dns", "http", "tls"), F.upper("_kind")).otherwise(F.col("_proto"))
    length = F.when(F.col("_kind") == "alert", _int("pkt_len")).when(F.col("_kind") == "flow", total).otherwise(0).cast("bigint")
    known = listed | F.col("_kind").isin("alert", "flow", "dns", "http", "tls") | (F.col("_src") != "") | (F.col("_dst") != "")
    return rows.where(known).select(
        values.parse_time(F.col("timestamp")).alias("time"), F.col("_src").alias("src_ip"), F.col("_dst").alias("dst_ip"),
        F.col("_sport").alias("src_port"), F.col("_dport").alias("dst_port"), protocol.alias("protocol"), length.alias("length"),
        shown.alias("info"), severity.alias("severity"), F.col("_kind").alias("event_type"), F.lit("suricata").alias("source"))


def routed(events: DataFrame) -> DataFrame:
    """The events that :func:`to_flows` and :func:`to_alerts` read."""
    return events.where(F.col("event_type").isin("flow", "alert"))


def route(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two typed branches of one event stream: flows and alerts."""
    return to_flows(events), to_alerts(events)
