"""Packets to bidirectional flows and observables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions import net, text
from flowloom.operators.slices import recent_gap

KEY = ["file", "lo_ip", "lo_port", "hi_ip", "hi_port", "protocol"]
ROWS_PER_SLICE = 5_000_000


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Add the direction-free key: both directions of a conversation share it. ICMP has no ports."""
    icmp = F.col("protocol") == "ICMP"
    sport = F.when(icmp, 0).otherwise(F.col("src_port")).cast("bigint")
    dport = F.when(icmp, 0).otherwise(F.col("dst_port")).cast("bigint")
    src_first = (F.col("src_ip") < F.col("dst_ip")) | (
        (F.col("src_ip") == F.col("dst_ip")) & (sport <= dport))
    return packets.withColumns({
        "src_port": sport, "dst_port": dport,
        "lo_ip": F.when(src_first, F.col("src_ip")).otherwise(F.col("dst_ip")),
        "lo_port": F.when(src_first, sport).otherwise(dport),
        "hi_ip": F.when(src_first, F.col("dst_ip")).otherwise(F.col("src_ip")),
        "hi_port": F.when(src_first, dport).otherwise(sport),
    })


def _side() -> Column:
    """Who counts as the sender: ICMP packets of a conversation all count as forward."""
    return F.when(F.col("protocol") == "ICMP", "*").otherwise(F.col("src_ip"))


def _in_slices(packets: DataFrame, rows_per_slice: int) -> DataFrame:
    """Packets with the gaps inside their flow's slice of file positions.

    A flow may hold much of a capture, so its packets are cut into slices of ``seq``. ``_opens`` marks
    the first packet of a slice and ``_opens_side`` the first of its sender; their gaps come from
    earlier slices and are filled in by the callers. One sort gives everything.
    """
    keyed = packets if "lo_ip" in packets.columns else with_flow_key(packets)
    rows = keyed.withColumns({"_slice": F.floor(F.col("seq") / rows_per_slice).cast("bigint"), "_side": _side()})
    order = Window.partitionBy(*KEY, "_slice").orderBy("seq")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)

    def last_of(side: Column) -> Column:
        return F.last(F.when(side, F.col("ts")), ignorenulls=True).over(earlier)

    low = F.col("_side") == F.col("lo_ip")
    own = rows.withColumns({
        "gap": F.col("ts") - F.lag("ts").over(order), "_opens": F.row_number().over(order) == 1,
        "_before_low": last_of(low), "_before_high": last_of(~low)})
    before = F.when(low, F.col("_before_low")).otherwise(F.col("_before_high"))
    return own.withColumns({"dir_gap": _forward_only(F.col("ts") - before), "_opens_side": before.isNull()}).drop(
        "_before_low", "_before_high")


def _forward_only(gap: Column) -> Column:
    return F.when(gap >= 0, gap)


def _from_earlier_slices(rows: DataFrame, end: Column, *by: str) -> DataFrame:
    """Add ``_before`` and ``_before_side``: ``end`` of the last row, and of the sender's last row, in earlier slices.

    Few rows of a flow and slice stand in one group, never all packets of a flow.
    """
    earlier = Window.partitionBy(*KEY, *by).orderBy("_slice").rangeBetween(Window.unboundedPreceding, -1)
    low = F.col("_side") == F.col("lo_ip")
    found = rows.withColumns({"_before": F.max(end).over(earlier), "_low": F.max(F.when(low, end)).over(earlier),
                              "_high": F.max(F.when(~low, end)).over(earlier)})
    return found.withColumn("_before_side", F.when(low, F.col("_low")).otherwise(F.col("_high"))).drop("_low", "_high")


def packet_gaps(packets: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Add ``gap`` to the flow's previous packet and ``dir_gap`` to the previous one of the same sender.

    Order is file order, so ``gap`` may be negative; a negative ``dir_gap`` is dropped but the packet
    still counts as the previous one for its successor.

    Only packets at the edges of a slice meet the other slices of their flow; packets are read once.
    """
    rows = _in_slices(packets, rows_per_slice)
    after = Window.partitionBy(*KEY, "_slice").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    low = F.col("_side") == F.col("lo_ip")
    seen_low, seen_high = F.count_if(low).over(after), F.count_if(~low).over(after)
    rows = rows.withColumn("_closes_side", F.when(low, seen_low).otherwise(seen_high) == 0)
    edge = F.col("_opens") | F.col("_opens_side") | F.col("_closes_side")
    # rows inside a slice stay by themselves, those at its edges meet by flow
    rows = rows.withColumn("_group", F.when(edge, F.lit(-1).cast("bigint")).otherwise(F.col("_slice")))
    end = F.when(F.col("_closes_side"), F.struct("seq", "ts"))
    return _from_earlier_slices(rows, end, "_group").withColumns({
        "gap": F.when(F.col("_opens"), F.col("ts") - F.col("_before.ts")).otherwise(F.col("gap")),
        "dir_gap": F.when(F.col("_opens_side"), _forward_only(F.col("ts") - F.col("_before_side.ts"))).otherwise(F.col("dir_gap")),
    }).drop("_slice", "_group", "_opens", "_opens_side", "_closes_side", "_before", "_before_side")


def _flag(bit: int) -> Column:
    return F.count_if((F.col("protocol") == "TCP") & (F.col("tcp_flags").bitwiseAND(bit) != 0))


def _moments(prefix: str, value: Column, count: Column) -> list[Column]:
    """Mergeable count, sum and sum of squares of one measure."""
    return [F.sum(value).alias(f"{prefix}_sum"), F.sum(value * value).alias(f"{prefix}_sq"),
            count.alias(f"{prefix}_n"), F.min(value).alias(f"{prefix}_min"), F.max(value).alias(f"{prefix}_max")]


def _pop_std(n: Column, total: Column, squares: Column) -> Column:
    mean = total / n
    return F.when(n > 0, F.sqrt(F.greatest(F.lit(0.0), squares / n - mean * mean))).otherwise(0.0)


def _segments(packets: DataFrame, rows_per_slice: int) -> DataFrame:
    """One row per flow, slice and sender: counts, moments, extremes, first and last packet.

    Segments of a flow merge associatively, so a flow's packets never have to meet in one place.
    """
    def layer(server_port: str) -> Column:
        return net.app_layer(F.col("protocol"), F.col(server_port), F.col("src_port"), F.col("dst_port"),
                             F.col("payload_len"), F.col("first_byte"), F.col("is_request"))

    # The server's port is the destination's on forward packets and the source's on answers.
    rows = _in_slices(packets, rows_per_slice).withColumns(
        {"_layer_out": layer("dst_port"), "_layer_in": layer("src_port"), "_ja3": _fingerprint()})
    tcp = F.col("protocol") == "TCP"
    length = F.col("payload_len").cast("double")
    header = F.when(tcp, F.col("header_len"))

    def last(name: str) -> Column:
        return F.max(F.when(F.col(name).isNotNull(), F.struct("seq", F.col(name).alias("value"))))

    return rows.groupBy(*KEY, "_slice", "_side").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.bool_or("_opens").alias("_opens"),
        F.min_by(F.struct("ts", "src_ip", "src_port", "dst_ip", "dst_port"), "seq").alias("first"),
        F.max_by("ts", "seq").alias("last_ts"),
        *_moments("len", length, F.count(F.lit(1))),
        *_moments("gap", F.col("gap"), F.count("gap")),
        *_moments("dgap", F.col("dir_gap"), F.count("dir_gap")),
        _flag(0x01).alias("fin"), _flag(0x02).alias("syn"), _flag(0x04).alias("rst"),
        _flag(0x08).alias("psh"), _flag(0x10).alias("ack"), _flag(0x20).alias("urg"),
        F.sum(header).alias("header"), F.min(header).alias("min_header"),
        F.count_if(tcp & (F.col("payload_len") >= 1)).alias("data_packets"),
        F.min(F.when(tcp, F.struct("seq", "win"))).alias("first_win"),
        last("_layer_out").alias("layer_out"), last("_layer_in").alias("layer_in"), last("sni").alias("sni"),
        last("_ja3").alias("ja3"),
    )


def _stitched(segments: DataFrame) -> DataFrame:
    """Add the gap across a segment's start to the segment's moments."""
    found = _from_earlier_slices(segments, F.struct(F.col("last_seq").alias("seq"), F.col("last_ts").alias("ts")))
    start = F.col("first.ts")
    across = {"gap": F.when(F.col("_opens"), start - F.col("_before.ts")), "dgap": _forward_only(start - F.col("_before_side.ts"))}
    columns = {}
    for name, gap in across.items():
        own = {k: F.col(f"{name}_{k}") for k in ("sum", "sq", "n", "min", "max")}
        columns |= {
            f"{name}_sum": F.when(gap.isNull(), own["sum"]).otherwise(F.coalesce(own["sum"], F.lit(0.0)) + gap),
            f"{name}_sq": F.when(gap.isNull(), own["sq"]).otherwise(F.coalesce(own["sq"], F.lit(0.0)) + gap * gap),
            f"{name}_n": own["n"] + gap.isNotNull().cast("int"),
            f"{name}_min": F.least(own["min"], gap), f"{name}_max": F.greatest(own["max"], gap)}
    return found.withColumns(columns).drop("_before", "_before_side")


def _merged(segments: DataFrame) -> DataFrame:
    """One row per flow and sender."""
    sums = [f"{m}_{k}" for m in ("len", "gap", "dgap") for k in ("sum", "sq", "n")] + [
        "fin", "syn", "rst", "psh", "ack", "urg", "header", "data_packets"]
    lows = ["first_seq", "len_min", "gap_min", "dgap_min", "min_header", "first_win"]
    highs = ["last_seq", "len_max", "gap_max", "dgap_max", "layer_out", "layer_in", "sni", "ja3"]
    return segments.groupBy(*KEY, "_side").agg(
        F.min_by("first", "first_seq").alias("first"), F.max_by("last_ts", "last_seq").alias("last_ts"),
        *[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs])


def flow_table(packets: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Flow reconstruction in one pass over the packets; names are in :func:`flow_names`.

    Packets meet by (flow key, slice) and become mergeable segments; only these meet by flow key. Which
    sender is the forward one depends on the flow's first packet alone, so at most two rows per flow are
    combined at the end. The flow's key columns stay.
    """
    sides = _merged(_stitched(_segments(packets, rows_per_slice)))
    lead = F.min_by(F.struct("_side", "first"), "first_seq")
    flows = sides.groupBy(*KEY).agg(lead.alias("lead"), F.collect_list(F.struct(*[
        c for c in sides.columns if c not in KEY])).alias("sides"))
    return _combine(flows)


#: kind of a name, its packet column, the flow column that shows it and the column that counts it
NAMES = [("dns", "dns_qnames", "dns_queries", "dns_query_count"), ("host", "http_host", "http_hosts", "http_host_count"),
         ("agent", "user_agent", "user_agents", "user_agent_count")]
SHOWN_NAMES = 64


def flow_names(packets: DataFrame) -> DataFrame:
    """All names, hosts and agents of every flow: its key, ``kind``, ``value``, first packet and mentions."""
    def entries(kind: str, column: str) -> Column:
        value = F.col(column)
        values = F.coalesce(value if kind == "dns" else F.when(value.isNotNull(), F.array(value)), F.array().cast("array<string>"))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    held = F.coalesce(*[F.col(column).cast("string") for _, column, _, _ in NAMES]).isNotNull()
    keyed = with_flow_key(packets.where(held))
    seen = keyed.select(*KEY, "seq", F.explode(F.concat(*[entries(k, c) for k, c, _, _ in NAMES])).alias("n"))
    return seen.groupBy(*KEY, F.col("n.kind").alias("kind"), F.col("n.value").alias("value")).agg(
        F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("mentions"))


def with_names(flows: DataFrame, names: DataFrame, shown: int = SHOWN_NAMES) -> DataFrame:
    """Add to each flow how many names of a kind it has, and ``shown`` of them at most.

    Hosts that look like a login come first, then the alphabet. All names stay in the child table.
    """
    login = F.lower("value").contains("login") | F.lower("value").contains("auth")
    first = ((F.col("kind") == "host") & login).cast("int")
    place = F.row_number().over(Window.partitionBy(*KEY, "kind").orderBy(F.desc(first), "value"))
    some = names.withColumn("_place", place).where(F.col("_place") <= shown).groupBy(*KEY).agg(*[
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value")))).alias(show) for kind, _, show, _ in NAMES])
    counts = names.groupBy(*KEY).agg(*[F.count_if(F.col("kind") == kind).alias(count) for kind, _, _, count in NAMES])
    found = flows.join(counts, KEY, "left").join(some, KEY, "left")
    empty = F.array().cast("array<string>")
    return found.withColumns({
        **{show: F.coalesce(show, empty) for _, _, show, _ in NAMES},
        **{count: F.coalesce(count, F.lit(0)) for _, _, _, count in NAMES}})


def build_flows(packets: DataFrame, rows_per_slice: int = ROWS_PER_SLICE, shown: int = SHOWN_NAMES) -> DataFrame:
    """Flows with their names: :func:`flow_table` and, beside its one pass, the packets that carry a name."""
    flows = with_names(flow_table(packets, rows_per_slice), flow_names(packets), shown)
    return flows.drop(*[k for k in KEY if k not in ("file", "protocol")])


def names_by_flow(flows: DataFrame, names: DataFrame) -> DataFrame:
    """The child table under its flows' ids; ``flows`` as :func:`flow_table` makes them."""
    return names.join(flows.select(*KEY, "flow_id"), KEY).select("flow_id", "kind", "value", "first_seq", "mentions")


def _fingerprint() -> Column:
    return net.tls_fingerprint(F.col("tls_version"), F.col("tls_ciphers"), F.col("tls_extensions"),
                               F.col("tls_groups"), F.col("tls_formats"))


def _combine(flows: DataFrame) -> DataFrame:
    """Forward and backward halves side by side, then the flow columns."""
    pick = flows.select(
        *KEY, "lead",
        F.get(F.filter("sides", lambda s: s["_side"] == F.col("lead._side")), F.lit(0)).alias("f"),
        F.get(F.filter("sides", lambda s: s["_side"] != F.col("lead._side")), F.lit(0)).alias("b"),
    )

    def f(name: str, default=None) -> Column:
        col = F.col(f"f.{name}")
        return col if default is None else F.coalesce(col, F.lit(default))

    def b(name: str, default=None) -> Column:
        col = F.col(f"b.{name}")
        return col if default is None else F.coalesce(col, F.lit(default))

    def both(name: str) -> Column:
        return f(name, 0) + b(name, 0)

    def latest(out: Column, back: Column) -> Column:
        return F.greatest(out, back)["value"]

    end_ts = F.when(F.coalesce(b("last_seq"), F.lit(-1)) > f("last_seq"), b("last_ts")).otherwise(f("last_ts"))
    gap_n = both("gap_n")
    gap_mean = F.when(gap_n > 0, both("gap_sum") / gap_n).otherwise(0.0)
    n, total, squares = both("len_n"), both("len_sum"), both("len_sq")
    start_us = F.round(F.col("lead.first.ts") * 1e6).cast("bigint")
    end_us = F.round(end_ts * 1e6).cast("bigint")

    def side(prefix: str, get) -> dict[str, Column]:
        return {
            f"{prefix}_pkt_len_max": get("len_max", 0.0), f"{prefix}_pkt_len_min": get("len_min", 0.0),
            f"{prefix}_pkt_len_std": _pop_std(get("len_n", 0), get("len_sum", 0.0), get("len_sq", 0.0)),
            f"{prefix}_iat_total": get("dgap_sum", 0.0),
            f"{prefix}_iat_mean": F.when(get("dgap_n", 0) > 0, get("dgap_sum", 0.0) / get("dgap_n", 0)).otherwise(0.0),
            f"{prefix}_iat_std": _pop_std(get("dgap_n", 0), get("dgap_sum", 0.0), get("dgap_sq", 0.0)),
            f"{prefix}_iat_max": get("dgap_max", 0.0), f"{prefix}_iat_min": get("dgap_min", 0.0),
            f"{prefix}_psh_count": get("psh", 0), f"{prefix}_urg_count": get("urg", 0),
            f"{prefix}_header_len": get("header", 0),
        }

    columns = {
        **{k: F.col(k) for k in KEY},
        "src_ip": F.col("lead.first.src_ip"), "dst_ip": F.col("lead.first.dst_ip"),
        "src_port": F.col("lead.first.src_port"), "dst_port": F.col("lead.first.dst_port"),
        "start_time": F.timestamp_micros(start_us), "end_time": F.timestamp_micros(end_us),
        "duration_ms": F.floor((end_us - start_us) / 1000).cast("bigint"),
        "bytes_sent": f("len_sum", 0.0).cast("bigint"), "bytes_recv": b("len_sum", 0.0).cast("bigint"),
        "packets_sent": f("len_n", 0), "packets_recv": b("len_n", 0),
        "application_layer": latest(f("layer_out"), b("layer_in")), "tls_sni": latest(f("sni"), b("sni")),
        "ja3_hash": F.coalesce(f("ja3.value"), b("ja3.value")),
        "iat_mean": gap_mean,
        "iat_std": F.when(gap_n > 1, _pop_std(gap_n, both("gap_sum"), both("gap_sq"))).otherwise(0.0),
        "iat_max": F.coalesce(F.greatest(f("gap_max"), b("gap_max")), F.lit(0.0)),
        "iat_min": F.coalesce(F.least(f("gap_min"), b("gap_min")), F.lit(0.0)),
        **side("fwd", f), **side("bwd", b),
        "pkt_len_min": F.coalesce(F.least(f("len_min"), b("len_min")), F.lit(0.0)),
        "pkt_len_max": F.coalesce(F.greatest(f("len_max"), b("len_max")), F.lit(0.0)),
        "pkt_len_std": _pop_std(n, total, squares),
        **{f"{name}_count": both(name) for name in ("fin", "syn", "rst", "psh", "ack", "urg")},
        "init_win_fwd": f("first_win.win"), "init_win_bwd": b("first_win.win"),
        "act_data_pkt_fwd": f("data_packets", 0), "min_seg_size_fwd": f("min_header"),
        "is_external_dst": net.is_external_ip(F.col("lead.first.dst_ip")),
    }
    out = pick.select(*[expr.alias(name) for name, expr in columns.items()])
    key = F.concat_ws("|", "file", "src_ip", "dst_ip", "src_port", "dst_port", "protocol")
    return out.withColumn("flow_id", F.xxhash64(key))


def build_observables(packets: DataFrame) -> DataFrame:
    """Addresses, domains and user agents with the time of the first packet and the count of mentions."""
    def one(kind: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.array(F.struct(
            F.lit(kind).alias("type"), value.alias("value")))).otherwise(
            F.array().cast("array<struct<type:string,value:string>>"))

    names = F.transform(F.coalesce("dns_qnames", F.array().cast("array<string>")),
                        lambda q: F.struct(F.lit("domain").alias("type"), q.alias("value")))
    seen = F.concat(
        one("ip", F.col("src_ip")), one("ip", F.col("dst_ip")), one("domain", F.col("sni")),
        one("domain", text.strip_port(F.col("http_host"))), one("user_agent", F.col("user_agent")), names)
    return packets.select("seq", "ts", F.explode(seen).alias("o")).groupBy(
        F.col("o.type").alias("type"), F.col("o.value").alias("value")).agg(
        F.min_by("ts", "seq").alias("first_seen"), F.count(F.lit(1)).alias("occurrence_count"))


def idle_flows(packets: DataFrame, idle_seconds: float = 5, mirror: bool = True) -> DataFrame:
    """Directed flows closed by an idle gap, on a batch or a watermarked stream (column ``time``).

    A batch also gets the deviation and extremes of the gaps between packets; on a stream, where no
    row sees its predecessor, the mean gap follows from the flow's span (:mod:`flowloom.streaming.idle` keeps
    state and gives a stream all columns). ``mirror`` keeps the
    packet-only view's convention of reporting received = sent.
    """
    key = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
    # sessions that touch are one session for Spark; a gap of the full idle time ends a flow
    idle = f"{int(idle_seconds * 1e6) - 1} microseconds"
    rows = packets.where((F.col("src_ip") != "") & (F.col("dst_ip") != ""))
    length = F.col("length").cast("double")
    measures = [
        F.count(F.lit(1)).alias("packets_sent"), F.sum("length").cast("bigint").alias("bytes_sent"),
        F.min("length").alias("pkt_len_min"), F.max("length").alias("pkt_len_max"),
        F.stddev_pop(length).alias("pkt_len_std"), F.min("time").alias("start_time"), F.max("time").alias("end_time")]
    if not packets.isStreaming:
        rows = recent_gap(rows.withColumn("_us", F.unix_micros("time")), key, "_us", int(idle_seconds * 1e6) - 1, "_gap")
        gap = F.when(F.col("_gap") > 0, F.col("_gap") / 1e6)
        measures += [F.coalesce(f(gap), F.lit(0.0)).alias(n) for n, f in (
            ("iat_mean", F.avg), ("iat_std", F.stddev_pop), ("iat_max", F.max), ("iat_min", F.min), ("fwd_iat_total", F.sum))]
    out = rows.groupBy(*key, F.session_window("time", idle).alias("w")).agg(*measures)
    span = F.unix_micros("end_time") - F.unix_micros("start_time")
    out = out.withColumn("duration_ms", F.floor(span / 1000).cast("bigint"))
    if packets.isStreaming:
        out = out.withColumn("iat_mean", F.when(
            F.col("packets_sent") > 1, span / 1e6 / (F.col("packets_sent") - 1)).otherwise(0.0))
    received = (F.col("packets_sent"), F.col("bytes_sent")) if mirror else (F.lit(0), F.lit(0))
    return out.withColumns({
        "packets_recv": received[0].cast("bigint"), "bytes_recv": received[1].cast("bigint"), "fwd_iat_mean": F.col("iat_mean"),
        "is_external_dst": net.is_external_ip(F.col("dst_ip"))}).drop("w")
