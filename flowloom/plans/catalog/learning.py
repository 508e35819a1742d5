"""Features, forest, calibration and evaluation."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from flowloom import constants as K
from flowloom.functions import values
from flowloom.operators import evaluate as E
from flowloom.operators import features as FT
from flowloom.operators import forest as IF
from flowloom.plans import training
from flowloom.plans.adapter_sql import INTERNAL
from flowloom.plans.catalog import query
from flowloom.session import stored
from flowloom.sources import labelled

c = F.col
DST_IN = INTERNAL.format(c="dst_ip")
_ENTROPY = """e AS (SELECT src_ip, -sum(n/t*log2(n/t)) AS ent FROM (SELECT src_ip, count(*)::double AS n, sum(count(*)) OVER (PARTITION BY src_ip)::double AS t
 FROM x_flows GROUP BY src_ip, dst_port) GROUP BY 1)"""


def _rounded(names, digits=4):
    return [F.round(n, digits).alias(n) for n in names]


@query("ml_01_compact_features", f"""
WITH {_ENTROPY}, s AS (SELECT *, greatest(duration_ms/1000.0, 1e-6) AS sec FROM x_flows)
SELECT flow_id, dst_port::double AS dst_port, round(ln(1+duration_ms),4) AS duration_ms_log, packets_sent::double AS fwd_packets, packets_recv::double AS bwd_packets,
 round(ln(1+bytes_sent),4) AS fwd_bytes_log, round(ln(1+bytes_recv),4) AS bwd_bytes_log, round(down,4) AS down_up_ratio, round(iat_mean,4) AS iat_mean,
 round(iat_std,4) AS iat_std, round(iat_max,4) AS iat_max, round(ent,4) AS dst_port_entropy, (NOT {DST_IN})::int::double AS is_external_dst,
 hour(make_timestamp(start_us))::double AS time_of_day_hour, CASE protocol WHEN 'TCP' THEN 1 WHEN 'UDP' THEN 2 ELSE 0 END::double AS protocol_encoded,
 floor(rate) AS flow_bytes_per_s, round((packets_sent+packets_recv)/sec,4) AS flow_packets_per_s, round(bytes_sent/greatest(packets_sent,1),9) AS fwd_pkt_len_mean,
 round(bytes_recv/greatest(packets_recv,1),9) AS bwd_pkt_len_mean, round((bytes_sent+bytes_recv)/greatest(packets_sent+packets_recv,1),9) AS pkt_size_avg,
 round(fwd_iat_mean,4) AS fwd_iat_mean FROM (SELECT *, packets_recv/greatest(packets_sent,1) AS down, (bytes_sent+bytes_recv)/sec AS rate FROM s) JOIN e USING (src_ip)""")
def _(t):
    out = FT.compact_features(t.wide.flows, stored(FT.port_entropy(t.flows), "entropy"))
    return out.select("flow_id", *_compact_rounded())


def _compact_rounded() -> list:
    """The 20 features to four digits, mean sizes to nine and byte rates to whole bytes: there the fourth digit is often a tie."""
    digits = dict.fromkeys(["fwd_pkt_len_mean", "bwd_pkt_len_mean", "pkt_size_avg"], 9)
    whole = F.when(FT.finite(c("flow_bytes_per_s")).isNotNull(), F.floor("flow_bytes_per_s").cast("double")).alias("flow_bytes_per_s")
    return [whole if n == "flow_bytes_per_s" else F.round(n, digits.get(n, 4)).alias(n) for n in K.COMPACT_FEATURES]


def dataset(t):
    """Order lines under the labelled dataset's column names; every fifth supplier's lines are attacks."""
    q, price = c("l_quantity"), c("l_extendedprice")
    label = F.when(c("l_suppkey") % 5 != 0, " Benign ").otherwise(F.element_at(
        F.array(F.lit("DDoS"), F.lit("PortScan"), F.lit("Bot")), (c("l_partkey") % 3 + 1).cast("int")))
    base = F.when(c("l_suppkey") % 5 == 0, 3.0).otherwise(1.0)
    ok, ln = c("l_orderkey").cast("bigint"), c("l_linenumber").cast("bigint")
    return t.read("lineitem").select(
        ((ok * 8 + ln) * 1_000_000 + (c("l_partkey") % 1000) * 1000 + F.floor(price * 100 + 0.5) % 1000).alias("row_id"),
        (c("l_partkey") % 1000).cast("int").alias("Destination Port"), F.lit(6).alias("Protocol"),
        (q * 1000 * base).alias("Flow Duration"), q.alias("Total Fwd Packets"), ln.alias(" Total Backward Packets"),
        (price * base).alias("Total Length of Fwd Packets"), (price * c("l_discount")).alias("Total Length of Bwd Packets"),
        F.when(ln == 7, float("inf")).otherwise(price / q).alias("Flow Bytes/s"), (q / 10).alias("Flow Packets/s"),
        (c("l_discount") * 1e6 - 1000).alias("Flow IAT Mean"), (c("l_tax") * 1e6).alias("Flow IAT Std"), (c("l_discount") * 2e6).alias("Flow IAT Max"),
        (c("l_tax") * 5e5).alias("Fwd IAT Mean"), label.alias("attack_label"))


@query("src_10_training_runs", """
SELECT 'an' || o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'failed' ELSE 'running' END AS status, (o_orderkey % 97)/100 AS recall, (o_orderkey % 13)/100 AS f1 FROM orders""")
def _(t):
    """Each analysis as a run document, written and read back with the metrics of its verification phase."""
    import uuid

    from flowloom.session import shared_dir

    out = f"{shared_dir(t.spark)}/runs-{uuid.uuid4().hex[:10]}"
    metrics = F.create_map(F.lit("recall"), (c("total_flows") / 100).cast("string"), F.lit("f1"), (c("total_findings") / 100).cast("string"))
    phases = F.array(F.struct(F.lit("train").alias("name"), F.lit(None).cast("map<string,string>").alias("metrics")),
                     F.struct(F.lit("verify").alias("name"), metrics.alias("metrics")))
    t.analyses.select(c("analysis_id").alias("run_id"), c("created_at").cast("string").alias("started_at"), "status", phases.alias("phases")).write.json(out)
    return labelled.documents_of_runs(t.spark.read.schema(labelled.RUN_SCHEMA).json(out)).select("run_id", "status", "recall", "f1")


@query("ml_02_compact_features_from_dataset", """
SELECT (cast(l_orderkey AS bigint)*8+l_linenumber)*1000000 + (l_partkey % 1000)*1000 + cast(floor(l_extendedprice*100+0.5) AS bigint) % 1000 AS flow_id,
 (l_partkey % 1000)::double AS dst_port, round(ln(1+greatest(l_quantity*1000*b,0)/1000),4) AS duration_ms_log, l_quantity::double AS fwd_packets, l_linenumber::double AS bwd_packets,
 round(ln(1+l_extendedprice*b),4) AS fwd_bytes_log, round(ln(1+l_extendedprice*l_discount),4) AS bwd_bytes_log,
 CASE WHEN l_linenumber<>7 THEN floor((l_extendedprice/l_quantity)::double) END AS flow_bytes_per_s, round((l_quantity/10)::double,4) AS flow_packets_per_s,
 round((l_extendedprice*b/greatest(l_quantity,1))::double,9) AS fwd_pkt_len_mean, round((l_extendedprice*l_discount/greatest(l_linenumber,1))::double,9) AS bwd_pkt_len_mean,
 round(((l_extendedprice*b+l_extendedprice*l_discount)/greatest(l_quantity+l_linenumber,1))::double,9) AS pkt_size_avg, round((l_linenumber/greatest(l_quantity,1))::double,4) AS down_up_ratio,
 round(greatest(l_discount*1e6-1000,0)/1e6,4) AS iat_mean, round(l_tax*1e6/1e6,4)::double AS iat_std, round(l_discount*2e6/1e6,4)::double AS iat_max, round(l_tax*5e5/1e6,4)::double AS fwd_iat_mean,
 0.0::double AS dst_port_entropy, 12.0::double AS time_of_day_hour, 1.0::double AS protocol_encoded, 0.0::double AS is_external_dst
FROM (SELECT *, CASE WHEN l_suppkey % 5 = 0 THEN 3.0 ELSE 1.0 END::double AS b FROM lineitem)""")
def _(t):
    return FT.compact_features_from_dataset(dataset(t), "row_id").select("flow_id", *_compact_rounded())


def _all_features(given: dict[str, str], rest: str) -> str:
    """SQL for the whole 78-feature vector: the given expressions, rounded, and ``rest`` for every other feature."""
    return ", ".join(f"{'floor' if n == 'flow_bytes_per_s' else 'round'}(({given[n]})::double{'' if n == 'flow_bytes_per_s' else ', 4'}) AS {n}"
                     if n in given else f"{rest} AS {n}" for n in K.FULL_FEATURE_COLUMNS)


def _all_rounded() -> list:
    """The vector as its SQL gives it; the byte rate is cut to whole bytes, its fourth digit is often a tie."""
    return [F.floor(n).cast("double").alias(n) if n == "flow_bytes_per_s" else F.round(n, 4).alias(n) for n in K.FULL_FEATURE_COLUMNS]


_FROM_DATASET = {
    "destination_port": "l_partkey % 1000", "protocol_encoded": "1.0", "flow_duration": "l_quantity*1000*b", "total_fwd_packets": "l_quantity",
    "total_backward_packets": "l_linenumber", "total_length_of_fwd_packets": "l_extendedprice*b", "total_length_of_bwd_packets": "l_extendedprice*l_discount",
    "flow_bytes_per_s": "CASE WHEN l_linenumber<>7 THEN l_extendedprice/l_quantity END", "flow_packets_per_s": "l_quantity/10",
    "flow_iat_mean": "l_discount*1e6-1000", "flow_iat_std": "l_tax*1e6", "flow_iat_max": "l_discount*2e6", "fwd_iat_mean": "l_tax*5e5",
}


@query("ml_03_full_features_from_dataset", f"""
SELECT (cast(l_orderkey AS bigint)*8+l_linenumber)*1000000 + (l_partkey % 1000)*1000 + cast(floor(l_extendedprice*100+0.5) AS bigint) % 1000 AS row_id,
 {_all_features(_FROM_DATASET, 'NULL::double')} FROM (SELECT *, CASE WHEN l_suppkey % 5 = 0 THEN 3.0 ELSE 1.0 END::double AS b FROM lineitem)""")
def _(t):
    return FT.full_features_from_dataset(dataset(t), ["row_id"]).select("row_id", *_all_rounded())


_SEC, _OUT, _IN = "greatest(duration_ms/1000.0,1e-6)", "bytes_sent/greatest(packets_sent,1)", "bytes_recv/greatest(packets_recv,1)"
_BOTH = "(bytes_sent+bytes_recv)/greatest(packets_sent+packets_recv,1)"
_FROM_FLOWS = {
    "destination_port": "dst_port", "protocol_encoded": "CASE protocol WHEN 'TCP' THEN 1 WHEN 'UDP' THEN 2 ELSE 0 END", "flow_duration": "duration_ms*1000.0",
    "total_fwd_packets": "packets_sent", "total_backward_packets": "packets_recv", "total_length_of_fwd_packets": "bytes_sent",
    "total_length_of_bwd_packets": "bytes_recv", "fwd_packet_length_mean": _OUT, "bwd_packet_length_mean": _IN,
    "flow_bytes_per_s": f"(bytes_sent+bytes_recv)/{_SEC}", "flow_packets_per_s": f"(packets_sent+packets_recv)/{_SEC}",
    "fwd_packets_per_s": f"packets_sent/{_SEC}", "bwd_packets_per_s": f"packets_recv/{_SEC}", "packet_length_mean": _BOTH, "average_packet_size": _BOTH,
    "down_up_ratio": "packets_recv/greatest(packets_sent,1)", "avg_fwd_segment_size": _OUT, "avg_bwd_segment_size": _IN,
    "subflow_fwd_packets": "packets_sent", "subflow_fwd_bytes": "bytes_sent", "subflow_bwd_packets": "packets_recv", "subflow_bwd_bytes": "bytes_recv",
    "flow_iat_mean": "iat_mean*1e6", "flow_iat_std": "iat_std*1e6", "flow_iat_max": "iat_max*1e6", "fwd_iat_mean": "fwd_iat_mean*1e6", "idle_max": "7.5", "syn_flag_count": "packets_recv",
}


@query("ml_04_full_features", f"SELECT flow_id, {_all_features(_FROM_FLOWS, '0.0::double')} FROM x_flows")
def _(t):
    flows = t.flows.withColumn("syn_count", c("packets_recv"))
    return FT.full_features(flows, {"idle_max": 7.5}).select("flow_id", *_all_rounded())


@query("agg_25_feature_ranges", """
SELECT unnest(['bytes_sent','bytes_recv','packets_sent']) AS feature, unnest([min(bytes_sent),min(bytes_recv),min(packets_sent)])::double AS min,
 unnest([max(bytes_sent),max(bytes_recv),max(packets_sent)])::double AS max FROM x_flows""")
def _(t):
    return FT.feature_ranges(t.flows, ["bytes_sent", "bytes_recv", "packets_sent"])


@query("agg_26_feature_medians", "SELECT median(bytes_sent)::double AS bytes_sent, median(packets_sent)::double AS packets_sent FROM x_flows")
def _(t):
    return FT.feature_medians(t.flows, ["bytes_sent", "packets_sent"])


@query("agg_27_calibration_bounds", """
SELECT round(min(d)*1.5,6) AS d_min, round(max(d),6) AS d_max, round(quantile_cont(d,0.05),6) AS p5, round(quantile_cont(d,0.5),6) AS p50, round(quantile_cont(d,0.999),6) AS p99_9 FROM (SELECT l_discount-0.045-l_tax/7 AS d FROM lineitem)""")
def _(t):
    d = t.read("lineitem").select((c("l_discount") - 0.045 - c("l_tax") / 7).alias("decision"))
    return IF.calibration_bounds(d).select(*_rounded(["d_min", "d_max", "p5", "p50", "p99_9"], 6))


@query("ml_06_min_max_scaling", """
SELECT flow_id, round((bytes_sent-(SELECT min(bytes_sent) FROM x_flows))/((SELECT max(bytes_sent)-min(bytes_sent) FROM x_flows)),6) AS bytes_sent, 0.0::double AS constant FROM x_flows""")
def _(t):
    flows = t.flows.select("flow_id", "bytes_sent", F.lit(4.0).alias("constant"))
    names = ["bytes_sent", "constant"]
    return FT.scale_with(flows, FT.feature_ranges(flows, names), names).select("flow_id", F.round("bytes_sent", 6).alias("bytes_sent"), "constant")


@query("ml_09_calibration_map", """
SELECT l_orderkey, l_partkey, d, floor(least(10.0,greatest(0.0,CASE WHEN d>=0 THEN 5.0*(1-d/0.1) ELSE 5.0+5.0*d/(-0.58) END))*10+0.05)/10 AS calibrated,
 floor(least(10.0,greatest(0.0,5.0-25.0*d))*10+0.05)/10 AS plain FROM (SELECT *, l_discount-l_tax*2 AS d FROM lineitem)""")
def _(t):
    d = c("l_discount") - c("l_tax") * 2

    def shown(x):
        return F.floor(x * 10 + 0.05) / 10

    return t.read("lineitem").select("l_orderkey", "l_partkey", d.alias("d"), shown(values.calibrated_score(d, -0.58, 0.1)).alias("calibrated"),
                                     shown(values.calibrated_score(d)).alias("plain"))


@query("agg_22_confusion", """
SELECT tp, fp, fn, tn, round((tp+tn)/(tp+fp+fn+tn),6) AS accuracy, round(tp/(tp+fp),6) AS precision, round(tp/(tp+fn),6) AS recall, round(2*tp/(2*tp+fp+fn),6) AS f1 FROM (
 SELECT count(*) FILTER (WHERE score>=5 AND is_attack) AS tp, count(*) FILTER (WHERE score>=5 AND NOT is_attack) AS fp,
 count(*) FILTER (WHERE score<5 AND is_attack) AS fn, count(*) FILTER (WHERE score<5 AND NOT is_attack) AS tn FROM x_labelled)""")
def _(t):
    return E.confusion(t.labelled).select("tp", "fp", "fn", "tn", *_rounded(["accuracy", "precision", "recall", "f1"], 6))


@query("agg_23_per_label_metrics", """
WITH s AS (SELECT label, score>=5 AS h, is_attack AS a FROM x_scored), g AS (SELECT label, count(*) AS samples, count(*) FILTER (WHERE h AND a) AS tp, count(*) FILTER (WHERE NOT h AND a) AS fn FROM s GROUP BY 1
 UNION ALL SELECT 'all_attacks', count(*), count(*) FILTER (WHERE h), count(*) FILTER (WHERE NOT h) FROM s WHERE a)
SELECT label, samples, tp, round(CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0 END,6) AS recall FROM g WHERE samples>=50""")
def _(t):
    return E.per_label(t.scored_flows, min_rows=50).select("label", "samples", "tp", F.round("recall", 6).alias("recall"))


@query("agg_23_top_labels", """
SELECT label, round(r,6) AS recall FROM (SELECT label, count(*) FILTER (WHERE score>=5 AND is_attack)/greatest(count(*) FILTER (WHERE is_attack),1) AS r FROM x_scored GROUP BY 1 HAVING count(*)>=50)
ORDER BY r DESC, label LIMIT 3""")
def _(t):
    return E.top_labels(E.per_label(t.scored_flows, min_rows=50), 3).select("label", F.round("recall", 6).alias("recall"))


def _sweep_sql(source):
    return f"""g AS (SELECT 3.0+i*0.25 AS threshold FROM range(25) r(i)),
s AS (SELECT threshold::double AS threshold, count(*) FILTER (WHERE score>=threshold AND is_attack) AS tp, count(*) FILTER (WHERE score>=threshold AND NOT is_attack) AS fp,
 count(*) FILTER (WHERE score<threshold AND is_attack) AS fn, count(*) FILTER (WHERE NOT is_attack) AS b FROM {source}, g GROUP BY 1)"""


_SWEEP_COLS = """threshold, round(CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0 END,4) AS precision, round(CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0 END,4) AS recall,
 round(CASE WHEN 2*tp+fp+fn>0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END,4) AS f1, round(CASE WHEN b>0 THEN fp/b ELSE 0 END,4) AS benign_fp_rate"""


@query("agg_24_threshold_sweep", f"WITH {_sweep_sql('x_scored')} SELECT {_SWEEP_COLS} FROM s")
def _(t):
    return E.threshold_sweep(t.scored_flows)


@query("agg_24_recommended_threshold", f"""
WITH {_sweep_sql('x_labelled')}, c AS (SELECT {_SWEEP_COLS} FROM s) SELECT *, benign_fp_rate<=0.1 AS within_cap FROM c ORDER BY benign_fp_rate<=0.1 DESC, f1 DESC, threshold LIMIT 1""")
def _(t):
    return E.recommend_threshold(E.threshold_sweep(t.labelled))


@query("src_07_labelled_scan", """
SELECT trim(lab) AS "Label", count(*) AS n, cast(sum(p) AS bigint) AS ports FROM (SELECT CASE WHEN l_suppkey % 5 <> 0 THEN ' Benign ' ELSE CASE l_partkey % 3 WHEN 0 THEN 'DDoS' WHEN 1 THEN 'PortScan' ELSE 'Bot' END END AS lab,
 l_partkey % 1000 AS p FROM lineitem) GROUP BY 1""")
def _(t):
    raw = dataset(t)
    kept = labelled.with_label(raw.select(*[FT.column_of(n) for n in labelled.wanted_columns(raw, "compact")]))
    return kept.groupBy("Label").agg(F.count(F.lit(1)).alias("n"), F.sum("Destination Port").cast("bigint").alias("ports"))


FOREST_FEATURES = ["dst_port", "duration_ms_log", "fwd_packets", "bwd_packets", "fwd_bytes_log", "bwd_bytes_log", "flow_bytes_per_s",
                   "flow_packets_per_s", "pkt_size_avg", "down_up_ratio", "iat_mean", "iat_std", "iat_max", "fwd_iat_mean"]


def forest_input(t):
    rows = labelled.with_label(dataset(t.wide)).withColumn("Flow Bytes/s", FT.finite(F.col("`Flow Bytes/s`")))
    return FT.compact_features_from_dataset(rows, "row_id")


# A forest's splits are random by seed, so these queries show what must hold of any forest, tree by tree and row by row.

_ROW_ID = "(cast(l_orderkey AS bigint)*8+l_linenumber)*1000000 + (l_partkey % 1000)*1000 + cast(floor(l_extendedprice*100+0.5) AS bigint) % 1000"


@query("ml_07_forest_training", "SELECT i::int AS tree, true AS binary, true AS joined, true AS bounded, true AS placed FROM range(50) r(i)")
def _(t):
    """Every tree is binary, hangs together, keeps to its sample's size and depth, and gives each leaf the path of its depth or more."""
    benign = forest_input(t).where(FT.is_benign(c("Label")))
    nodes = stored(IF.train_nodes(benign, FOREST_FEATURES, ["flow_id"], benign.count(), trees=50, sample_size=512), "nodes")
    inner = nodes.where("feature >= 0").select("tree", c("node").alias("_parent"))
    hung = nodes.withColumn("_parent", F.floor((c("node") - 1) / 2).cast("int")).join(inner.withColumn("_known", F.lit(True)), ["tree", "_parent"], "left")
    level, leaf = F.floor(F.log2(c("node") + 1.0)), c("feature") < 0
    return hung.groupBy("tree").agg(
        (F.count(F.lit(1)) == 2 * F.count_if(leaf) - 1).alias("binary"), F.bool_and(c("_known").isNotNull() | (c("node") == 0)).alias("joined"),
        ((F.count_if(leaf) <= 512) & (F.count_if(leaf) > 1) & (F.max(level) <= 9)).alias("bounded"),
        F.bool_and(F.when(leaf, (c("path") >= level) & (c("threshold") == 0)).otherwise(c("feature") < len(FOREST_FEATURES))).alias("placed"))


def walked(scaled, names, trees, sample_size, contamination=0.08):
    """Every row's decision value by the Arrow function and by joins over the same stored node table."""
    rows = scaled.count()
    nodes = stored(IF.train_nodes(scaled, names, ["flow_id"], rows, trees=trees, sample_size=sample_size), "nodes")
    forest = IF.load_forest(nodes, names, sample_size)
    forest.offset = 0.0
    forest.offset = float(IF.score(scaled, forest).agg(F.percentile_approx("decision", contamination, 10_000)).first()[0])
    scored = IF.anomaly_scores(scaled, forest)
    plain = IF.score_by_joins(scaled, ["flow_id"], nodes, names, sample_size, forest.offset, "walked")
    return scored.join(plain, "flow_id"), forest


@query("ml_08_forest_scoring", f"SELECT {_ROW_ID} AS flow_id, true AS same, true AS calibrated, true AS follows FROM lineitem")
def _(t):
    """Each row's decision is that of a walk through the node table; score and flag follow from it."""
    rows = forest_input(t)
    ranges = FT.feature_ranges(rows, FOREST_FEATURES)
    scored, _ = walked(stored(FT.scale_with(rows, ranges, FOREST_FEATURES).select("flow_id", *FOREST_FEATURES), "scaled"), FOREST_FEATURES, 50, 512)
    expected = F.greatest(F.lit(0.0), F.least(F.lit(10.0), 5.0 - 25.0 * c("walked")))
    return scored.select("flow_id", (F.abs(c("decision") - c("walked")) < 1e-9).alias("same"),
                         (F.abs(c("anomaly_score") - expected) < 0.0051 + 1e-9).alias("calibrated"), (c("flagged") == (c("anomaly_score") >= 5)).alias("follows"))


@query("ml_10_fit_on_the_batch", f"SELECT {_ROW_ID} AS flow_id, true AS scored, true AS follows, true AS share_kept FROM lineitem")
def _(t):
    """All rows scored; the flagged share is the contamination that the boundary was placed for."""
    rows = forest_input(t).select("flow_id", *FOREST_FEATURES)
    out = stored(IF.fit_and_score_batch(rows, FOREST_FEATURES, ["flow_id"], trees=50).select("flow_id", "anomaly_score", "flagged"), "batch-scores")
    share = out.agg(F.avg(c("flagged").cast("double")).alias("share"))
    return out.join(F.broadcast(share)).select(  # one row
        "flow_id", c("anomaly_score").between(0, 10).alias("scored"), (c("flagged") == (c("anomaly_score") >= 5)).alias("follows"),
        c("share").between(0.03, 0.08).alias("share_kept"))


@query("ml_11_train_tune_evaluate", "SELECT 3.0::double+i*0.25 AS threshold, true AS counted, true AS recall_falls, true AS alarms_fall, true AS found FROM range(25) r(i)")
def _(t):
    """The workflow's threshold table against a count of its scored rows per threshold."""
    _, out = training.run(forest_input(t), FOREST_FEATURES, ["flow_id"], trees=50, sample_size=512)
    hit, bad, grid = c("score") >= c("threshold"), c("is_attack"), out["sweep"].select("threshold")
    rows = out["scored"].groupBy("score", "is_attack").agg(F.count(F.lit(1)).alias("n"))  # scores have two digits

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, c("n"))), F.lit(0))

    counts = rows.join(F.broadcast(grid)).groupBy("threshold").agg(  # 25 thresholds
        total(hit & bad).alias("tp"), total(hit & ~bad).alias("fp"), total(bad).alias("attacks"), total(~bad).alias("benign"))
    before = Window.orderBy("threshold")
    near = [F.abs(c(name) - value) < 1e-4 for name, value in (
        ("recall", c("tp") / c("attacks")), ("benign_fp_rate", c("fp") / c("benign")), ("precision", F.coalesce(F.try_divide(c("tp"), c("tp") + c("fp")), F.lit(0.0))))]
    falls = [F.coalesce(c(n) <= F.lag(n).over(before), F.lit(True)) for n in ("recall", "benign_fp_rate")]
    best = out["recommended"].select(c("threshold").alias("_best"), c("f1").alias("_f1"), "within_cap")
    chosen = ~c("within_cap") | (c("benign_fp_rate") > 0.1) | (c("f1") < c("_f1")) | ((c("f1") == c("_f1")) & (c("threshold") >= c("_best")))
    return out["sweep"].join(counts, "threshold").join(F.broadcast(best)).select(  # one row
        "threshold", (near[0] & near[1] & near[2]).alias("counted"), falls[0].alias("recall_falls"), falls[1].alias("alarms_fall"), chosen.alias("found"))


@query("udf_03_vector_scoring", "SELECT count(*) AS n, 0::bigint AS differences, true AS some_flagged FROM lineitem")
def _(t):
    """The Arrow scoring function on its own against joins over the node table."""
    rows = forest_input(t)
    scaled = stored(FT.scale_with(rows, FT.feature_ranges(rows, FOREST_FEATURES), FOREST_FEATURES).select("flow_id", *FOREST_FEATURES), "scaled")
    scored, _ = walked(scaled, FOREST_FEATURES, 20, 256)
    return scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(c("decision") - c("walked")) > 1e-9).alias("differences"),
                      (F.count_if(c("decision") < 0) > 0).alias("some_flagged"))


@query("topk_07_deterministic_sample", """
SELECT flow_id, score, is_attack, label FROM x_scored ORDER BY substr(md5(flow_id || '|42'),1,15), flow_id LIMIT 500""")
def _(t):
    return E.sample_rows(t.scored_flows, 500, ["flow_id"])


@query("topk_07_stratified_sample", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY is_attack ORDER BY substr(md5(flow_id || '|42'),1,15), flow_id) AS r, count(*) FILTER (WHERE is_attack) OVER () AS attacks FROM x_scored)
SELECT flow_id, score, is_attack, label FROM r WHERE r <= CASE WHEN is_attack THEN least(attacks, 200) ELSE 1000 - least(attacks, 200) END""")
def _(t):
    return E.stratified_sample(t.scored_flows, 1000, ["flow_id"])


@query("set_02_concatenated_strata", """
SELECT is_attack, count(*) AS n, cast(sum(flow_id % 1000) AS bigint) AS check_sum FROM x_scored GROUP BY 1""")
def _(t):
    s = t.scored_flows
    both = s.where("not is_attack").unionByName(s.where("is_attack"))
    return both.groupBy("is_attack").agg(F.count(F.lit(1)).alias("n"), F.sum(c("flow_id") % 1000).alias("check_sum"))
