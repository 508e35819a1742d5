import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom import constants as K
from flowloom.operators import evaluate as E
from flowloom.operators import features as FT
from flowloom.operators import forest as IF
from flowloom.plans import training
from flowloom.sources import labelled

FLOW = ("flow_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, duration_ms bigint, bytes_sent bigint, "
        "bytes_recv bigint, packets_sent bigint, packets_recv bigint, iat_mean double, iat_std double, iat_max double, fwd_iat_mean double, "
        "start_time timestamp, is_external_dst boolean, dst_port_entropy double")


def flow_rows(spark, entropy=None, ms=1000):
    import datetime as dt
    return spark.createDataFrame([("f", "10.0.0.1", "8.8.8.8", 5, 443, "TCP", ms, 500, 1500, 5, 10, .05, .01, .2, .04,
                                   dt.datetime(2026, 1, 1, 14), True, entropy)], FLOW)


def test_compact_vector(spark):
    out = FT.compact_features(flow_rows(spark))
    assert out.columns == ["flow_id", *K.COMPACT_FEATURES]
    r = out.first()
    assert (r.dst_port, r.fwd_pkt_len_mean, r.bwd_pkt_len_mean, r.down_up_ratio, r.is_external_dst, r.time_of_day_hour) == (443, 100, 150, 2, 1, 14)
    assert r.pkt_size_avg == pytest.approx(2000 / 15) and r.dst_port_entropy == 0.0
    assert FT.compact_features(flow_rows(spark, 7.5)).first().dst_port_entropy == 7.5
    assert FT.compact_features(flow_rows(spark, ms=150)).first().duration_ms_log == pytest.approx(np.log1p(150))
    assert FT.compact_features(flow_rows(spark).limit(0)).count() == 0


def test_dataset_vector(spark):
    df = spark.createDataFrame([(443, 1_000_000, 5, 10, 500_000.0, "10.0.0.1", "8.8.8.8", 17, " BENIGN ")],
                               "`Destination Port` int, `Flow Duration` bigint, `Total Fwd Packets` bigint, ` Total Backward Packets` bigint, "
                               "`flow iat mean` double, `Source IP` string, `Destination IP` string, Protocol int, attack_label string")
    r = FT.compact_features_from_dataset(df).first()
    assert r.duration_ms_log == pytest.approx(np.log1p(1000)) and r.iat_mean == 0.5 and r.protocol_encoded == 2 and r.is_external_dst == 1
    assert FT.compact_features_from_dataset(df.drop("Protocol")).first().protocol_encoded == 1
    assert labelled.with_label(df).first().Label == "BENIGN"
    full = FT.full_features_from_dataset(df.withColumn("Flow Bytes/s", F.lit(float("inf"))))
    assert full.columns == list(K.FULL_FEATURE_COLUMNS) and len(full.columns) == 78
    assert full.first().flow_bytes_per_s is None and full.first().flow_iat_mean == 500_000.0


def test_full_vector_fills_medians(spark):
    r = FT.full_features(flow_rows(spark).withColumn("iat_min", F.lit(0.01)), {"idle_mean": 9.0, "flow_iat_min": 1.0}).first()
    assert (r.idle_mean, r.flow_iat_min, r.flow_duration, r.active_mean, r.fwd_iat_mean) == (9.0, 10_000.0, 1_000_000.0, 0.0, 40_000.0)


def test_scaling_constant_column(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0)], "flow_id int, a double, b double")
    out = FT.scale_with(df, FT.feature_ranges(df, ["a", "b"]), ["a", "b"]).orderBy("flow_id").collect()
    assert [(r.a, r.b) for r in out] == [(0.0, 0.0), (1.0, 0.0)]


def test_tree_shape_and_path_lengths():
    rng = np.random.default_rng(1)
    x = rng.random((256, 5)).astype("float32")
    t = IF.grow_tree(x, 3)
    leaves = t[t.feature < 0]
    assert len(t) == 2 * len(leaves) - 1 and np.floor(np.log2(t.node + 1)).max() <= 8
    assert set((leaves.node - 1) // 2) <= set(t[t.feature >= 0].node)
    constant = IF.grow_tree(np.ones((10, 3), dtype="float32"), 1)
    assert len(constant) == 1 and constant.path[0] == pytest.approx(float(IF.average_path(10)))
    assert IF.average_path(np.array([0, 1, 2])).tolist() == [0, 0, 1]


def planted(spark, n=4000, bad=40):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 4))
    x[:bad] += 7
    rows = [(i, *map(float, v), "DDoS" if i < bad else "BENIGN") for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "row_id int, a double, b double, c double, d double, Label string")


def test_forest_finds_planted_outliers(spark):
    df, names = planted(spark), ["a", "b", "c", "d"]
    forest = IF.fit(df, names, ["row_id"], trees=60, sample_size=256, contamination=0.05)
    out = IF.score(df, forest)
    flagged = out.where("decision < 0").count() / 4000
    assert 0.04 < flagged < 0.06
    assert {r.row_id for r in out.orderBy("decision").limit(40).collect()} == set(range(40))
    again = IF.fit(df.repartition(5), names, ["row_id"], trees=60, sample_size=256, contamination=0.05)
    assert again.offset == pytest.approx(forest.offset, abs=0.02)


def test_every_tree_gets_its_sample(spark):
    sizes = IF.assign_to_trees(spark.range(50_000), ["id"], 50_000, 20, 1024).groupBy("tree").count().collect()
    assert len(sizes) == 20 and min(r["count"] for r in sizes) >= 1000


def test_workflow(spark):
    model, out = training.run(planted(spark), ["a", "b", "c", "d"], ["row_id"], trees=60, sample_size=256)
    best = out["recommended"].first()
    assert best.recall == 1.0 and best.within_cap and out["sweep"].count() == 25
    m = out["confusion"].first()
    assert m.tp + m.fn == 40 and m.samples == 4000 and m.recall == 1.0
    assert {r.label for r in out["by_label"].collect()} == {"BENIGN", "DDoS", "all_attacks"}
    few = E.per_label(out["scored"], min_rows=50)
    assert {r.label for r in few.collect()} == {"BENIGN"}  # 40 attacks are fewer than 50
    assert model.d_min < 0 < model.d_max


def test_fit_on_batch(spark):
    out = IF.fit_and_score_batch(planted(spark, 500, 5), ["a", "b", "c", "d"], ["row_id"], trees=50)
    assert out.count() == 500 and out.where("row_id < 5").agg(F.min("anomaly_score")).first()[0] > 5


def test_sweep_prefers_lowest_threshold_on_ties(spark):
    df = spark.createDataFrame([(9.5, True), (9.4, True), (1.0, False)], "score double, is_attack boolean")
    assert E.recommend_threshold(E.threshold_sweep(df)).first().threshold == 3.0
    none = spark.createDataFrame([(9.5, True), (9.9, False)], "score double, is_attack boolean")
    r = E.recommend_threshold(E.threshold_sweep(none)).first()
    assert not r.within_cap and r.threshold == 3.0


def test_samples_are_stable_and_stratified(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3 == 0).alias("is_attack"))
    a, b = E.stratified_sample(df, 500, ["id"]), E.stratified_sample(df.repartition(7), 500, ["id"])
    assert sorted(r.id for r in a.collect()) == sorted(r.id for r in b.collect())
    assert a.count() == 500 and a.where("is_attack").count() == 100


def test_clean_and_labels(spark):
    df = spark.createDataFrame([(1.0, " benign"), (1.0, " benign"), (float("inf"), "x"), (float("nan"), "x"), (None, "x"), (2.0, "DDoS")], "v double, Label string")
    kept = FT.clean_dataset(df, ["v"])
    assert kept.count() == 2 and kept.where(FT.is_benign(F.col("Label"))).count() == 1


def test_labelled_scan_and_runs(spark, tmp_path):
    csv = tmp_path / "flows.csv"
    csv.write_text(" Destination Port,Flow Duration, Label,Unused\n80,10,BENIGN ,1\n443,20,DDoS,2\n")
    df = labelled.read_labelled(spark, str(csv), fmt="csv")
    assert sorted(r.Label for r in df.collect()) == ["BENIGN", "DDoS"] and "Unused" not in df.columns
    for i in range(12):
        (tmp_path / f"run_{i:02}.json").write_text('{\n"run_id": "r%02d", "started_at": "2026-01-%02d", "status": "done", "phases": [{"name": "verify", "metrics": {"recall": "0.%d"}}]}' % (i, i + 1, i))
    runs = labelled.training_runs(spark, str(tmp_path / "run_*.json"))
    assert [r.run_id for r in runs.collect()][:2] == ["r11", "r10"] and runs.count() == 10 and runs.first().recall == 0.11


def test_joins_walk_the_forest_as_the_scoring_function_does(spark):
    df, names = planted(spark, 600, 6), ["a", "b", "c", "d"]
    nodes = spark.createDataFrame(IF.train_nodes(df, names, ["row_id"], 600, 12, 64).collect(), IF.NODE_SCHEMA)
    forest = IF.load_forest(nodes, names, 64)
    forest.offset = -0.4
    both = IF.score(df, forest).join(IF.score_by_joins(df, ["row_id"], nodes, names, 64, -0.4, "walked"), "row_id")
    assert both.count() == 600 and both.where(F.abs(F.col("decision") - F.col("walked")) > 1e-12).isEmpty()
    single = spark.createDataFrame([(0, 0, -1, 0.0, 3.0)], IF.NODE_SCHEMA)
    assert {r.decision for r in IF.score_by_joins(df, ["row_id"], single, names, 1).collect()} == {-8.0 ** -1}


def test_stratified_sample_is_the_sample_of_each_stratum(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 7 == 0).alias("is_attack"))
    got = {r.id for r in E.stratified_sample(df, 300, ["id"]).collect()}
    want = {r.id for v, n in ((True, 60), (False, 240)) for r in E.sample_rows(df.where(F.col("is_attack") == v), n, ["id"]).collect()}
    assert got == want


def test_no_row_enters_a_tree_twice(spark):
    for rows, trees, wanted in ((3000, 12, 2000), (3000, 7, 2900), (50_000, 1, 400), (20_000, 30, 256)):
        drawn = IF.assign_to_trees(spark.range(rows), ["id"], rows, trees, wanted).groupBy("tree", "id").count()
        assert drawn.where("count > 1").isEmpty()
        sizes = {r.tree: r["count"] for r in drawn.groupBy("tree").count().collect()}
        assert set(sizes) == set(range(trees)) and min(sizes.values()) >= 0.97 * wanted


def test_all_training_runs_and_the_newest(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"run_{i:02}.json").write_text('{"run_id": "r%02d", "started_at": "2026-01-%02d", "status": "done"}' % (i, i + 1))
    path = str(tmp_path / "run_*.json")
    assert [r.run_id for r in labelled.all_training_runs(spark, path).collect()] == [f"r{i:02}" for i in reversed(range(12))]
    assert [r.run_id for r in labelled.training_runs(spark, path, 3).collect()] == ["r11", "r10", "r09"]


def test_a_forest_beyond_the_bound_is_not_collected(spark, monkeypatch):
    nodes = spark.range(50).selectExpr("0 AS tree", "int(id) AS node", "-1 AS feature", "0D AS threshold", "1D AS path")
    monkeypatch.setattr(IF, "MAX_MODEL_BYTES", 40 * IF.NODE_BYTES)
    with pytest.raises(ValueError):
        IF.load_forest(nodes, ["a"], 16)


def test_workflow_scores_each_row_once(spark, monkeypatch):
    names, options = ["a", "b", "c", "d"], {"trees": 20, "sample_size": 128}
    df = planted(spark, 1200, 20)
    first = training.train(df.where("Label = 'BENIGN'"), names, ["row_id"], **options)
    apart = {tuple(r) for r in training.evaluate(first, df, ["row_id"])["scored"].collect()}
    calls, inner = [], IF.score
    monkeypatch.setattr(IF, "score", lambda *a, **k: calls.append(1) or inner(*a, **k))
    model, out = training.run(df, names, ["row_id"], **options)
    assert len(calls) == 1
    assert (model.forest.offset, model.d_min, model.d_max) == (first.forest.offset, first.d_min, first.d_max)
    assert {tuple(r) for r in out["scored"].collect()} == apart


def test_cleaning_tests_each_feature_once(spark):
    df = spark.range(5).select("id", *[F.log1p(F.col("id") + i).alias(f"f{i}") for i in range(4)])
    plan = FT.clean_dataset(df, [f"f{i}" for i in range(4)])._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and sum(line.count("LOG1P") for line in filters) == 4
    odd = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, None), (3, float("nan")), (4, float("-inf")), (5, -2.0)], "k int, v double")
    assert sorted(map(tuple, FT.clean_dataset(odd, ["v"]).collect())) == [(1, 1.0), (5, -2.0)]
