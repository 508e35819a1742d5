from pyspark.sql import DataFrameWriter

from flowloom.operators import sinks


def test_analyses_are_written_side_by_side(spark, tmp_path, monkeypatch):
    """Rows are not sorted by analysis first; more analyses than open files and a second run leave each row once."""
    setting, seen, inner = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: seen.append(int(spark.conf.get(setting, "0"))) or inner(self, *a, **k))
    before = spark.conf.get(setting, None)
    rows = [(i, None if i % 70 == 0 else f"a{i % 70}") for i in range(700)]
    flows = spark.createDataFrame(rows, "flow_id bigint, analysis_id string")
    for _ in range(2):
        sinks.persist_analyses(str(tmp_path), flows=flows)
    assert seen == [sinks.OPEN_ANALYSES] * 2 and spark.conf.get(setting, None) == before
    back = spark.read.schema(flows.schema).parquet(f"{tmp_path}/flows").collect()
    assert sorted(back, key=lambda r: r.flow_id) == [tuple(r) for r in rows]
