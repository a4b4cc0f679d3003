from types import SimpleNamespace

import pytest

from larkspur import session


def test_a_cluster_needs_a_shared_folder():
    def fake(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(fake("spark://host:7077", None))
    assert session.shared_dir(fake("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"


def test_buckets_are_read_without_an_exchange_and_leave_no_table(spark):
    before = {t.name for t in spark.catalog.listTables()}
    df = session.cut_buckets(spark.range(100).selectExpr("id % 7 as k", "id"), "k", ["id"], "things")
    counts = df.groupBy("k").count()
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in counts.collect()) == [(k, 15 if k < 2 else 14) for k in range(7)]
    assert {t.name for t in spark.catalog.listTables()} == before


def test_state_of_files_changes_with_them(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    first = session.files_state(spark.read.parquet(path))
    assert first == session.files_state(spark.read.parquet(path))
    spark.range(4).write.mode("overwrite").parquet(path)
    assert session.files_state(spark.read.parquet(path)) != first
