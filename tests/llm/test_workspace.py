"""The shared folder and what is kept in it."""

import os

import pytest
from pyspark.sql import functions as F

from timeweave.llm import workspace


def test_stored_tables_cut_lineage_and_go(spark):
    df = spark.range(10).withColumn("u", F.rand(1))
    kept = workspace.stored(df, "numbers")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, kept.collect()))
    assert "FileScan" in kept._jdf.queryExecution().executedPlan().toString() or "Scan parquet" in kept._jdf.queryExecution().executedPlan().toString()
    folder = workspace.session_folder(spark).removeprefix("file://")
    assert os.listdir(folder)
    workspace.clean(spark)
    assert not os.path.exists(folder)


def test_the_cluster_names_the_folder(spark):
    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return {"spark.checkpoint.dir": "hdfs://shared/cp/"}[key]

    assert workspace.shared_folder(Session) == "hdfs://shared/cp"


def test_small_expressions(spark):
    row = spark.createDataFrame([(" Aé B\x0bc\n",)], "t string").select(workspace.ascii_lower(F.col("t")), workspace.without_blanks(F.col("t")), workspace.word_count(F.col("t"))).first()
    assert tuple(row) == (" aé b\x0bc\n", "AéBc", 3)
    assert spark.createDataFrame([(None,)], "t string").select(workspace.word_count(F.col("t"))).first()[0] == 0


def test_a_cluster_must_name_the_folder():
    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        Session.sparkContext.master = master
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            workspace.shared_folder(Session)


def test_equal_rows_are_numbered_partition_by_partition(spark):
    rows = [(None if i % 5 == 0 else i % 3, "x" if i % 2 else None) for i in range(600)]
    df = workspace.stored(spark.createDataFrame(rows, "a long, b string").repartition(6).withColumn("row", F.monotonically_increasing_id()), "rows")
    out = workspace.occurrence(df, ["a", "b"], "row", "nth")
    assert out.columns == ["a", "b", "row", "nth"]
    seen = {}
    for r in out.collect():
        seen.setdefault((r["a"], r["b"]), []).append(r["nth"])
    assert all(sorted(v) == list(range(len(v))) for v in seen.values()) and len(seen) == 8
    assert workspace.occurrence(df.limit(0), ["a"], "row", "nth").count() == 0
