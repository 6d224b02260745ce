import os
import types

import pytest
from pyspark.sql import functions as F

from sievestone import session
from sievestone.sources import sample


def fake(master, **conf):
    settings = dict(conf)
    context = types.SimpleNamespace(master=master, getCheckpointDir=lambda: "somewhere", setCheckpointDir=lambda d: None)
    return types.SimpleNamespace(conf=types.SimpleNamespace(get=settings.get, set=settings.__setitem__), sparkContext=context), settings


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(session.NoSharedFolder):
            session.shared_dir(fake(master)[0])
        assert session.shared_dir(fake(master, **{"spark.checkpoint.dir": "/shared"})[0]) == "/shared"
    for master in ("local", "local[4]"):
        one, settings = fake(master)
        found = session.shared_dir(one)
        assert os.path.isdir(found) and settings["sievestone.checkpoint.dir"] == found == session.shared_dir(one)


def test_cut_and_written_keep_rows_and_end_lineage(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    for made in (session.cut(df), session.written(df)):
        assert sorted(map(tuple, made.collect())) == sorted(map(tuple, df.collect())) and "Range" not in made._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_keyed_joins_lose_no_row_whatever_is_hot(spark, monkeypatch, hot):
    monkeypatch.setattr(session, "HOT", hot)
    rows = spark.createDataFrame([(i % 5 if i < 400 else i, i) for i in range(500)] + [(None, -1)], "k long, i long")
    keyed = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("least")).filter("k <> 3")
    got = session.join_keyed(rows, keyed, "k", "n", 500)
    assert got.columns == ["k", "i", "least"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(keyed.drop("n"), "k").collect()))


def test_lines_in_one_pass_are_those_of_the_union(spark):
    folder = "/root/testdata/sf0.001"
    for name, sql in sample.LINES.items():
        one = sample.lines(spark, folder, name)
        assert sorted(r[0] for r in one.collect()) == sorted(r[0] for r in sample.view(spark, folder, sql).collect())
        assert one._jdf.queryExecution().optimizedPlan().toString().count("parquet") == sum(f"{{{t}}}" in sql for t in ("lineitem", "orders", "part", "customer"))
