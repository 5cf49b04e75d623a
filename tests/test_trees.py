"""Trees as tables: joins per level against the models themselves."""

import random

import pytest

from riskspark.operators import models as M
from riskspark.operators.trees import saved_nodes, tree_scores


@pytest.mark.parametrize("kind", ["gbt", "rf"])
def test_scores_of_the_saved_nodes(spark, tmp_path, kind, monkeypatch):
    monkeypatch.setattr(M, "GBT_ROUNDS", 4)
    monkeypatch.setattr(M, "RF_TREES", 5)
    rng = random.Random(4)
    rows = [(k, rng.randint(0, 1), rng.random(), float(rng.randint(0, 3)), 1.0) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, label int, a double, b double, c double")
    m = M.fit_model(df, ["a", "b", "c"], kind)
    m.write().overwrite().save(str(tmp_path / "m"))
    got = dict(map(tuple, tree_scores(df, ["a", "b", "c"], saved_nodes(spark, str(tmp_path / "m")), kind, "k").collect()))
    want = dict(map(tuple, M.score(m, df, ["a", "b", "c"], keep=["k"]).collect()))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert len(set(got.values())) > 10


def test_a_single_leaf(spark, tmp_path):
    df = spark.createDataFrame([(k, k % 2, 1.0) for k in range(20)], "k long, label int, a double")
    m = M.RandomForestClassifier(labelCol="label", numTrees=2, seed=1).fit(M._assemble(df, ["a"]))
    m.write().overwrite().save(str(tmp_path / "m"))
    got = tree_scores(df, ["a"], saved_nodes(spark, str(tmp_path / "m")), "rf", "k").collect()
    assert len(got) == 20 and all(0 < r.score < 1 for r in got)


def test_trees_fill_the_cores():
    """A forest's rows came in the view's few partitions (3 for 720,000 rows on 8 cores)."""
    assert M.tree_partitions(720_000, M.RF_PARTITION_ROWS, 12) == 12
    assert M.tree_partitions(300, M.RF_PARTITION_ROWS, 12) == 1 and M.tree_partitions(0, 10, 12) == 1
    assert M.tree_partitions(10**9, M.GBT_PARTITION_ROWS, 12) == 1000


def test_forest_fit_deals_its_rows(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(M.RandomForestClassifier, "fit", lambda self, t: seen.update(parts=t.rdd.getNumPartitions(), n=t.count()))
    df = spark.range(40_000).selectExpr("id % 2 AS label", "double(id) AS a").coalesce(1)
    M.fit_model(df, ["a"], "rf")
    assert seen == {"parts": spark.sparkContext.defaultParallelism, "n": 40_000}
