"""Cross-validation: preprocessing fitted for all folds at once, both kinds of model."""

import numpy as np
from pyspark.sql import functions as F

from riskspark.operators import features as FE
from riskspark.operators import models as M
from riskspark.operators.split import stratified_folds

NAN = float("nan")


def frame(spark, n=400):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    rows = [(k, int(t), *map(float, v)) for k, (t, v) in enumerate(zip(y, x))]
    rows = [(k, t, a, b, None if k % 17 == 0 else NAN if k % 19 == 0 else c) for k, t, a, b, c in rows]
    return spark.createDataFrame(rows, "k long, label int, a double, b double, `c.d` double")


def test_fold_variants_equal_fits_per_training_set(spark):
    cols = ["a", "b", "c.d"]
    folds = stratified_folds(frame(spark), "label", "k", 4).persist()
    got = FE.fold_variants(folds, cols)
    assert sorted(got) == [0, 1, 2, 3]
    for i, params in got.items():
        want = FE.variants(folds.where(F.col("fold") != i), cols)
        assert list(params) == list(want) == list(FE.VARIANT_NAMES)
        for v in want:
            for part, per in want[v].items():
                for c in cols:
                    assert np.allclose(np.array(params[v][part][c], float), np.array(per[c], float)), (i, v, part, c)
    folds.unpersist()


def test_variants_of_a_column_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (-3.0, None)], "a double, b double")
    p = FE.variants(df, ["a", "b"])
    assert p["log1p"]["shift"]["a"] == 3.0 and p["baseline"]["scaler"]["b"] == (0.0, 1.0) and p["baseline"]["medians"]["b"] is None


def test_cross_validation_ranks_both_models(spark):
    """An interaction that boosted trees learn and a linear model cannot."""
    out = M.cross_validate(frame(spark), ["a", "b"], "k", "label", k=2, threads=4).collect()
    auc = {(r.model, r.fold): r.roc_auc for r in out}
    assert sorted(auc) == [("gbt", 0), ("gbt", 1), ("logistic", 0), ("logistic", 1)]
    assert all(auc["gbt", i] > 0.85 and auc["logistic", i] < 0.75 for i in (0, 1))
    assert sum(r.n_pos + r.n_neg for r in out) == 2 * 400


def test_counts_of_training_sets(spark):
    folds = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (1, 1), (2, 0)], "fold int, label int")
    assert M._counts_without(folds, "label") == {0: {1: 2, 0: 1}, 1: {1: 1, 0: 2}, 2: {1: 3, 0: 1}}
