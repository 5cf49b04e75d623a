"""Train-fitted features (FIXTURES F4) and outlier fences."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskspark.operators import features as FE
from riskspark.operators import outlier as O


def test_iqr_and_mad_fences():
    assert O.iqr_fences(1353, 3933, 1.5) == (-2517.0, 7803.0)
    lo, hi = O.mad_fences(2317, 1098.5, 3.5)
    assert abs(lo - -3383.22635) < 1e-6 and abs(hi - 8017.22635) < 1e-6


def test_unseen_level_is_all_zero(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    levels = FE.fit_onehot(train, ["c"])
    assert levels == {"c": ["a", "b", "nan"]}
    test = spark.createDataFrame([("z",), (None,)], "c string")
    rows = FE.apply_onehot(test, levels).select(*FE.onehot_names(levels)).collect()
    assert [tuple(r) for r in rows] == [(0.0, 0.0, 0.0), (0.0, 0.0, 1.0)]


def test_zero_variance_scales_to_zero(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    p = FE.fit_scaler(df, ["x"])
    assert p == {"x": (5.0, 1.0)}
    assert [r[0] for r in FE.apply_scaler(df, p).collect()] == [0.0, 0.0]


def test_scaler_uses_population_std(spark):
    vals = [1.0, 2.0, 4.0, 8.0]
    p = FE.fit_scaler(spark.createDataFrame([(v,) for v in vals], "x double"), ["x"])
    assert np.isclose(p["x"][1], np.std(vals))


def test_sweep_matches_pandas(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.lognormal(5, 0.8, 500), 2)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    th = O.fit_candidates(df, "x")
    out = {r["method"]: r for r in O.sweep(df, "x", th).collect()}
    s = pd.Series(x)
    assert np.isclose(out["original"]["skew"], s.skew()) and np.isclose(out["original"]["kurtosis"], s.kurt())
    for m, lo, hi in th:
        c = s.clip(lo, hi)
        r = out[m]
        assert np.isclose(r["clipped_mean"], c.mean()) and np.isclose(r["clipped_std"], c.std())
        assert np.isclose(r["clipped_skew"], c.skew()) and np.isclose(r["clipped_kurt"], c.kurt())
        assert r["changed_count"] == int((c != s).sum())
        assert r["under_count"] + r["over_count"] == r["changed_count"]


def test_feature_spec_fit_is_idempotent(spark):
    rows = [(float(i), float(i % 7), "a" if i % 3 else "b") for i in range(200)]
    df = spark.createDataFrame(rows, "credit_amount double, duration double, housing string")
    df = df.withColumns({"existing_credits": F.lit(1.0), "installment_commitment": F.lit(2.0), "age": F.lit(30.0),
                         "num_dependents": F.lit(1.0)})
    spec1 = FE.FeatureSpec(numeric=["duration", "credit_amount"], onehot=["housing"]).fit(df)
    spec2 = FE.FeatureSpec(numeric=["duration", "credit_amount"], onehot=["housing"]).fit(df)
    assert spec1.params == spec2.params
    out = spec1.transform(df)
    assert out.columns == spec1.params["feature_list"]


def test_sparse_onehot_equals_the_long_form(spark):
    rows = [(i, f"p{i % 7}" if i % 5 else None, f"a:b_{i % 3}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, p string, `q.r` string")
    cols = ["p", "q.r"]
    m = FE.fit_sparse_onehot(df, cols)
    names = FE.sparse_onehot_names(m, cols)
    assert len(names) == len(set(names)) == 8 + 3
    out = FE.apply_sparse_onehot(df, m, cols)
    assert out.columns == ["id", "p", "q.r", "levels"] and out.schema["levels"].metadata["ml_attr"] == {"num_attrs": 11}
    got = {(r["id"], names[i]) for r in out.collect() for i in r["levels"].indices}
    assert got == {(r["id"], r["feature"]) for r in FE.onehot_long(df, "id", cols).collect()}
    assert {type(r["levels"]).__name__ for r in out.collect()} == {"SparseVector"}


def test_sparse_onehot_unseen_bounds_and_empty(spark):
    train = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "c string, v double")
    m = FE.fit_sparse_onehot(train, ["c"])
    new = FE.apply_sparse_onehot(spark.createDataFrame([("z", 0.0), (None, 0.0), ("x", 0.0)], "c string, v double"), m, ["c"]).collect()
    assert [len(r["levels"].indices) for r in new] == [0, 0, 1] and new[0]["levels"].size == 2
    with pytest.raises(ValueError, match="more than 1 levels"):
        FE.fit_sparse_onehot(train, ["c"], max_levels=1)
    with pytest.raises(ValueError, match="no rows"):
        FE.fit_sparse_onehot(train.limit(0), ["c"])


def test_sparse_onehot_feeds_the_logistic_model(spark):
    from riskspark.operators import models as M
    rows = [(i, f"g{i % 4}", int(i % 4 == 0 or i % 11 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, label int")
    sparse = FE.fit_sparse_onehot(df, ["g"])
    a = M.score(M.fit_model(FE.apply_sparse_onehot(df, sparse, ["g"]), ["levels"], "logistic", tol=1e-10),
                FE.apply_sparse_onehot(df, sparse, ["g"]), ["levels"], keep=["id"])
    levels = FE.fit_onehot(df, ["g"])
    wide, names = FE.apply_onehot(df, levels), FE.onehot_names(levels)
    b = M.score(M.fit_model(wide, names, "logistic", tol=1e-10), wide, names, keep=["id"])
    gap = a.withColumnRenamed("score", "s").join(b, "id").selectExpr("max(abs(s - score))").first()[0]
    assert gap < 1e-5


def test_scores_of_coefficients_in_a_table(spark):
    """The missing level has its own coefficient, an unseen one adds nothing."""
    from riskspark.operators import level_model as LM
    df = spark.createDataFrame([("a", 2.0), (None, 0.0), ("z", 1.0)], "g string, q double").coalesce(1)
    assert FE.count_levels(df, ["g"]) == 3
    beta = spark.createDataFrame([(0, "a", 1.0), (0, "nan", -1.0)], "c int, level string, beta double").coalesce(1)
    got = {r["g"]: r["score"] for r in LM.score_levels(LM.LevelModel(["g"], ["q"], beta, [0.5], 0.25), df).collect()}
    want = {"a": 2.25, None: -0.75, "z": 0.75}
    assert all(abs(got[g] - 1 / (1 + 2.718281828459045 ** -m)) < 1e-9 for g, m in want.items())
