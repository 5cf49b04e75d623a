"""NaN, NULL keys and groups, integer and dotted columns."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.operators import discriminant, evaluate, features, outlier, profile, schema
from riskspark.operators.columns import join_null_safe, num
from riskspark.operators.split import stratified_folds, stratified_split
from riskspark.session import checkpoint_dir

NAN = float("nan")


def test_nan_is_missing_everywhere(spark):
    rows = [(float(k), k) for k in range(20)] + [(NAN, 1), (None, 2)]
    df = spark.createDataFrame(rows, "`a.b` double, i int")
    clean = spark.createDataFrame(rows[:20] + [(None, 1), (None, 2)], "`a.b` double, i int")
    for fn in (profile.describe_numeric, profile.moments, profile.variances, profile.missing_summary, profile.correlation):
        assert list(map(tuple, fn(df, ["a.b", "i"]).collect())) == list(map(tuple, fn(clean, ["a.b", "i"]).collect())), fn
    assert features.fit_scaler(df, ["a.b"]) == features.fit_scaler(clean, ["a.b"])
    assert outlier.fit_winsorize(df, ["a.b"]) == outlier.fit_winsorize(clean, ["a.b"])
    assert df.select(F.count(num("a.b"))).first()[0] == 20


def test_impute_keeps_fractions_of_integer_columns(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "k int")
    med = features.fit_medians(df, ["k"])
    assert med == {"k": 2.5}
    assert [r.k for r in features.apply_impute(df, med).collect()][-1] == 2.5


def test_dotted_names(spark):
    df = spark.createDataFrame([(0, "a.b"), (1, "c"), (1, None)], "`default.payment.next.month` int, `x.y` string")
    assert schema.identify_target(df) == "default.payment.next.month"
    assert [r.label for r in schema.normalize_target(df, "default.payment.next.month").collect()] == [0, 1, 1]
    levels = features.fit_onehot(df, ["x.y"])
    assert levels == {"x.y": ["a.b", "c", "nan"]}
    wide = features.apply_onehot(df, levels)
    scaled = features.apply_scaler(wide, features.fit_scaler(wide, features.onehot_names(levels)))
    assert len(scaled.columns) == 5 and scaled.count() == 3


def test_onehot_bounds_and_long_form(spark):
    df = spark.createDataFrame([(k, f"v{k}") for k in range(50)], "k long, v string")
    with pytest.raises(ValueError, match="onehot_long"):
        features.fit_onehot(df, ["v"], max_levels=10)
    long = features.onehot_long(df, "k", ["v"], train=df.where("k < 30"))
    assert long.count() == 30 and {r.feature for r in long.collect()} == {f"v_v{k}" for k in range(30)}


def test_null_keys_and_labels_lose_no_row(spark):
    rows = [(k, None if k % 10 == 0 else k, None if k % 7 == 0 else k % 2) for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, k long, label int")
    split = stratified_split(df, "label", "k", 0.2, tie=["id"])
    assert split.count() == 1000
    for label, n in {None: 143, 0: 428, 1: 429}.items():
        part = split.where(F.col("label").eqNullSafe(F.lit(label)))
        assert part.count() == n and part.where("split = 'test'").count() == math.floor(0.2 * n + 0.5)
    folds = stratified_folds(df, "label", "k", 5, tie=["id"])
    assert folds.count() == 1000 and max(r["count"] for r in folds.groupBy("fold").count().collect()) <= 202
    assert stratified_folds(df, "label", "k", 5).count() == 1000     # ties broken by nothing else


def test_null_groups_are_groups(spark):
    rows = [(None if k % 3 == 0 else k % 3, float(k * 31 % 97), k % 2) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, s double, label int")
    assert {r.g for r in evaluate.rank_metrics(df, "s", "label", by=["g"], rows_per_bucket=20).collect()} == {None, 1, 2}
    assert {r.g for r in profile.box_stats(df, ["s"], by="g").collect()} == {None, 1, 2}
    j = join_null_safe(df, df.groupBy("g").count(), ["g"])
    assert j.count() == 300 and j.columns == ["g", "s", "label", "count"]


def test_lda_round_trip_is_equal(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k % 2), *map(float, rng.normal(k % 2, 1, 4))) for k in range(400)]
    df = spark.createDataFrame(rows, "label int, a double, b double, c double, d double")
    m = discriminant.fit_lda(df, ["a", "b", "c", "d"])
    back = discriminant.LDAModel.from_params(json.loads(json.dumps(m.to_params())))
    assert back == m and discriminant.fit_lda(df, ["a", "b", "c", "d"], priors=back.priors).coef == m.coef
    x = np.array([r[1:] for r in rows])
    y = np.array([r[0] for r in rows])
    sw = sum(np.cov(x[y == c].T) * ((y == c).sum() - 1) for c in (0, 1)) / 398
    assert np.allclose(m.coef, np.linalg.solve(sw, x[y == 1].mean(0) - x[y == 0].mean(0)))
    with pytest.raises(ValueError, match="classes 0 and 1"):
        discriminant.fit_lda(df.withColumn("label", F.col("label") + 1), ["a"])


def test_sweep_equals_clipping_one_rule_after_another(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.lognormal(3, 1, 2000), 1) + 1e5
    df = spark.createDataFrame([(float(x),) for x in v] + [(NAN,), (None,)], "v double")
    th = outlier.fit_candidates(df, "v")
    for r in outlier.sweep(df, "v", th).collect()[1:]:
        c = np.clip(v, r.lo, r.hi)
        z = (c - c.mean()) / c.std()
        g1, g2, n = (z ** 3).mean(), (z ** 4).mean() - 3, len(v)
        assert np.isclose(r.clipped_mean, c.mean()) and np.isclose(r.clipped_std, c.std(ddof=1))
        assert np.isclose(r.clipped_skew, g1 * math.sqrt(n * (n - 1)) / (n - 2), atol=1e-6)
        assert np.isclose(r.clipped_kurt, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6), atol=1e-6)
        assert (r.under_count, r.over_count, r.changed_count) == ((v < r.lo).sum(), (v > r.hi).sum(), (c != v).sum())
        assert (r.clipped_min, r.clipped_max) == (c.min(), c.max())
    plan = outlier.interval_sums(df, num("v"), [1.0, 2.0], 0.0)._jdf.queryExecution().toString()
    assert "Generate" not in plan
    assert outlier.sweep(df.where("v < 0"), "v", th).collect() == []


def test_cluster_needs_a_shared_folder():
    class Context:
        master = "yarn"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
