"""Wide pairs, densities, sketches and distinct counts against numpy."""

import math

import numpy as np
import pytest

from riskspark.operators import profile as P

NAN = float("nan")


def wide(spark, n=120, d=40):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, d)) * 10.0 ** rng.integers(-2, 6, d) + 1e4
    x[:, 3], x[:, 5] = 7.0, NAN                         # a constant column, one without values
    x[rng.random((n, d)) < 0.2] = NAN
    rows = [[None if k % 2 and math.isnan(v) else float(v) for v in r] for k, r in enumerate(x)]
    return x, spark.createDataFrame(rows, ", ".join(f"f{j} double" for j in range(d)))


def test_many_columns_pairwise_complete(spark):
    x, df = wide(spark)
    corr = {(r.f1, r.f2): r.corr for r in P.correlation(df, df.columns).collect()}
    cov = {(r.f1, r.f2): r.cov for r in P.covariance(df, df.columns).collect()}
    for i in range(x.shape[1]):
        for j in range(x.shape[1]):
            both = ~(np.isnan(x[:, i]) | np.isnan(x[:, j]))
            a, b = x[both, i], x[both, j]
            key = (f"f{i}", f"f{j}")
            if len(a) < 2:
                assert corr[key] is None and cov[key] is None
                continue
            assert np.isclose(cov[key], np.cov(a, b)[0, 1], rtol=1e-6, atol=1e-9 * a.std() * b.std() + 1e-9)
            if 3 in (i, j):
                assert corr[key] is None
            else:
                assert np.isclose(corr[key], np.corrcoef(a, b)[0, 1], atol=1e-9)


@pytest.mark.parametrize("points", [200, 5])
def test_density_equals_the_direct_sum(spark, points):
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(size=300), rng.normal(50, 0.01, 40), [1e3]])
    df = spark.createDataFrame([(float(a),) for a in v] + [(None,), (NAN,)], "v double")
    h = v.std(ddof=1) * len(v) ** -0.2
    for r in P.kde(df, "v", grid_size=points).collect():
        assert np.isclose(r.density, np.exp(-((r.x - v) / h) ** 2 / 2).sum() / (len(v) * h * math.sqrt(2 * math.pi)), rtol=1e-9, atol=1e-14)


def test_density_of_no_or_equal_values(spark):
    assert P.kde(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v").collect() == []
    assert P.kde(spark.createDataFrame([(None,)], "v double"), "v").collect() == []


def test_sketches_of_groups_merge(spark):
    df = spark.range(20_000).selectExpr("id % 7 as g", "cast(id as double) as v")
    out = P.rank_errors(df, "v", P.sketch_quantiles(df, "v", [0.1, 0.5, 0.99], "g")).collect()
    assert len(out) == 3 and all(r.error < 0.005 for r in out)
    assert P.sketch_quantiles(df.where("v < 0"), "v", [0.5], "g").collect() == []


def test_distinct_counts_without_a_wide_expand(spark):
    df = spark.createDataFrame([(1, 0.0, "a"), (1, -0.0, None), (2, NAN, "b"), (2, NAN, "a"), (None, 1.5, "")], "i int, x double, s string")
    out = P.distinct_counts(df, ["i", "x", "s"])
    assert {r.feature: r.n_distinct for r in out.collect()} == {"i": 2, "x": 3, "s": 3}
    assert "Expand" not in out._jdf.queryExecution().toString()
    assert {r.n_distinct for r in P.distinct_counts(df.where("i > 5"), ["i", "s"]).collect()} == {0}


def test_wide_correlation_of_no_rows(spark):
    cols = [f"c{i}" for i in range(30)]
    out = P.correlation(spark.createDataFrame([], ", ".join(f"{c} double" for c in cols)), cols).collect()
    assert len(out) == 900 and all(r["corr"] is None for r in out)


def _counted(spark, rows, schema):
    """A table and how many of its rows were computed so far."""
    seen = spark.sparkContext.accumulator(0)

    def touch(r):
        seen.add(1)
        return r

    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).map(touch), schema), seen


def test_box_stats_read_their_input_once(spark):
    rng = np.random.default_rng(3)
    rows = [([None, "a", "b"][k % 3], float(rng.normal()) ** 3 if k % 7 else None, float("nan") if k % 3 == 1 else float(k % 11)) for k in range(600)]
    df, seen = _counted(spark, rows, "`g.x` string, `v.w` double, z double")
    got = P.box_stats(df, ["v.w", "z"], by="g.x").collect()
    assert seen.value == 600
    assert {(r[0], r[1]) for r in got} == {(None, "v.w"), ("a", "v.w"), ("b", "v.w"), (None, "z"), ("b", "z")} and len(got) == 5
    for g, f, q1, q2, q3, lo, hi, n in got:
        x = np.array([r[1 if f == "v.w" else 2] for r in rows if r[0] == g and r[1 if f == "v.w" else 2] is not None])
        assert np.allclose([q1, q2, q3], np.quantile(x, [0.25, 0.5, 0.75]))
        inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
        assert (lo, hi, n) == (inside.min(), inside.max(), len(x) - len(inside))


def test_the_sweep_of_the_train_rows_joins_the_view_once(spark, monkeypatch):
    from riskspark.plans import q_outlier
    df, seen = _counted(spark, [("train" if k % 5 else "test", float(k * 37 % 101)) for k in range(500)], "split string, credit_amount double")
    monkeypatch.setattr(q_outlier, "split_loans", lambda spark, d: df)
    got = q_outlier.out5_sweep_loans_train(spark, None).collect()
    assert len(got) == 9 and got[0]["count"] == 400 and seen.value == 500
