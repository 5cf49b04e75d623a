"""PCA against numpy, k selection, LDA closed form."""

import numpy as np
import pytest

from riskspark.operators import discriminant as DA
from riskspark.operators import reduce as R


def _data(spark, d, n=400, seed=1):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + rng.normal(size=d) * 10
    cols = [f"f{i}" for i in range(d)]
    df = spark.createDataFrame([tuple(float(v) for v in row) for row in a], ", ".join(f"{c} double" for c in cols))
    return df, a, cols


@pytest.mark.parametrize("d", [5, 36])
def test_pca_matches_numpy(spark, d):
    df, a, cols = _data(spark, d)
    m = R.fit_pca(df, cols)
    vals, vecs = np.linalg.eigh(np.cov(a, rowvar=False))
    order = np.argsort(vals)[::-1]
    assert np.allclose(m.explained_variance, vals[order], rtol=1e-6, atol=1e-8)
    assert abs(sum(m.ratio) - 1.0) < 1e-12
    for i in range(3):  # well-separated leading components: equal up to sign
        assert np.allclose(np.abs(m.components[i]), np.abs(vecs[:, order[i]]), atol=1e-6)
        assert max(m.components[i], key=abs) > 0


def test_pca_scores_uncorrelated(spark):
    df, _, cols = _data(spark, 4)
    m = R.fit_pca(df, cols)
    s = np.array([tuple(r) for r in R.transform(df, m, 4).collect()])
    c = np.cov(s, rowvar=False)
    assert np.allclose(c - np.diag(np.diag(c)), 0, atol=1e-8)
    assert np.allclose(np.diag(c), m.explained_variance, rtol=1e-8)


def test_choose_k_rules():
    ratio = [0.3, 0.2, 0.3]  # cumulative .3 .5 .8, never reaches .95 / .9
    assert R.choose_k(ratio, 0.95, "min2", max_k=20) == 2
    assert R.choose_k(ratio, 0.90, "cap_d") == 3
    assert R.choose_k([0.96, 0.04], 0.95, "min2") == 2
    assert R.choose_k([0.5, 0.3, 0.2], 0.75, "cap_d") == 2


def test_interpret_naming_rules(spark):
    load = spark.createDataFrame([("PC1", "credit_amount_log", 0.9), ("PC1", "age", -0.1),
                                  ("PC2", "age", 0.7), ("PC2", "zzz", -0.2),
                                  ("PC3", "xx", 0.5), ("PC3", "yy", -0.6)],
                                 "component string, feature string, loading double")
    got = {r["component"]: r for r in R.interpret(load, 5).collect()}
    assert got["PC1"]["name"] == R.NAMING_RULES[0][1]
    assert got["PC2"]["name"] == R.NAMING_RULES[1][1]
    assert got["PC3"]["name"] == R.FALLBACK_PREFIX + "3"
    assert got["PC3"]["top_features"] == "yy, xx" and got["PC3"]["negative"] == "yy"


def test_lda_is_gaussian_log_posterior_ratio(spark):
    rng = np.random.default_rng(5)
    x0 = rng.normal(size=(300, 3))
    x1 = rng.normal(size=(120, 3)) + [1.0, 0.5, -0.5]
    x = np.vstack([x0, x1]) + 1000.0  # offset exercises the centring
    y = np.r_[np.zeros(300), np.ones(120)].astype(int)
    df = spark.createDataFrame([(int(b), *map(float, a)) for a, b in zip(x, y)], "label int, a double, b double, c double")
    m = DA.fit_lda(df, ["a", "b", "c"], "label")
    m0, m1 = x[y == 0].mean(0), x[y == 1].mean(0)
    sw = ((x[y == 0] - m0).T @ (x[y == 0] - m0) + (x[y == 1] - m1).T @ (x[y == 1] - m1)) / (len(y) - 2)
    w = np.linalg.solve(sw, m1 - m0)
    b = -(m1 + m0) @ w / 2 + np.log(120 / 300)
    assert np.allclose(m.coef, w, rtol=1e-7) and abs(m.intercept - b) < 1e-6


def test_lda_rank_deficient_uses_pinv(spark):
    rows = [(i % 2, float(i), float(2 * i)) for i in range(50)]
    df = spark.createDataFrame(rows, "label int, a double, b double")
    m = DA.fit_lda(df, ["a", "b"], "label")
    assert all(np.isfinite(m.coef))


def _wide_rows(n, d, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 4)) * np.array([5.0, 3.0, 2.0, 1.0])
    return base @ rng.normal(size=(4, d)) + rng.normal(size=(n, d)) * 0.1 + np.arange(d)


@pytest.mark.parametrize("d", [6, 120])
def test_truncated_components_match_the_full_decomposition(spark, d):
    x = _wide_rows(300, d)
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(900, None), (901, [1.0] * (d - 1)), (902, [float("nan")] + [0.0] * (d - 1)), (903, [None] + [0.0] * (d - 1))]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    m = R.fit_pca_truncated(df, 3, vector="v")
    vals, vecs = np.linalg.eigh(np.cov(x.T))
    assert m.n == 300 and len(m.components) == 3 and m.features[-1] == f"v_{d - 1}"
    np.testing.assert_allclose(m.explained_variance, vals[::-1][:3], rtol=1e-8)
    np.testing.assert_allclose(m.ratio, vals[::-1][:3] / vals.sum(), rtol=1e-8)
    for got, want in zip(m.components, vecs[:, ::-1].T):
        assert abs(abs(np.dot(got, want)) - 1) < 1e-8 and got[int(np.argmax(np.abs(got)))] > 0
    assert max(R.eigen_residuals(df, m, vector="v")) < 1e-8
    s = R.project_arrays(df, m, ["id"], vector="v").orderBy("id").toPandas()
    assert list(s["id"]) == list(range(300))
    np.testing.assert_allclose(s[["PC1", "PC2", "PC3"]].to_numpy(), (x - x.mean(0)) @ np.array(m.components).T, atol=1e-8)


def test_truncated_by_columns_names_with_dots_and_edges(spark):
    x = _wide_rows(50, 3)
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in x], "`a.b` double, c double, d double")
    m = R.fit_pca_truncated(df, 2, cols=["a.b", "c", "d"])
    full = R.fit_pca(df, ["a.b", "c", "d"])
    np.testing.assert_allclose(m.components, full.components[:2], atol=1e-8)
    assert len(R.fit_pca_truncated(df, 9, cols=["a.b", "c", "d"]).components) <= 3
    for rows in ([], [(1.0, 2.0, 3.0)], [(1.0, 2.0, 3.0)] * 4):
        e = R.fit_pca_truncated(spark.createDataFrame(rows, "x double, y double, z double"), 2, cols=["x", "y", "z"])
        assert e.n == len(rows) and e.explained_variance == [0.0, 0.0] and e.components == [[1.0, 0, 0], [0, 1.0, 0]]
    none = R.fit_pca_truncated(spark.createDataFrame([], "v array<double>"), 2, vector="v")
    assert none.n == 0 and none.components == []


@pytest.mark.parametrize("d", [3, 30])
def test_covariance_of_no_rows_is_zero(spark, d):
    cols = [f"c{i}" for i in range(d)]
    n, mean, cov = R.covariance(spark.createDataFrame([], ", ".join(f"{c} double" for c in cols)), cols)
    assert n == 0 and not mean.any() and cov.shape == (d, d) and not cov.any()


def test_products_of_a_row_are_computed_once(spark):
    rng = np.random.default_rng(2)
    x, vs = rng.normal(size=(50, 9)), rng.normal(size=(2, 9))
    got = R._products(spark.createDataFrame([([float(v) for v in r],) for r in x], "x array<double>"), vs.tolist())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("aggregate(zip_with") and plan.count("aggregate(zip_with") == 2
    rows = {r["j"]: (r["p0"], r["p1"]) for r in got.collect()}
    np.testing.assert_allclose([rows[j] for j in range(9)], x.T @ (x @ vs.T), atol=1e-10)


def test_word_shares_of_odd_documents(spark, tmp_path):
    import hashlib
    from riskspark.plans import q_reduce
    docs = [(1, "a b a"), (2, None), (3, " \t"), (4, "x"), (4, "y\ny"), (None, "z")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    shares = q_reduce._word_shares(spark, str(tmp_path))
    assert "map_from_entries" not in shares._jdf.queryExecution().toString()     # a map was searched once per bucket
    got = {r[0]: r[1] for r in shares.collect()}
    assert set(got) == {1, 4, None}
    for key, words in {1: "a b a", 4: "x y y", None: "z"}.items():
        want = np.zeros(128)
        for w in words.split():
            want[int(hashlib.md5(w.encode()).hexdigest()[:2], 16) % 128] += 1 / len(words.split())
        np.testing.assert_allclose(got[key], want)
