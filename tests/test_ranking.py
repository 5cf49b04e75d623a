"""Exact percentiles and two-level running totals against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.operators import ranking


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    vals = np.round(rng.lognormal(3, 1, 3000), 1)  # many ties
    grp = rng.integers(0, 3, 3000)
    rows = [(int(g), float(v) if i % 50 else None) for i, (g, v) in enumerate(zip(grp, vals))]
    return spark.createDataFrame(rows, "g int, v double"), rows


QS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("rows", [1_000_000, 400, 7])
def test_percentiles_match_numpy(data, rows):
    """The same way with and without narrowing rounds."""
    df, raw = data
    got = ranking.percentiles(df, ["v"], QS, bracket_rows=rows)[()]["v"]
    ref = np.quantile([v for _, v in raw if v is not None], QS)
    assert np.allclose(got, ref, rtol=0, atol=1e-9)


@pytest.mark.parametrize("rows", [1_000_000, 50])
def test_null_group_and_nan(spark, rows):
    raw = [(None if k % 5 == 0 else k % 2, float("nan") if k % 11 == 0 else None if k % 13 == 0 else float(k * 37 % 101)) for k in range(600)]
    df = spark.createDataFrame(raw, "`g.x` int, `v.w` double").withColumn("none", F.lit(None).cast("double"))
    got = ranking.percentiles(df.withColumnRenamed("g.x", "g"), ["v.w", "none"], [0.25, 0.5], by=["g"], bracket_rows=rows)
    assert set(got) == {(None,), (0,), (1,)}
    for g in (None, 0, 1):
        ref = np.quantile([v for k, v in raw if k == g and v is not None and v == v], [0.25, 0.5])
        assert np.allclose(got[(g,)]["v.w"], ref) and got[(g,)]["none"] == [None, None]


def test_no_rows(spark):
    assert ranking.percentiles(spark.createDataFrame([], "v double"), ["v"], [0.5]) == {(): {"v": [None]}}


def test_no_value_map_meets_in_one_task(data):
    df, _ = data
    plan = ranking.percentile_table(df, ["v"], QS)._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "SinglePartition" not in plan


def test_grouped_rank_percentiles(data):
    df, rows = data
    got = ranking.percentiles(df, ["v"], [0.5, 0.75], by=["g"])
    for g in range(3):
        ref = np.quantile([v for gg, v in rows if gg == g and v is not None], [0.5, 0.75])
        assert np.allclose(got[(g,)]["v"], ref)


def test_running_totals_multibucket(spark):
    rows = [(i, float(i % 13)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, w double")
    out = ranking.running_totals(df, "k", ["w"], rows_per_bucket=97).orderBy("k").collect()
    assert np.allclose([r["cum_w"] for r in out], np.cumsum([w for _, w in rows]))
    desc = ranking.running_totals(df, "k", ["w"], descending=True, rows_per_bucket=97).orderBy(F.desc("k")).collect()
    assert np.allclose([r["cum_w"] for r in desc], np.cumsum([w for _, w in rows][::-1]))


def test_same_result_after_repartition(data):
    df, _ = data
    a = ranking.percentiles(df, ["v"], QS)[()]["v"]
    b = ranking.percentiles(df.repartition(7), ["v"], QS)[()]["v"]
    assert a == b


def test_bracket_matches_numpy_many_columns(spark):
    rng = np.random.default_rng(9)
    n = 5000
    a = np.round(rng.normal(size=n), 3)
    b = rng.integers(0, 5, n).astype(float)  # heavy ties
    c = np.where(rng.random(n) < 0.1, np.nan, rng.lognormal(size=n))
    rows = [(float(x), float(y), None if np.isnan(z) else float(z)) for x, y, z in zip(a, b, c)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    qs = [0.0, 0.001, 0.25, 0.5, 0.99, 1.0]
    got = ranking.percentiles(df, ["a", "b", "c"], qs)[()]
    for name, v in (("a", a), ("b", b), ("c", c[~np.isnan(c)])):
        assert np.allclose(got[name], np.quantile(v, qs), atol=1e-12)


@pytest.mark.parametrize("rows", [1_000_000, 150])
def test_narrowing_of_any_distribution(spark, rows):
    """Far tails, both signs, infinite values, heavy ties and neighbouring doubles."""
    rng = np.random.default_rng(5)
    inf = float("inf")
    vals = [*(rng.choice([-1, 1], 300) * 10.0 ** rng.uniform(-300, 300, 300)), *[7.0] * 200, *(1.0 + np.arange(200) * 2.3e-16),
            *[-inf] * 5, *[inf] * 5, *[0.0, -0.0] * 20]
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    qs = [0.0, 0.01, 0.2, 0.45, 0.5, 0.55, 0.6, 0.9, 0.99]
    got = ranking.percentiles(df, ["v"], qs, bracket_rows=rows)[()]["v"]
    x = sorted(vals)
    for q, g in zip(qs, got):
        h = (len(x) - 1) * q
        lo, hi = x[int(np.floor(h))], x[int(np.ceil(h))]
        if np.isinf(lo):        # interpolated between equal infinities, as ever
            assert np.isnan(g), q
        else:
            assert g == lo + (h - np.floor(h)) * (hi - lo), q


@pytest.mark.parametrize("rows", [20])
def test_filled_percentiles_of_all_but_one_fold(spark, rows):
    """Ranks shifted by the missing values, counts added up over the other folds."""
    rng = np.random.default_rng(6)
    raw = [(k % 3, None if k % 7 == 0 else float(rng.integers(0, 40)), None if k % 3 else float(k % 5)) for k in range(400)]
    df = spark.createDataFrame(raw, "fold int, a double, b double")
    qs = [0.5, 0.0, 0.01, 0.4, 0.99]
    got = ranking.percentiles(df, ["a", "b"], qs, bracket_rows=rows, without="fold", fill=True)
    assert sorted(got) == [(0,), (1,), (2,)]
    for (f,), per in got.items():
        for c, name in ((1, "a"), (2, "b")):
            mine = [r[c] for r in raw if r[0] != f]
            have = [v for v in mine if v is not None]
            if not have:
                assert per[name] == [None] * 5
                continue
            filled = [np.median(have) if v is None else v for v in mine]
            assert np.allclose(per[name], np.quantile(filled, qs), rtol=0, atol=1e-12), (f, name)


@pytest.mark.parametrize("rows", [1_000_000, 30])
def test_groups_placed_alike_whatever_their_scales(spark, rows):
    """Groups share their places: tiny, huge, equal, infinite and NULL-keyed ones keep their own ranks."""
    rng = np.random.default_rng(8)
    per = {"tiny": rng.integers(0, 50, 200) * 5e-324, "near": 1e-250 + rng.integers(0, 90, 200) * 2e-266, "huge": rng.uniform(-8e307, 8e307, 200),
           "one": np.full(200, 3.0), None: rng.normal(size=200), "inf": np.array([float("-inf")] * 50 + [1.0, 2.0] * 50 + [float("inf")] * 50)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in per.items() for v in vs], "g string, v double").repartition(5)
    got = ranking.percentiles(df, ["v"], [0.3, 0.5, 0.7], by=["g"], bracket_rows=rows)
    for g, vs in per.items():
        x = np.sort(vs)
        for q, v in zip([0.3, 0.5, 0.7], got[(g,)]["v"]):
            h = (len(x) - 1) * q
            lo, hi = x[int(np.floor(h))], x[int(np.ceil(h))]
            assert v == lo + (h - np.floor(h)) * (hi - lo), (g, q)


def test_values_join_their_brackets_by_one_long_key(spark):
    """Of the two null-safe keys that a bracket's feature made, each value paid several times the plain join."""
    src = spark.range(100).selectExpr("cast(id % 3 as int) as _f", "cast(id as double) as _v")
    spans = ranking._spans(src.groupBy("_f").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    placed = ranking._with_place(ranking._join_cells(src, spans, 3, ["_f"]), "_p0")
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "as bigint" in plan[plan.index("HashedRelationBroadcastMode"):] and "isnull(_f" not in plan
    ends = placed.groupBy("_f").agg(F.min("_p0"), F.max("_p0"), F.count_distinct("_p0")).collect()
    assert all(r[1] == 0 and r[2] >= ranking.PLACES - 1 and r[3] >= 33 for r in ends)
