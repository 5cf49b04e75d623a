"""Edge cases of the scalar builders (FIXTURES F4)."""

from pyspark.sql import functions as F

from riskspark.functions import scalar as S


def _col(spark, vals, fn, typ="double"):
    df = spark.createDataFrame([(v,) for v in vals], f"x {typ}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_clip_keeps_missing(spark):
    assert _col(spark, [None, 0.0, 5.0, 10.0], lambda c: S.clip(c, 1, 9)) == [None, 1.0, 5.0, 9.0]


def test_cut_right_closed(spark):
    got = _col(spark, [0.0, 25.0, 25.5, 35.0, 50.0, 120.0, 121.0, -1.0, None], S.cut_right)
    assert got == ["<25", "<25", "25-34", "25-34", "35-49", "50+", None, None, None]


def test_flag_missing_is_zero(spark):
    assert _col(spark, [None, 3.0, 4.0], lambda c: S.flag(c, 3, ">")) == [0, 0, 1]
    assert _col(spark, [None, 3.0, 4.0], lambda c: S.flag(c, 3, ">=")) == [0, 1, 1]


def test_safe_div_and_zero_to_one(spark):
    assert _col(spark, [0.0, 2.0], lambda c: S.ratio(F.lit(10.0), c))[0] == 10.0 / (1 + 1e-8)
    assert _col(spark, [0.0, 2.0], lambda c: S.safe_div(F.lit(10.0), c))[1] == 10.0 / (2 + 1e-8)


def test_log1p_and_posterior(spark):
    assert _col(spark, [-1.0, 0.0], S.log1p) == [None, 0.0]
    assert _col(spark, [0.0], S.posterior) == [0.5]


def test_to_double_tolerates_text(spark):
    assert _col(spark, ["1.5", "abc", None], S.to_double, "string") == [1.5, None, None]


def test_target_rules(spark):
    vals = ["bad", "good", " Yes ", "1", "t", "default", "TRUE", "10", None]
    strict = _col(spark, vals, lambda c: S.target_rule(c, "contains_strict"), "string")
    loose = _col(spark, vals, lambda c: S.target_rule(c, "contains_loose"), "string")
    exact = _col(spark, vals, lambda c: S.target_rule(c, "exact"), "string")
    assert strict == [1, 0, 1, 1, 1, 0, 1, 0, None]
    assert loose == [1, 0, 1, 1, 1, 1, 1, 1, None]
    assert exact == [1, 0, 0, 1, 1, 0, 1, 0, None]


def test_lookup_default(spark):
    got = _col(spark, ["a", "b", "z"], lambda c: S.lookup(c, {"a": 0, "b": 1}), "string")
    assert got == [0, 1, None]
