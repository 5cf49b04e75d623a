"""Exact stratified split and folds."""

from pyspark.sql import functions as F

from riskspark.operators.split import stratified_folds, stratified_split


def _frame(spark, n=2003):
    return spark.createDataFrame([(i, 1 if i % 5 == 0 else 0) for i in range(n)], "k long, label int")


def test_split_sizes_per_label(spark):
    df = _frame(spark)
    s = stratified_split(df, "label", "k", 0.2, 42, buckets=37)
    got = {(r["label"], r["split"]): r["n"] for r in s.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    n1, n0 = 401, 1602
    assert got[(1, "test")] == round(0.2 * n1) and got[(0, "test")] == round(0.2 * n0)
    assert got[(1, "train")] + got[(1, "test")] == n1


def test_split_independent_of_bucketing(spark):
    df = _frame(spark)
    a = {r["k"] for r in stratified_split(df, "label", "k", buckets=1).where("split = 'test'").collect()}
    b = {r["k"] for r in stratified_split(df.repartition(5), "label", "k", buckets=29).where(
        "split = 'test'").collect()}
    assert a == b


def test_folds_balanced(spark):
    f = stratified_folds(_frame(spark), "label", "k", 5, buckets=41)
    sizes = {(r["label"], r["fold"]): r["n"] for r in f.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}
    for lab in (0, 1):
        counts = [sizes[(lab, i)] for i in range(5)]
        assert max(counts) - min(counts) <= 1
