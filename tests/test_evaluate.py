"""Rank and classification metrics (FIXTURES F4)."""

import numpy as np

from riskspark.operators import evaluate as EV


def test_tied_scores_auc_ap(spark):
    rows = list(zip([.9, .8, .7, .7, .6, .3, .2], [1, 0, 1, 0, 1, 0, 1]))
    df = spark.createDataFrame(rows, "score double, label int")
    r = EV.rank_metrics(df, "score", "label", rows_per_bucket=2).first()
    assert abs(r["roc_auc"] - 0.458333) < 1e-6
    assert abs(r["ap"] - 0.667857) < 1e-6
    assert (r["n_pos"], r["n_neg"]) == (4, 3)


def test_auc_matches_pairwise_definition(spark):
    rng = np.random.default_rng(3)
    s = np.round(rng.normal(size=600), 1)
    y = (rng.random(600) < 0.3).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, label int")
    got = EV.rank_metrics(df, "score", "label", rows_per_bucket=50).first()["roc_auc"]
    pos, neg = s[y == 1], s[y == 0]
    ref = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(got - ref) < 1e-12


def test_no_positive_predictions(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 0, 0)], "split string, label int, pred int")
    r = EV.classification_metrics(df).first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0.0, 0.0, 0.0, 0.5)


def test_confusion_keeps_zero_cells(spark):
    df = spark.createDataFrame([("a", 1, 1)], "split string, label int, pred int")
    cells = {(r["actual"], r["predicted"]): r["n"] for r in EV.confusion(df).collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 1}
