"""Exact ranking and classification metrics (WIN5, WIN6, EVL1-EVL3, MDL1).

Rank metrics first collapse equal scores into ``(score, pos, neg)`` rows
(map-side combine, so a hot score value is one row), then take running
positive/negative counts in descending score order with the two-level
window of :mod:`riskspark.operators.ranking`.

* ROC AUC (ties count half) = sum_s neg_s * (P_above(s) + pos_s / 2) / (P * N)
* average precision (step-wise, as in scikit-learn)
  = sum_s pos_s / P * TP(s) / (TP(s) + FP(s)),  counts inclusive of s
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.operators.ranking import ROWS_PER_BUCKET, running_totals
from riskspark.operators.columns import num


def rank_metrics(df: DataFrame, score: str, label: str = "label", by: Sequence[str] = (),
                 rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """WIN5 + WIN6: (by..., n_pos, n_neg, roc_auc, ap) per group."""
    by = list(by)
    y = F.col(label)
    g = (df.where(num(score).isNotNull() & y.isNotNull())
         .groupBy(*by, num(score).alias("_s"))
         .agg(F.sum((y == 1).cast("long")).alias("_p"), F.sum((y != 1).cast("long")).alias("_n")))
    # the collapsed scores feed the sizing job and both passes of the running totals:
    # kept while they do (a lost executor's part is recomputed from the input)
    g = g.persist()
    # one small job sizes the two-level window: rows to order and groups (for the broadcast bound)
    st = g.agg(F.count(F.lit(1)).alias("n"),
               (F.count_distinct(F.struct(*by)) if by else F.lit(1)).alias("k")).first()
    n_rows, n_groups = int(st["n"]), int(st["k"])
    c = running_totals(g, "_s", ["_p", "_n"], by=by, descending=True, rows_per_bucket=rows_per_bucket,
                       n_rows=n_rows, n_groups=n_groups)
    terms = c.select(*by, "_p", "_n",
                     (F.col("_n") * (F.col("cum__p") - F.col("_p") + F.col("_p") / 2.0)).alias("_auc"),
                     (F.col("_p") * F.col("cum__p") / (F.col("cum__p") + F.col("cum__n"))).alias("_ap"))
    agg = terms.groupBy(*by).agg(F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"),
                                 F.sum("_auc").alias("_auc"), F.sum("_ap").alias("_ap"))
    return agg.select(*by, "n_pos", "n_neg",
                      F.try_divide(F.col("_auc"), F.col("n_pos") * F.col("n_neg")).alias("roc_auc"),
                      F.try_divide(F.col("_ap"), F.col("n_pos")).alias("ap"))


def confusion(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ("split",)) -> DataFrame:
    """EVL2: long 2x2 confusion (by..., actual, predicted, n) with zero cells kept."""
    by = list(by)
    y, p = F.col(label), F.col(pred)
    agg = df.groupBy(*by).agg(*[F.count_if((y == a) & (p == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])
    parts = [F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(f"c{a}{b}").alias("n"))
             for a in (0, 1) for b in (0, 1)]
    return agg.select(*by, F.explode(F.array(*parts)).alias("_s")).select(*by, "_s.*")


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "pred",
                           by: Sequence[str] = ("split",)) -> DataFrame:
    """EVL1: accuracy, precision, recall, F1 per group; 0 on zero division."""
    by = list(by)
    y, p = F.col(label), F.col(pred)
    agg = df.groupBy(*by).agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                              F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))
    z = lambda e: F.coalesce(e, F.lit(0.0))
    prec = z(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")))
    rec = z(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")))
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return agg.select(*by, ((F.col("tp") + F.col("tn")).cast("double") / n).alias("accuracy"),
                      prec.alias("precision"), rec.alias("recall"),
                      z(F.try_divide(2 * prec * rec, prec + rec)).alias("f1"))


def class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """MDL1: balanced weights n / (k * n_c) per class, as a small table."""
    from pyspark.sql import Window
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()  # over the per-class table (one row per class), never over the data
    return g.select(label, "n_c", (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c"))).alias(out))
