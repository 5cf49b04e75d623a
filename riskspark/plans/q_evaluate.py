"""Registered split, fold and evaluation queries (WIN3-WIN6, EVL1-EVL3, MDL1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.operators import evaluate as EV
from riskspark.operators.split import stratified_folds, stratified_split
from riskspark.plans.fixtures import LABELED_DOCS_SQL, LABELED_SQL, LOAN_VIEW_SQL, SPLIT_SEED, labeled_docs, \
    labeled_loans, split_loans, split_sql, with_cte
from riskspark.plans.registry import register, rounded, rsql

_LOAN_PRE = (LOAN_VIEW_SQL, LABELED_SQL, split_sql("labeled"))
_DOC_PRE = (LABELED_DOCS_SQL, split_sql("labeled_docs", key="doc_id"))
#: threshold rule used as a stand-in classifier on documents
DOC_PRED_CHARS = 1000


@register("win3_stratified_split", with_cte(*_LOAN_PRE) + "\nSELECT row_id, label, split FROM splitted")
def win3_stratified_split(spark, d):
    return split_loans(spark, d).select("row_id", "label", "split")


@register("win3_split_sizes", with_cte(*_LOAN_PRE) + """
SELECT label, split, CAST(count(*) AS BIGINT) AS n FROM splitted GROUP BY label, split""")
def win3_split_sizes(spark, d):
    return split_loans(spark, d).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@register("win3_split_multibucket", with_cte(*_LOAN_PRE) + "\nSELECT row_id, label, split FROM splitted")
def win3_split_multibucket(spark, d):
    # same split, forced through many hash buckets (the path taken at scale)
    return stratified_split(labeled_loans(spark, d), "label", "row_id", 0.2, SPLIT_SEED,
                            buckets=16).select("row_id", "label", "split")


_FOLDS_SQL = with_cte(LOAN_VIEW_SQL, LABELED_SQL) + f"""
SELECT row_id, label,
       CAST((row_number() OVER (PARTITION BY label ORDER BY md5('{SPLIT_SEED}|' || CAST(row_id AS VARCHAR)), row_id)
             - 1) % 5 AS INTEGER) AS fold
FROM labeled"""


@register("win4_stratified_folds", _FOLDS_SQL)
def win4_stratified_folds(spark, d):
    return stratified_folds(labeled_loans(spark, d), "label", "row_id", 5, SPLIT_SEED).select("row_id", "label",
                                                                                             "fold")


@register("win4_folds_multibucket", _FOLDS_SQL)
def win4_folds_multibucket(spark, d):
    return stratified_folds(labeled_loans(spark, d), "label", "row_id", 5, SPLIT_SEED,
                            buckets=16).select("row_id", "label", "fold")


def _rank_sql(src: str, score: str, by: str) -> str:
    return f"""
g AS (SELECT {by}, CAST({score} AS DOUBLE) AS s, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS p,
             sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS n
      FROM {src} WHERE {score} IS NOT NULL AND label IS NOT NULL GROUP BY {by}, s),
c AS (SELECT *, sum(p) OVER (PARTITION BY {by} ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cp,
             sum(n) OVER (PARTITION BY {by} ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cn FROM g)
SELECT {by}, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg,
       sum(n * (cp - p + p / 2.0)) / (sum(p) * sum(n)) AS roc_auc, sum(p * cp / (cp + cn)) / sum(p) AS ap
FROM c GROUP BY {by}"""


def _rank_query(pre, src, score, by):
    body = _rank_sql(src, score, by)
    head, tail = body.rsplit("\nSELECT", 1)
    return rsql(with_cte(*pre, head) + "\nSELECT" + tail, ["roc_auc", "ap"])


@register("win5_win6_rank_metrics_loans", _rank_query(_LOAN_PRE, "splitted", "credit_amount", "split"))
def win5_win6_rank_metrics_loans(spark, d):
    return rounded(EV.rank_metrics(split_loans(spark, d), "credit_amount", "label", by=["split"]))


@register("win5_win6_rank_metrics_docs", _rank_query((LABELED_DOCS_SQL,), "labeled_docs", "n_chars", "lang"))
def win5_win6_rank_metrics_docs(spark, d):
    return rounded(EV.rank_metrics(labeled_docs(spark, d), "n_chars", "label", by=["lang"]))


@register("win5_win6_rank_metrics_multibucket", _rank_query(_LOAN_PRE, "splitted", "credit_amount", "split"))
def win5_win6_rank_metrics_multibucket(spark, d):
    return rounded(EV.rank_metrics(split_loans(spark, d), "credit_amount", "label", by=["split"],
                                   rows_per_bucket=300))


def _doc_pred(df):
    return df.withColumn("pred", (F.col("n_chars") > DOC_PRED_CHARS).cast("int"))


_PRED_SQL = f"pred AS (SELECT *, CAST(n_chars > {DOC_PRED_CHARS} AS INTEGER) AS pred FROM splitted)"


@register("evl1_classification_metrics", rsql(with_cte(*_DOC_PRE, _PRED_SQL, """
t AS (SELECT split, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp,
             count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
             count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn,
             count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn FROM pred GROUP BY split),
m AS (SELECT split, tp, fp, fn, tn,
             coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
             coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall FROM t)""") + """
SELECT split, CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS accuracy, precision, recall,
       coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m""",
    ["accuracy", "precision", "recall", "f1"]))
def evl1_classification_metrics(spark, d):
    s = stratified_split(labeled_docs(spark, d), "label", "doc_id", 0.2, SPLIT_SEED)
    return rounded(EV.classification_metrics(_doc_pred(s), "label", "pred", by=["split"]))


@register("evl1_no_positive_predictions", rsql(with_cte(LABELED_DOCS_SQL) + """
SELECT lang, CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) / count(*) AS accuracy, 0.0 AS precision,
       0.0 AS recall, 0.0 AS f1 FROM labeled_docs GROUP BY lang""", ["accuracy", "precision", "recall", "f1"]))
def evl1_no_positive_predictions(spark, d):
    df = labeled_docs(spark, d).withColumn("pred", F.lit(0))
    return rounded(EV.classification_metrics(df, "label", "pred", by=["lang"]))


@register("evl2_confusion", with_cte(*_DOC_PRE, _PRED_SQL) + """,
cells AS (SELECT a AS actual, b AS predicted FROM (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(b)),
sp AS (SELECT DISTINCT split FROM pred)
SELECT sp.split, cells.actual, cells.predicted,
       CAST((SELECT count(*) FROM pred p WHERE p.split = sp.split AND p.label = cells.actual
             AND p.pred = cells.predicted) AS BIGINT) AS n
FROM sp, cells""")
def evl2_confusion(spark, d):
    s = stratified_split(labeled_docs(spark, d), "label", "doc_id", 0.2, SPLIT_SEED)
    return EV.confusion(_doc_pred(s), "label", "pred", by=["split"])


@register("evl3_rank_metrics_by_split", _rank_query(_DOC_PRE, "splitted", "n_chars", "split"))
def evl3_rank_metrics_by_split(spark, d):
    s = stratified_split(labeled_docs(spark, d), "label", "doc_id", 0.2, SPLIT_SEED)
    return rounded(EV.rank_metrics(s, "n_chars", "label", by=["split"]))


@register("mdl1_class_weights", rsql(with_cte(LABELED_DOCS_SQL) + """
SELECT label, CAST(count(*) AS BIGINT) AS n_c,
       sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM labeled_docs GROUP BY label""",
    ["weight"]))
def mdl1_class_weights(spark, d):
    return rounded(EV.class_weights(labeled_docs(spark, d), "label"))
