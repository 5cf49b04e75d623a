"""Registered queries over data with NaN, NULL keys and NULL groups, integer columns
and dotted names: nothing may be lost or counted as a value."""

from __future__ import annotations


from pyspark.sql import functions as F

from riskspark.operators import evaluate as EV
from riskspark.operators import features as FE
from riskspark.operators import outlier as O
from riskspark.operators import profile as P
from riskspark.operators import schema as SC
from riskspark.operators.split import stratified_folds, stratified_split
from riskspark.plans.fixtures import LABELED_SQL, LOAN_VIEW_SQL, NUMERIC_COLS, labeled_loans, table, with_cte
from riskspark.plans.q_io import scratch
from riskspark.plans.q_outlier import _sweep_sql
from riskspark.plans.registry import register, rounded, rsql
from riskspark.sources import io

_NAN_SQL = "CASE WHEN event_id % 97 = 0 OR event_id % 89 = 0 THEN NULL ELSE value END"


def nan_events(spark, d):
    """``events`` with NaN in some values and NULL in others, through a parquet stage."""
    e = table(spark, d, "events")
    v = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).when(F.col("event_id") % 89 != 0, F.col("value"))
    path = scratch(spark, "nan_events") + ".parquet"
    io.write_table(e.select("event_id", v.alias("value"), (F.col("value") / 2).alias("half")), path)
    return io.read_table(spark, path)


@register("agg2_missing_nan", rsql(f"""
SELECT 'value' AS feature, count(*) - count(v) AS missing_count, 100.0 * (count(*) - count(v)) / count(*) AS missing_pct
FROM (SELECT {_NAN_SQL} AS v FROM events)
UNION ALL SELECT 'half', count(*) - count(value), 100.0 * (count(*) - count(value)) / count(*) FROM events""", ["missing_pct"]))
def agg2_missing_nan(spark, d):
    return rounded(P.missing_summary(nan_events(spark, d), ["value", "half"]))


@register("agg1_describe_nan", rsql(f"""
SELECT 'value' AS feature, count(v) AS count, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, quantile_cont(v, 0.25) AS p25,
       quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, max(v) AS max, count(*) - count(v) AS nan_count
FROM (SELECT {_NAN_SQL} AS v FROM events)""", ["mean", "std", "min", "p25", "p50", "p75", "max"]))
def agg1_describe_nan(spark, d):
    return rounded(P.describe_numeric(nan_events(spark, d), ["value"]))


@register("agg9_moments_nan", rsql(f"""
SELECT 'value' AS feature, count(v) AS count, avg(v) AS mean, stddev_samp(v) AS std, skewness(v) AS skew, kurtosis(v) AS kurtosis,
       min(v) AS min, max(v) AS max, bool_and(v >= 0) AS all_nonneg FROM (SELECT {_NAN_SQL} AS v FROM events)""",
    ["mean", "std", "skew", "kurtosis", "min", "max"]))
def agg9_moments_nan(spark, d):
    return rounded(P.moments(nan_events(spark, d), ["value"]))


@register("out5_sweep_nan", _sweep_sql(f"SELECT v AS x FROM (SELECT {_NAN_SQL} AS v FROM events) WHERE v IS NOT NULL", "value"))
def out5_sweep_nan(spark, d):
    return rounded(O.winsorize_sweep(nan_events(spark, d), "value"))


# --------------------------------------------------------- NULL keys, NULL groups

_KEYED_SQL = """
keyed AS (SELECT row_id, label, CASE WHEN row_id % 97 = 0 THEN NULL ELSE row_id END AS k FROM labeled),
hashed AS (SELECT *, md5('42|' || coalesce(CAST(k AS VARCHAR), 'null|' || CAST(row_id AS VARCHAR))) AS h FROM keyed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, k NULLS FIRST, row_id) AS rk,
                  count(*) OVER (PARTITION BY label) AS n FROM hashed)"""


def _keyed(spark, d):
    return labeled_loans(spark, d).select("row_id", "label", F.when(F.col("row_id") % 97 != 0, F.col("row_id")).alias("k"))


@register("win3_split_null_keys", with_cte(LOAN_VIEW_SQL, LABELED_SQL, _KEYED_SQL) + """
SELECT row_id, label, CASE WHEN rk <= round(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM ranked""")
def win3_split_null_keys(spark, d):
    return stratified_split(_keyed(spark, d), "label", "k", 0.2, 42, tie=["row_id"]).select("row_id", "label", "split")


@register("win4_folds_null_keys", with_cte(LOAN_VIEW_SQL, LABELED_SQL, _KEYED_SQL) + """
SELECT row_id, label, CAST((rk - 1) % 5 AS INTEGER) AS fold FROM ranked""")
def win4_folds_null_keys(spark, d):
    return stratified_folds(_keyed(spark, d), "label", "k", 5, 42, tie=["row_id"]).select("row_id", "label", "fold")


_GROUPED = "CASE WHEN row_id % 5 = 0 THEN NULL ELSE CAST(row_id % 3 AS VARCHAR) END"


def _grouped(spark, d):
    return labeled_loans(spark, d).withColumn("grp", F.when(F.col("row_id") % 5 != 0, (F.col("row_id") % 3).cast("string")))


@register("win5_rank_metrics_null_group", rsql(with_cte(LOAN_VIEW_SQL, LABELED_SQL, f"""
g AS (SELECT {_GROUPED} AS grp, credit_amount AS s, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS p,
             sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS n FROM labeled WHERE credit_amount IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(p) OVER (PARTITION BY grp ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cp,
             sum(n) OVER (PARTITION BY grp ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cn FROM g)""") + """
SELECT grp, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg,
       sum(n * (cp - p + p / 2.0)) / (sum(p) * sum(n)) AS roc_auc, sum(p * cp / (cp + cn)) / sum(p) AS ap
FROM c GROUP BY grp""", ["roc_auc", "ap"]))
def win5_rank_metrics_null_group(spark, d):
    return rounded(EV.rank_metrics(_grouped(spark, d), "credit_amount", "label", by=["grp"], rows_per_bucket=500))


_BOX = ["credit_amount", "age"]


@register("agg18_box_null_group", rsql(with_cte(LOAN_VIEW_SQL, LABELED_SQL, f"""
lng AS ({' UNION ALL '.join(f"SELECT {_GROUPED} AS grp, '{c}' AS feature, {c} AS v FROM labeled WHERE {c} IS NOT NULL" for c in _BOX)}),
q AS (SELECT grp, feature, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
      FROM lng GROUP BY grp, feature),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)""") + """
SELECT f.grp, f.feature, q1, median, q3, min(v) FILTER (WHERE v >= lo AND v <= hi) AS whisker_lo,
       max(v) FILTER (WHERE v >= lo AND v <= hi) AS whisker_hi, count(*) FILTER (WHERE NOT (v >= lo AND v <= hi)) AS n_outliers
FROM f JOIN lng ON f.grp IS NOT DISTINCT FROM lng.grp AND f.feature = lng.feature
GROUP BY f.grp, f.feature, q1, median, q3""", ["q1", "median", "q3", "whisker_lo", "whisker_hi"]))
def agg18_box_null_group(spark, d):
    return rounded(P.box_stats(_grouped(spark, d), _BOX, by="grp"))


# ----------------------------------------------- integers, dots, text columns

@register("fe7_median_impute_int", rsql("""
WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 <> 0 THEN CAST(l_quantity AS INTEGER) % 2 + 2 END AS q
           FROM lineitem WHERE l_linenumber <= 4),
e AS (SELECT * FROM s UNION ALL SELECT -1, k, k FROM (VALUES (2), (3)) t(k)),
m AS (SELECT median(q) AS m FROM (SELECT q FROM e WHERE l_orderkey < 0))
SELECT l_orderkey, l_linenumber, coalesce(CAST(q AS DOUBLE), m) AS q FROM s, m""", ["q"]))
def fe7_median_impute_int(spark, d):
    """The median of the integers 2 and 3 is 2.5 and stays that in an integer column."""
    s = table(spark, d, "lineitem").where("l_linenumber <= 4").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity").cast("int") % 2 + 2).alias("q"))
    fit_on = table(spark, d, "region").where("r_regionkey < 2").select((F.col("r_regionkey").cast("int") + 2).alias("q"))
    return rounded(FE.apply_impute(s, FE.fit_medians(fit_on, ["q"])))


@register("tgt2_normalize_dotted", with_cte(LOAN_VIEW_SQL) + """
SELECT row_id, CASE WHEN class = 'bad' THEN 1 ELSE 0 END AS label, 'default.payment.next.month' AS target FROM loan_view""")
def tgt2_normalize_dotted(spark, d):
    from riskspark.plans.fixtures import loan_view
    lv = loan_view(spark, d).select("row_id", F.col("class").alias("default.payment.next.month"), "age")
    target = SC.identify_target(lv, "eda")
    return SC.normalize_target(lv, target).select("row_id", "label", F.lit(target).alias("target"))


@register("prj6_coerce_all", """
SELECT o_orderkey, TRY_CAST(o_orderstatus AS DOUBLE) AS status, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority FROM orders""")
def prj6_coerce_all(spark, d):
    """No numeric column: all are coerced, text that is no number becomes missing."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_orderstatus").alias("status"),
                                         F.substring("o_orderpriority", 1, 1).alias("priority"))
    out, cols = SC.numeric_or_coerced(o)
    assert cols == o.columns
    return out.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "status", "priority")


@register("fe6_onehot_long", with_cte(LOAN_VIEW_SQL) + """
SELECT row_id, 'employment_' || coalesce(employment, 'nan') AS feature, 1.0 AS value FROM loan_view
UNION ALL SELECT row_id, 'row_id_' || CAST(row_id AS VARCHAR), 1.0 FROM loan_view""")
def fe6_onehot_long(spark, d):
    """A column of as many levels as rows (no wide form would do) beside an ordinary one."""
    from riskspark.plans.fixtures import loan_view
    lv = loan_view(spark, d).select("row_id", "employment")
    return FE.onehot_long(lv, "row_id", ["employment", "row_id"], train=lv)


# --------------------------------------------------------------- report digest



@register("snk4_digest", with_cte(LOAN_VIEW_SQL, LABELED_SQL, """
cols AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, var_samp({c}) AS v, count(*) - count({c}) AS miss, count(*) AS n FROM labeled"
                                  for c in NUMERIC_COLS) + """),
tv AS (SELECT feature, v, row_number() OVER (ORDER BY v DESC, feature) AS rk FROM cols),
tm AS (SELECT feature, miss, n, row_number() OVER (ORDER BY miss DESC, feature) AS rk FROM cols)""") + """
SELECT 'shape' AS section, 1 AS ord, 'rows' AS key, CAST(count(*) AS VARCHAR) AS value FROM labeled
UNION ALL SELECT 'shape', 2, 'columns', '14' FROM (SELECT 1)
UNION ALL SELECT DISTINCT 'mapping', 1 + label, class, CAST(label AS VARCHAR) FROM labeled
UNION ALL SELECT 'top variance', CAST(rk AS INTEGER), feature, CAST(CAST(round(v, 0) AS BIGINT) AS VARCHAR) FROM tv WHERE rk <= 10
UNION ALL SELECT 'missing', CAST(rk AS INTEGER), feature, CAST(miss AS VARCHAR) FROM tm WHERE rk <= 20""")
def snk4_digest(spark, d):
    """The text report as a table: shape, target mapping, largest variances, most
    missing columns; written by the sink and read back."""
    df = labeled_loans(spark, d)
    rows = [("shape", k + 1, name, str(v)) for k, (name, v) in enumerate(P.shape(df).first().asDict().items())]
    rows += [("mapping", 1 + r["label"], r["value"], str(r["label"])) for r in SC.target_mapping(df, "class").collect()]
    rows += [("top variance", k + 1, r["feature"], str(round(r["variance"])))
             for k, r in enumerate(P.top_variance(df, NUMERIC_COLS, 10).collect())]
    rows += [("missing", k + 1, r["feature"], str(r["missing_count"]))
             for k, r in enumerate(P.missing_summary(df, NUMERIC_COLS).limit(20).collect())]
    path = scratch(spark, "digest")
    io.write_report(spark, rows, path)
    return spark.read.parquet(path)


