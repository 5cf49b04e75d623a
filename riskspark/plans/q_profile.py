"""Registered profiling queries (AGG*, TOP*, SRT1, SMP*) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.operators import profile as P
from riskspark.plans.fixtures import LABELED_SQL, LOAN_VIEW_SQL, NUMERIC_COLS, labeled_loans, loan_view, \
    loans_table, table, with_cte
from riskspark.plans.registry import register, rounded, rsql

LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LOAN_CATS = ["savings_status", "employment", "purpose", "housing", "class"]
AGG7_QS = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


def _ua(parts):
    return "\nUNION ALL\n".join(parts)


# ---------------------------------------------------------------- AGG1
_agg1_sql = rsql(_ua([
    f"SELECT '{c}' AS feature, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
    f"min({c}) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, "
    f"quantile_cont({c}, 0.75) AS p75, max({c}) AS max, count(*) - count({c}) AS nan_count FROM lineitem"
    for c in LI_COLS]), ["mean", "std", "min", "p25", "p50", "p75", "max"])


@register("agg1_describe", _agg1_sql)
def agg1_describe(spark, d):
    return rounded(P.describe_numeric(table(spark, d, "lineitem"), LI_COLS))


_agg1_loan_sql = rsql(with_cte(LOAN_VIEW_SQL) + "\n" + _ua([
    f"SELECT '{c}' AS feature, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
    f"min({c}) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, "
    f"quantile_cont({c}, 0.75) AS p75, max({c}) AS max, count(*) - count({c}) AS nan_count FROM loan_view"
    for c in NUMERIC_COLS]), ["mean", "std", "min", "p25", "p50", "p75", "max"])


@register("agg1_describe_loans", _agg1_loan_sql)
def agg1_describe_loans(spark, d):
    return rounded(P.describe_numeric(loan_view(spark, d), NUMERIC_COLS))


# ---------------------------------------------------------------- AGG2
_LOAN_ALL = ["row_id"] + NUMERIC_COLS + LOAN_CATS
_agg2_sql = rsql(with_cte(LOAN_VIEW_SQL) + "\n" + _ua([
    f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing_count, "
    f"CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100 AS missing_pct FROM loan_view" for c in _LOAN_ALL]),
    ["missing_pct"])


@register("agg2_missing", _agg2_sql)
def agg2_missing(spark, d):
    return rounded(P.missing_summary(loan_view(spark, d), _LOAN_ALL))


# ---------------------------------------------------------------- AGG3
_agg3_sql = with_cte(LOAN_VIEW_SQL) + "\n" + _ua([
    f"SELECT '{c}' AS feature, coalesce(CAST({c} AS VARCHAR), 'nan') AS value, count(*) AS count "
    f"FROM loan_view GROUP BY 1, 2" for c in LOAN_CATS])


@register("agg3_categorical_counts", _agg3_sql)
def agg3_categorical_counts(spark, d):
    return P.categorical_counts(loan_view(spark, d), LOAN_CATS)


# ---------------------------------------------------------------- AGG4 / TOP1
_agg4_sql = rsql(_ua([f"SELECT '{c}' AS feature, var_samp({c}) AS variance FROM lineitem" for c in LI_COLS]),
                 ["variance"], 4)


@register("agg4_variance", _agg4_sql)
def agg4_variance(spark, d):
    return rounded(P.variances(table(spark, d, "lineitem"), LI_COLS), 4)


@register("top1_top_variance", rsql(
    f"SELECT * FROM ({_ua([f'SELECT {chr(39)}{c}{chr(39)} AS feature, var_samp({c}) AS variance FROM lineitem' for c in LI_COLS])}) "
    "ORDER BY variance DESC, feature LIMIT 2", ["variance"], 4))
def top1_top_variance(spark, d):
    return rounded(P.top_variance(table(spark, d, "lineitem"), LI_COLS, 2), 4)


# ---------------------------------------------------------------- AGG5 / AGG6
_O_CATS = ["o_custkey", "o_orderstatus", "o_orderpriority"]


@register("agg5_distinct_counts", _ua([
    f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_distinct FROM orders" for c in _O_CATS]))
def agg5_distinct_counts(spark, d):
    return P.distinct_counts(table(spark, d, "orders"), _O_CATS)


@register("agg6_distinct_values", "SELECT DISTINCT o_orderpriority FROM orders")
def agg6_distinct_values(spark, d):
    return P.distinct_values(table(spark, d, "orders"), "o_orderpriority")


# ---------------------------------------------------------------- AGG7 / AGG8
_qlist = ", ".join(str(q) for q in AGG7_QS)


@register("agg7_quantiles", rsql(
    f"SELECT unnest([{_qlist}]::DOUBLE[]) AS q, unnest(quantile_cont(value, [{_qlist}])) AS value FROM events",
    ["q", "value"]))
def agg7_quantiles(spark, d):
    return rounded(P.quantiles(table(spark, d, "events"), "value", AGG7_QS))


@register("agg7_quantiles_approx")
def agg7_quantiles_approx(spark, d):
    # approximate twin (percentile_approx sketch); no exact oracle by design
    return rounded(P.quantiles(table(spark, d, "events"), "value", AGG7_QS, approx=True))


@register("agg7_sketch_rank_errors", _ua([f"SELECT CAST({q} AS DOUBLE) AS q, true AS within" for q in AGG7_QS]))
def agg7_sketch_rank_errors(spark, d):
    """Merged KLL sketches, one per event type: every quantile's rank lies within the bound."""
    ev = table(spark, d, "events")
    return P.rank_errors(ev, "value", P.sketch_quantiles(ev, "value", AGG7_QS, "event_type")).select("q", (F.col("error") <= 0.005).alias("within"))


@register("agg8_medians", rsql(_ua([f"SELECT '{c}' AS feature, median({c}) AS median FROM lineitem"
                                    for c in LI_COLS]), ["median"]))
def agg8_medians(spark, d):
    return rounded(P.medians_df(table(spark, d, "lineitem"), LI_COLS))


# ---------------------------------------------------------------- AGG9 - AGG11
def _moments_sql(tab, cols):
    return rsql(_ua([
        f"SELECT '{c}' AS feature, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
        f"skewness({c}) AS skew, kurtosis({c}) AS kurtosis, CAST(min({c}) AS DOUBLE) AS min, "
        f"CAST(max({c}) AS DOUBLE) AS max, coalesce(bool_and({c} >= 0), true) AS all_nonneg FROM {tab}"
        for c in cols]), ["mean", "std", "skew", "kurtosis", "min", "max"])


@register("agg9_moments", _moments_sql("events", ["value"]))
def agg9_moments(spark, d):
    return rounded(P.moments(table(spark, d, "events"), ["value"]))


@register("agg9_moments_heavy_tail", _moments_sql("documents", ["n_chars"]))
def agg9_moments_heavy_tail(spark, d):
    return rounded(P.moments(table(spark, d, "documents"), ["n_chars"]))


@register("agg10_min_max", _ua([
    "SELECT 'c_acctbal' AS feature, min(c_acctbal) AS min, max(c_acctbal) AS max FROM customer",
    "SELECT 's_acctbal' AS feature, min(s_acctbal) AS min, max(s_acctbal) AS max FROM supplier"]))
def agg10_min_max(spark, d):
    c = table(spark, d, "customer").agg(F.lit("c_acctbal").alias("feature"), F.min("c_acctbal").alias("min"),
                                         F.max("c_acctbal").alias("max"))
    s = table(spark, d, "supplier").agg(F.lit("s_acctbal").alias("feature"), F.min("s_acctbal").alias("min"),
                                         F.max("s_acctbal").alias("max"))
    return c.unionByName(s)


_NN = ["c_acctbal", "c_custkey"]


@register("agg11_all_nonneg", _ua([f"SELECT '{c}' AS feature, bool_and({c} >= 0) AS all_nonneg FROM customer"
                                   for c in _NN]))
def agg11_all_nonneg(spark, d):
    return P.moments(table(spark, d, "customer"), _NN).select("feature", "all_nonneg")


@register("agg12_threshold_counts", rsql(
    "SELECT count(*) FILTER (WHERE value < 1) AS under_count, count(*) FILTER (WHERE value > 200) AS over_count, "
    "CAST(count(*) FILTER (WHERE value < 1) AS DOUBLE) / count(*) * 100 AS under_pct, "
    "CAST(count(*) FILTER (WHERE value > 200) AS DOUBLE) / count(*) * 100 AS over_pct FROM events",
    ["under_pct", "over_pct"]))
def agg12_threshold_counts(spark, d):
    return rounded(P.threshold_counts(table(spark, d, "events"), "value", 1.0, 200.0))


@register("agg13_mad", rsql("SELECT median(value) AS median, mad(value) AS mad FROM events", ["median", "mad"]))
def agg13_mad(spark, d):
    med, m = P.mad(table(spark, d, "events"), "value")
    return rounded(spark.createDataFrame([(med, m)], "median double, mad double"))


# ---------------------------------------------------------------- AGG14 / AGG23
def _pair_sql(fn, alias):
    parts = []
    for i, a in enumerate(LI_COLS):
        for j in range(i, len(LI_COLS)):
            b = LI_COLS[j]
            parts.append(f"SELECT '{a}' AS f1, '{b}' AS f2, {fn}({a}, {b}) AS {alias} FROM lineitem")
            if i != j:
                parts.append(f"SELECT '{b}' AS f1, '{a}' AS f2, {fn}({a}, {b}) AS {alias} FROM lineitem")
    return _ua(parts)


@register("agg14_correlation", rsql(_pair_sql("corr", "corr"), ["corr"]))
def agg14_correlation(spark, d):
    return rounded(P.correlation(table(spark, d, "lineitem"), LI_COLS))


@register("agg23_covariance", rsql(_pair_sql("covar_samp", "cov"), ["cov"], 3))
def agg23_covariance(spark, d):
    return rounded(P.covariance(table(spark, d, "lineitem"), LI_COLS), 3)


WIDE = 300


def _wide_columns(spark, d):
    """300 columns with missing values, from the 64 places of the embeddings."""
    e = lambda j: F.col("embedding")[j % 64].cast("double")
    value = lambda j: e(j) if j < 64 else e(j) * e(7 * j + 1) + e(j // 64)
    return table(spark, d, "embeddings").select(*[F.when((F.col("vec_id") + j) % 11 != 0, value(j)).alias(f"f{j}") for j in range(WIDE)])


def _wide_sql(function, name) -> str:
    return f"""
WITH r AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS e FROM embeddings),
l AS (SELECT vec_id, j, CASE WHEN j < 64 THEN e[j % 64 + 1] ELSE e[j % 64 + 1] * e[(7 * j + 1) % 64 + 1] + e[(j // 64) % 64 + 1] END AS v
      FROM r, (SELECT CAST(range AS INTEGER) AS j FROM range({WIDE})) WHERE (vec_id + j) % 11 <> 0)
SELECT 'f' || a.j AS f1, 'f' || b.j AS f2, {function}(a.v, b.v) AS {name} FROM l a JOIN l b ON a.vec_id = b.vec_id GROUP BY a.j, b.j"""


@register("agg14_correlation_wide", rsql(_wide_sql("corr", "corr"), ["corr"], 5))
def agg14_correlation_wide(spark, d):
    w = _wide_columns(spark, d)
    return rounded(P.correlation(w, w.columns), 5)


@register("agg23_covariance_wide", rsql(_wide_sql("covar_samp", "cov"), ["cov"], 5))
def agg23_covariance_wide(spark, d):
    w = _wide_columns(spark, d)
    return rounded(P.covariance(w, w.columns), 5)


# ---------------------------------------------------------------- AGG15
@register("agg15_class_distribution", rsql(
    "SELECT quality AS label, count(*) AS count, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share "
    "FROM labels GROUP BY quality", ["share"]))
def agg15_class_distribution(spark, d):
    return rounded(P.class_distribution(table(spark, d, "labels").withColumnRenamed("quality", "label")))


# ---------------------------------------------------------------- AGG16 / AGG17
@register("agg16_histogram", rsql("""
WITH mm AS (SELECT min(value) AS mn, max(value) AS mx FROM events),
w AS (SELECT mn, CASE WHEN mx > mn THEN (mx - mn) / 50 ELSE 1.0 END AS width FROM mm),
c AS (SELECT CAST(least(floor((value - mn) / width), 49) AS INTEGER) AS bin, count(*) AS count
      FROM events, w WHERE value IS NOT NULL GROUP BY 1)
SELECT CAST(g.bin AS INTEGER) AS bin, mn + g.bin * width AS lo, mn + (g.bin + 1) * width AS hi,
       coalesce(c.count, 0) AS count
FROM (SELECT range AS bin FROM range(50)) g CROSS JOIN w LEFT JOIN c ON c.bin = g.bin""", ["lo", "hi"]))
def agg16_histogram(spark, d):
    return rounded(P.histogram(table(spark, d, "events"), "value", 50))


@register("agg17_kde", rsql("""
WITH s AS (SELECT count(value) AS n, stddev_samp(value) AS sd, min(value) AS mn, max(value) AS mx FROM events),
h AS (SELECT n, sd * pow(n, -0.2) AS h, mn, mx FROM s),
b AS (SELECT n, h, mn - 3.0 * h AS lo, mx + 3.0 * h AS hi FROM h),
g AS (SELECT CAST(range AS INTEGER) AS grid_id, lo + (hi - lo) * range / 199 AS x, n, h FROM b, range(200))
SELECT grid_id, x, sum(exp(-pow((x - e.value) / h, 2) / 2)) * (1.0 / (n * h * sqrt(2 * pi()))) AS density
FROM g, events e WHERE e.value IS NOT NULL GROUP BY grid_id, x, n, h""", ["x", "density"], 6, {"density": 9}))
def agg17_kde(spark, d):
    return rounded(P.kde(table(spark, d, "events"), "value"), 6, {"density": 9})


# ---------------------------------------------------------------- AGG18
_box_long = _ua([f"SELECT label, '{c}' AS feature, {c} AS v FROM labeled" for c in NUMERIC_COLS])
_agg18_sql = rsql(with_cte(LOAN_VIEW_SQL, LABELED_SQL, f"""
lng AS (SELECT * FROM ({_box_long}) WHERE v IS NOT NULL),
q AS (SELECT label, feature, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3 FROM lng GROUP BY label, feature),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)""") + """
SELECT f.label, f.feature, q1, median, q3,
       min(v) FILTER (WHERE v >= lo AND v <= hi) AS whisker_lo,
       max(v) FILTER (WHERE v >= lo AND v <= hi) AS whisker_hi,
       count(*) FILTER (WHERE NOT (v >= lo AND v <= hi)) AS n_outliers
FROM f JOIN lng ON f.label = lng.label AND f.feature = lng.feature
GROUP BY f.label, f.feature, q1, median, q3""", ["q1", "median", "q3", "whisker_lo", "whisker_hi"])


@register("agg18_box_stats", _agg18_sql)
def agg18_box_stats(spark, d):
    return rounded(P.box_stats(loans_table(spark, d), NUMERIC_COLS, by="label", top_n=12))


# ---------------------------------------------------------------- AGG20 / AGG22
@register("agg20_is_standardized", """
WITH s AS (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_tax) AS m2, stddev_pop(l_tax) AS s2
           FROM lineitem),
z AS (SELECT (l_quantity - m1) / s1 AS a, (l_tax - m2) / s2 AS b FROM lineitem, s),
raw AS (SELECT abs(avg(l_quantity)) < 0.01 AND stddev_pop(l_quantity) > 0.9 AND stddev_pop(l_quantity) < 1.1
                AND abs(avg(l_tax)) < 0.01 AND stddev_pop(l_tax) > 0.9 AND stddev_pop(l_tax) < 1.1 AS r FROM lineitem)
SELECT 'raw' AS input, r AS is_standardized FROM raw
UNION ALL
SELECT 'scaled', abs(avg(a)) < 0.01 AND stddev_pop(a) > 0.9 AND stddev_pop(a) < 1.1
               AND abs(avg(b)) < 0.01 AND stddev_pop(b) > 0.9 AND stddev_pop(b) < 1.1 FROM z""")
def agg20_is_standardized(spark, d):
    from riskspark.operators.features import apply_scaler, fit_scaler
    li = table(spark, d, "lineitem").select("l_quantity", "l_tax")
    cols = ["l_quantity", "l_tax"]
    raw = P.is_standardized(li, cols).select(F.lit("raw").alias("input"), "is_standardized")
    z = apply_scaler(li, fit_scaler(li, cols))
    sc = P.is_standardized(z, cols).select(F.lit("scaled").alias("input"), "is_standardized")
    return raw.unionByName(sc)


@register("agg22_shape", "SELECT count(*) AS rows, 11 AS columns FROM lineitem")
def agg22_shape(spark, d):
    return P.shape(table(spark, d, "lineitem"))


# ---------------------------------------------------------------- TOP2 / TOP3 / SRT1
@register("top2_head_missing", rsql(
    with_cte(LOAN_VIEW_SQL) + "\nSELECT * FROM (" + _ua([
        f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing_count, "
        f"CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100 AS missing_pct FROM loan_view"
        for c in _LOAN_ALL]) + ") ORDER BY missing_pct DESC, feature LIMIT 3", ["missing_pct"]))
def top2_head_missing(spark, d):
    return rounded(P.missing_summary(loan_view(spark, d), _LOAN_ALL).limit(3))


@register("srt1_sort_desc", rsql(
    "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey", ["c_acctbal"]))
def srt1_sort_desc(spark, d):
    return rounded(P.sort_desc(table(spark, d, "customer").select("c_custkey", "c_acctbal"),
                               "c_acctbal", "c_custkey"))


@register("top3_first_reaching", """
WITH v AS (""" + _ua([f"SELECT '{c}' AS feature, var_samp({c}) AS variance FROM lineitem" for c in LI_COLS]) + """),
r AS (SELECT feature, row_number() OVER (ORDER BY variance DESC, feature) AS idx,
             sum(variance) OVER (ORDER BY variance DESC, feature ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             / sum(variance) OVER () AS cum FROM v)
SELECT CAST(min(idx) AS INTEGER) AS k FROM r WHERE cum >= 0.95""")
def top3_first_reaching(spark, d):
    from pyspark.sql import Window
    v = P.variances(table(spark, d, "lineitem"), LI_COLS)
    # d-row table (one row per feature): the window runs over the tiny result
    w = Window.orderBy(F.desc("variance"), "feature")
    r = v.select("feature", F.row_number().over(w).alias("idx"),
                 (F.sum("variance").over(w.rowsBetween(Window.unboundedPreceding, 0)) /
                  F.sum("variance").over(Window.partitionBy())).alias("cum"))
    return spark.createDataFrame([(P.first_reaching(r, "idx", "cum", 0.95),)], "k int")


# ---------------------------------------------------------------- SMP1 / SMP2
@register("smp1_bounded_sample", rsql(
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey "
    "LIMIT 100", ["o_totalprice"]))
def smp1_bounded_sample(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rounded(P.bounded_sample(o, "o_orderkey", 100, 42))


_smp2_long = _ua([f"SELECT row_id, '{c}' AS feature, {c} AS value FROM loan_view" for c in NUMERIC_COLS])


@register("smp2_pairplot_sample", rsql(with_cte(LOAN_VIEW_SQL, f"""
lng AS ({_smp2_long}),
top AS (SELECT feature FROM (SELECT feature, var_samp(value) AS v FROM lng GROUP BY feature)
        ORDER BY v DESC, feature LIMIT 6),
complete AS (SELECT row_id FROM lng JOIN top USING (feature) GROUP BY row_id HAVING count(value) = 6),
pick AS (SELECT row_id FROM complete ORDER BY md5('42|' || CAST(row_id AS VARCHAR)), row_id LIMIT 2000)""") + """
SELECT lng.row_id, lng.feature, lng.value FROM lng JOIN top USING (feature) JOIN pick USING (row_id)""",
    ["value"]))
def smp2_pairplot_sample(spark, d):
    lv = loan_view(spark, d)
    s = P.pairplot_sample(lv, NUMERIC_COLS, "row_id", 6, 2000, 42)
    cols = [c for c in s.columns if c != "row_id"]
    return rounded(s.unpivot(["row_id"], cols, "feature", "value"))
