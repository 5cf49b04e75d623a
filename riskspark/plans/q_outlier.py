"""Registered outlier queries (OUT1-OUT9, AGG19, SCL1) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.functions.scalar import clip
from riskspark.operators import outlier as O
from riskspark.plans.fixtures import LABELED_SQL, LOAN_VIEW_SQL, NUMERIC_COLS, split_loans, split_sql, table, \
    with_cte
from riskspark.plans.registry import register, rounded, rsql
from riskspark.session import materialize

_QS = sorted({p / 100.0 for pair in O.PERCENTILE_CANDIDATES for p in pair} | {0.25, 0.5, 0.75})
_QIDX = {q: i + 1 for i, q in enumerate(_QS)}  # DuckDB lists are 1-based


def _thresholds_sql(src: str) -> str:
    """CTE text: ``th(ord, method, lo, hi)`` for the eight candidate rules over ``x(x)`` from ``src``."""
    p = lambda q: f"p[{_QIDX[q]}]"
    rows = []
    for i, (lo, hi) in enumerate(O.PERCENTILE_CANDIDATES):
        rows.append(f"SELECT {i + 1} AS ord, '{O.method_name_pct(lo, hi)}' AS method, "
                    f"{p(lo / 100.0)} AS lo, {p(hi / 100.0)} AS hi FROM q")
    for j, k in enumerate(O.IQR_KS):
        rows.append(f"SELECT {6 + j}, 'IQR_{k}', {p(0.25)} - CAST({k} AS DOUBLE) * ({p(0.75)} - {p(0.25)}), "
                    f"{p(0.75)} + CAST({k} AS DOUBLE) * ({p(0.75)} - {p(0.25)}) FROM q")
    rows.append(f"SELECT 8, 'MAD_{O.MAD_N}', med - CAST({O.MAD_N} AS DOUBLE) * mad * CAST(1.4826 AS DOUBLE), "
                f"med + CAST({O.MAD_N} AS DOUBLE) * mad * CAST(1.4826 AS DOUBLE) FROM m")
    qlist = ", ".join(str(q) for q in _QS)
    return f"""
x AS ({src}),
q AS (SELECT quantile_cont(x, [{qlist}]::DOUBLE[]) AS p FROM x),
m AS (SELECT median(x) AS med, mad(x) AS mad FROM x),
th AS ({' UNION ALL '.join(rows)})"""


def _sweep_sql(src: str, feature: str, pre: tuple = ()) -> str:
    body = with_cte(*pre, _thresholds_sql(src), """
o AS (SELECT count(*) AS n, avg(x) AS om, stddev_samp(x) AS os, skewness(x) AS osk, kurtosis(x) AS oku FROM x),
a AS (SELECT ord, method, lo, hi,
             avg(greatest(lo, least(x, hi))) AS cm, stddev_samp(greatest(lo, least(x, hi))) AS cs,
             skewness(greatest(lo, least(x, hi))) AS csk, kurtosis(greatest(lo, least(x, hi))) AS cku,
             count(*) FILTER (WHERE greatest(lo, least(x, hi)) <> x) AS ch,
             min(greatest(lo, least(x, hi))) AS cmin, max(greatest(lo, least(x, hi))) AS cmax,
             count(*) FILTER (WHERE x < lo) AS u, count(*) FILTER (WHERE x > hi) AS ov
      FROM th, x GROUP BY ord, method, lo, hi)""")
    nd = "CAST(NULL AS DOUBLE)"
    return rsql(body + f"""
SELECT 0 AS ord, '{feature}' AS feature, 'original' AS method, n AS count, om AS mean, os AS std, osk AS skew,
       oku AS kurtosis, {nd} AS orig_mean, {nd} AS orig_std, {nd} AS orig_skew, {nd} AS orig_kurt,
       {nd} AS clipped_mean, {nd} AS clipped_std, {nd} AS clipped_skew, {nd} AS clipped_kurt,
       CAST(NULL AS BIGINT) AS changed_count, {nd} AS changed_pct, {nd} AS clipped_min, {nd} AS clipped_max,
       {nd} AS lo, {nd} AS hi, CAST(NULL AS BIGINT) AS under_count, CAST(NULL AS BIGINT) AS over_count,
       {nd} AS under_pct, {nd} AS over_pct FROM o
UNION ALL
SELECT a.ord, '{feature}', a.method, o.n, {nd}, {nd}, {nd}, {nd}, o.om, o.os, o.osk, o.oku, cm, cs, csk, cku,
       ch, CAST(ch AS DOUBLE) / o.n * 100, cmin, cmax, lo, hi, u, ov,
       CAST(u AS DOUBLE) / o.n * 100, CAST(ov AS DOUBLE) / o.n * 100 FROM a, o""", _SWEEP_DBL)


_SWEEP_DBL = ["mean", "std", "skew", "kurtosis", "orig_mean", "orig_std", "orig_skew", "orig_kurt", "clipped_mean",
              "clipped_std", "clipped_skew", "clipped_kurt", "changed_pct", "clipped_min", "clipped_max", "lo", "hi",
              "under_pct", "over_pct"]

_EV_SRC = "SELECT value AS x FROM events WHERE value IS NOT NULL"


def events_sweep(spark, d):
    ev = table(spark, d, "events")
    return rounded(O.winsorize_sweep(ev, "value"))


register("out5_sweep", _sweep_sql(_EV_SRC, "value"))(events_sweep)


_TRAIN_SRC = "SELECT credit_amount AS x FROM splitted WHERE split = 'train' AND credit_amount IS NOT NULL"
_LOAN_PRE = (LOAN_VIEW_SQL, LABELED_SQL, split_sql("labeled"))


@register("out5_sweep_loans_train", _sweep_sql(_TRAIN_SRC, "credit_amount", _LOAN_PRE))
def out5_sweep_loans_train(spark, d):
    # the view is joined once for both selections and the sweep
    tr = materialize(split_loans(spark, d).where(F.col("split") == "train").select("credit_amount"))
    try:
        return rounded(O.sweep(tr, "credit_amount", O.fit_candidates(tr, "credit_amount")))
    finally:
        tr.unpersist()


@register("out4_summarize_change", rsql(with_cte(f"""
x AS ({_EV_SRC}), q AS (SELECT quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM x)""") + """
SELECT count(*) AS count, avg(x) AS orig_mean, stddev_samp(x) AS orig_std, skewness(x) AS orig_skew,
       kurtosis(x) AS orig_kurt, avg(greatest(lo, least(x, hi))) AS clipped_mean,
       stddev_samp(greatest(lo, least(x, hi))) AS clipped_std, skewness(greatest(lo, least(x, hi))) AS clipped_skew,
       kurtosis(greatest(lo, least(x, hi))) AS clipped_kurt,
       count(*) FILTER (WHERE greatest(lo, least(x, hi)) <> x) AS changed_count,
       CAST(count(*) FILTER (WHERE greatest(lo, least(x, hi)) <> x) AS DOUBLE) / count(*) * 100 AS changed_pct,
       min(greatest(lo, least(x, hi))) AS clipped_min, max(greatest(lo, least(x, hi))) AS clipped_max
FROM x, q""", ["orig_mean", "orig_std", "orig_skew", "orig_kurt", "clipped_mean", "clipped_std", "clipped_skew",
               "clipped_kurt", "changed_pct", "clipped_min", "clipped_max"]))
def out4_summarize_change(spark, d):
    ev = table(spark, d, "events")
    lo, hi = O.winsor_bounds(ev, "value", 1.0, 99.0)
    s = O.sweep(ev, "value", [("1p_99p", lo, hi)]).where(F.col("method") != "original")
    return rounded(s.select("count", "orig_mean", "orig_std", "orig_skew", "orig_kurt", "clipped_mean",
                            "clipped_std", "clipped_skew", "clipped_kurt", "changed_count", "changed_pct",
                            "clipped_min", "clipped_max"))


@register("out6_beyond_counts", rsql(with_cte(_thresholds_sql(_EV_SRC)) + """
SELECT method, lo, hi, count(*) FILTER (WHERE x < lo) AS under_count, count(*) FILTER (WHERE x > hi) AS over_count,
       CAST(count(*) FILTER (WHERE x < lo) AS DOUBLE) / count(*) * 100 AS under_pct,
       CAST(count(*) FILTER (WHERE x > hi) AS DOUBLE) / count(*) * 100 AS over_pct
FROM th, x GROUP BY method, lo, hi""", ["lo", "hi", "under_pct", "over_pct"]))
def out6_beyond_counts(spark, d):
    return rounded(O.beyond_counts(events_sweep(spark, d)))


@register("out7_thresholds", rsql(with_cte(_thresholds_sql(_EV_SRC)) + "\nSELECT method, lo, hi FROM th",
                                  ["lo", "hi"]))
def out7_thresholds(spark, d):
    ev = table(spark, d, "events")
    return rounded(O.thresholds_table(ev, O.fit_candidates(ev, "value")))


def _overlay_label(m: str) -> str:
    if m.endswith("p") and "p_" in m:
        a, b = m[:-1].split("p_")
        return f"{a}-{b}"
    return m


@register("agg19_threshold_overlay", rsql(with_cte(_thresholds_sql(_EV_SRC)) + """
SELECT lo, hi, CASE WHEN method LIKE '%p\\_%p' ESCAPE '\\' THEN replace(replace(method, 'p_', '-'), 'p', '')
                    ELSE method END AS label FROM th""", ["lo", "hi"]))
def agg19_threshold_overlay(spark, d):
    ev = table(spark, d, "events")
    th = O.fit_candidates(ev, "value")
    return rounded(spark.createDataFrame([(float(lo), float(hi), _overlay_label(m)) for m, lo, hi in th],
                                         "lo double, hi double, label string"))


@register("out1_winsorize_series", rsql(with_cte(
    "q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events)") + """
SELECT event_id, CASE WHEN value IS NOT NULL THEN greatest(lo, least(value, hi)) END AS value_wins FROM events, q""",
    ["value_wins"]))
def out1_winsorize_series(spark, d):
    ev = table(spark, d, "events")
    lo, hi = O.winsor_bounds(ev, "value", 1.0, 99.0)
    return rounded(ev.select("event_id", clip(F.col("value"), lo, hi).alias("value_wins")))


@register("out2_iqr_fences", rsql("""
SELECT k, quantile_cont(value, 0.25) - k * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo,
       quantile_cont(value, 0.75) + k * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi
FROM events, (SELECT unnest([1.5, 3.0]::DOUBLE[]) AS k) GROUP BY k""", ["k", "lo", "hi"]))
def out2_iqr_fences(spark, d):
    from riskspark.operators.ranking import percentile_column
    q1, q3 = percentile_column(table(spark, d, "events"), "value", [0.25, 0.75])
    rows = [(k, *O.iqr_fences(q1, q3, k)) for k in O.IQR_KS]
    return rounded(spark.createDataFrame(rows, "k double, lo double, hi double"))


@register("out3_mad_fences", rsql(
    "SELECT median(value) - 3.5 * mad(value) * 1.4826 AS lo, median(value) + 3.5 * mad(value) * 1.4826 AS hi "
    "FROM events", ["lo", "hi"]))
def out3_mad_fences(spark, d):
    from riskspark.operators.profile import mad
    med, m = mad(table(spark, d, "events"), "value")
    lo, hi = O.mad_fences(med, m, 3.5)
    return rounded(spark.createDataFrame([(lo, hi)], "lo double, hi double"))


# OUT8: winsorize every numeric loan column with train bounds, applied to both splits
_OUT8_COLS = NUMERIC_COLS
_out8_q = ", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in _OUT8_COLS)
_out8_sel = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN greatest(lo_{c}, least({c}, hi_{c})) END AS {c}"
                      for c in _OUT8_COLS)


@register("out8_winsorize_frame", rsql(with_cte(*_LOAN_PRE, f"""
b AS (SELECT {_out8_q} FROM splitted WHERE split = 'train')""") + f"""
SELECT row_id, split, {_out8_sel} FROM splitted, b""", _OUT8_COLS))
def out8_winsorize_frame(spark, d):
    s = split_loans(spark, d).select("row_id", "split", *_OUT8_COLS)
    bounds = O.fit_winsorize(s.where(F.col("split") == "train"), _OUT8_COLS, 0.01, 0.99)
    return rounded(O.apply_winsorize(s, bounds))


# OUT9: log1p with the train shift (c_acctbal has negatives)
@register("out9_log_shift", rsql("""
WITH m AS (SELECT min(c_acctbal) AS mn FROM customer)
SELECT c_custkey, ln(1 + c_acctbal + CASE WHEN mn < 0 THEN -mn ELSE 0 END) AS c_acctbal FROM customer, m""",
    ["c_acctbal"]))
def out9_log_shift(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return rounded(O.apply_log_shift(c, O.fit_log_shift(c, ["c_acctbal"])))
