"""Outlier rules (OUT1-OUT9): fit = exact quantile/MAD selection, apply =
clip projection; the candidate sweep is ONE grouped aggregate over the
intervals between all thresholds, never one pass per rule and never a row
multiplied.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.scalar import MAD_SCALE, clip
from riskspark.operators import ranking
from riskspark.operators.columns import num

# Candidate rules of the sweep, in report order.
PERCENTILE_CANDIDATES = [(0.1, 99.9), (0.5, 99.5), (1, 99), (2, 98), (5, 95)]
IQR_KS = [1.5, 3.0]
MAD_N = 3.5


def method_name_pct(lowp, highp) -> str:
    return f"{lowp}p_{highp}p"


def winsor_bounds(df: DataFrame, col: str, lower_pct: float, upper_pct: float) -> tuple[float, float]:
    """OUT1 fit: (lo, hi) = exact quantiles at lower/upper percent."""
    lo, hi = ranking.percentile_column(df, col, [lower_pct / 100.0, upper_pct / 100.0])
    return lo, hi


def iqr_fences(q1: float, q3: float, k: float = 1.5) -> tuple[float, float]:
    """OUT2: q1 - k*iqr, q3 + k*iqr."""
    iqr = q3 - q1
    return q1 - k * iqr, q3 + k * iqr


def mad_fences(median: float, mad: float, n_mads: float = MAD_N) -> tuple[float, float]:
    """OUT3: median +/- n * MAD * 1.4826."""
    return median - n_mads * mad * MAD_SCALE, median + n_mads * mad * MAD_SCALE


def fit_candidates(df: DataFrame, col: str, percentile_candidates=PERCENTILE_CANDIDATES,
                   iqr_ks: Sequence[float] = IQR_KS, mad_n: float = MAD_N) -> list[tuple[str, float, float]]:
    """OUT5 fit: thresholds of every candidate rule as (method, lo, hi).

    Two selection jobs in total: all quantiles at once, then the MAD."""
    qs = sorted({p / 100.0 for pair in percentile_candidates for p in pair} | {0.25, 0.5, 0.75})
    vals = dict(zip(qs, ranking.percentile_column(df, col, qs)))
    if vals[0.5] is None:
        return []
    out = []
    for lo_p, hi_p in percentile_candidates:
        out.append((method_name_pct(lo_p, hi_p), vals[lo_p / 100.0], vals[hi_p / 100.0]))
    for k in iqr_ks:
        lo, hi = iqr_fences(vals[0.25], vals[0.75], k)
        out.append((f"IQR_{k}", lo, hi))
    med = vals[0.5]
    dev = ranking.percentile_column(df, F.abs(num(col) - F.lit(med)), [0.5])[0]
    lo, hi = mad_fences(med, dev, mad_n)
    out.append((f"MAD_{mad_n}", lo, hi))
    return out


def thresholds_table(df: DataFrame, thresholds: list[tuple[str, float, float]]) -> DataFrame:
    """OUT7 / AGG19: the fitted thresholds as a small table (method, lo, hi)."""
    return df.sparkSession.createDataFrame([(m, float(lo), float(hi)) for m, lo, hi in thresholds],
                                           "method string, lo double, hi double")


POWERS = (1, 2, 3, 4)


def interval_sums(df: DataFrame, x: Column, cuts: Sequence[float], shift: float) -> DataFrame:
    """One row per interval between the sorted ``cuts`` (and per cut point): count,
    minimum, maximum and power sums of ``x - shift``. At most ``2 * len(cuts) + 1``
    rows leave a task, whatever the data."""
    place = F.lit(0)
    for k, c in enumerate(cuts):    # the highest cut point is asked first
        place = F.when(x > c, F.lit(2 * k + 2)).when(x == c, F.lit(2 * k + 1)).otherwise(place)
    z = F.col("x") - F.lit(shift)
    return (df.select(x.alias("x"), place.alias("place")).where(F.col("x").isNotNull()).groupBy("place")
            .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("mn"), F.max("x").alias("mx"),
                 *[F.sum(z if p == 1 else F.pow(z, p)).alias(f"p{p}") for p in POWERS]))


def shape_of(n: float, sums: Sequence[float]) -> tuple:
    """Mean (of the shifted values), sample std, G1 and G2 from power sums."""
    m = sums[0] / n
    m2 = sums[1] / n - m * m
    m3 = sums[2] / n - 3 * m * sums[1] / n + 2 * m ** 3
    m4 = sums[3] / n - 4 * m * sums[2] / n + 6 * m * m * sums[1] / n - 3 * m ** 4
    m2 = max(m2, 0.0)
    std = math.sqrt(m2 * n / (n - 1)) if n > 1 else None
    if m2 == 0:
        return m, std, None, None
    g1, g2 = m3 / m2 ** 1.5, m4 / (m2 * m2) - 3
    skew = g1 * math.sqrt(n * (n - 1)) / (n - 2) if n > 2 else None
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) if n > 3 else None
    return m, std, skew, kurt


SWEEP_SCHEMA = ("ord int, feature string, method string, count long, mean double, std double, skew double, kurtosis double, "
                "orig_mean double, orig_std double, orig_skew double, orig_kurt double, clipped_mean double, "
                "clipped_std double, clipped_skew double, clipped_kurt double, changed_count long, changed_pct double, "
                "clipped_min double, clipped_max double, lo double, hi double, under_count long, over_count long, "
                "under_pct double, over_pct double")


def sweep(df: DataFrame, col: str, thresholds: list[tuple[str, float, float]],
          feature: str | None = None) -> DataFrame:
    """OUT4 + OUT5 + OUT6 in one scan without multiplying rows.

    Every threshold of every rule is a cut point; the data are summed once per
    interval between cut points. A rule's clipped moments are the sums of the
    intervals inside its fences plus the fences themselves, as often as rows lie
    beyond. Power sums are taken around the median cut point, so that large offsets
    do not cancel.

    Output (one row per rule plus an ``original`` row): feature, method,
    count, mean, std, skew, kurtosis (original row only), orig_* and
    clipped_* moments, changed_count/pct, clipped_min/max, lo, hi,
    under/over counts and percentages (strict).
    """
    spark = df.sparkSession
    cuts = sorted({float(v) for _, lo, hi in thresholds for v in (lo, hi)})
    shift = cuts[len(cuts) // 2] if cuts else 0.0
    rows = {r["place"]: r for r in interval_sums(df, num(col), cuts, shift).collect()}
    n = sum(r["n"] for r in rows.values())
    name = feature or col
    if not n:
        return spark.createDataFrame([], SWEEP_SCHEMA)
    total = [math.fsum(r[f"p{p}"] for r in rows.values()) for p in POWERS]
    om, os_, og1, og2 = shape_of(n, total)
    om += shift
    mn, mx = min(r["mn"] for r in rows.values()), max(r["mx"] for r in rows.values())
    out = [(0, name, "original", n, om, os_, og1, og2, *[None] * 18)]
    for k, (method, lo, hi) in enumerate(thresholds):
        lo, hi = float(lo), float(hi)
        at_lo, at_hi = 2 * cuts.index(lo) + 1, 2 * cuts.index(hi) + 1
        under = sum(r["n"] for p, r in rows.items() if p < at_lo)
        over = sum(r["n"] for p, r in rows.items() if p > at_hi)
        sums = [math.fsum([*(r[f"p{p}"] for q, r in rows.items() if at_lo <= q <= at_hi),
                           under * (lo - shift) ** p, over * (hi - shift) ** p]) for p in POWERS]
        m, s, g1, g2 = shape_of(n, sums)
        out.append((k + 1, name, method, n, None, None, None, None, om, os_, og1, og2, m + shift, s, g1, g2, under + over,
                    (under + over) / n * 100.0, min(max(mn, lo), hi), max(min(mx, hi), lo), lo, hi, under, over,
                    under / n * 100.0, over / n * 100.0))
    return spark.createDataFrame(out, SWEEP_SCHEMA)


def candidate_summary(sweep_df: DataFrame) -> DataFrame:
    """OUT5: the summary columns of the sweep (reference file layout)."""
    return sweep_df.select("feature", "method", "count", "mean", "std", "skew", "kurtosis", "orig_mean",
                           "orig_std", "orig_skew", "orig_kurt", "clipped_mean", "clipped_std",
                           "clipped_skew", "clipped_kurt", "changed_count", "changed_pct", "clipped_min",
                           "clipped_max", "lo", "hi")


def beyond_counts(sweep_df: DataFrame) -> DataFrame:
    """OUT6: method, lo, hi, under/over counts and percentages."""
    return sweep_df.where(F.col("method") != "original").select(
        "method", "lo", "hi", "under_count", "over_count", "under_pct", "over_pct")


def winsorize_sweep(df: DataFrame, col: str) -> DataFrame:
    """OUT5 end to end: fit candidate thresholds, then the one-scan sweep."""
    return sweep(df, col, fit_candidates(df, col))


# ------------------------------------------------------------ OUT8, OUT9

def fit_winsorize(df: DataFrame, cols: Sequence[str], lower_q: float = 0.01, upper_q: float = 0.99) -> dict[str, tuple[float, float]]:
    """OUT8 fit: per-column (lo, hi) from one selection job over all columns."""
    ps = ranking.percentiles(df, cols, [lower_q, upper_q])[()]
    return {c: (ps[c][0], ps[c][1]) for c in cols}


def apply_winsorize(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """OUT8 apply: one projection clipping every fitted column."""
    return df.withColumns({c: clip(num(c), lo, hi) for c, (lo, hi) in bounds.items()})


def fit_log_shift(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """OUT9 fit: shift = -min when the column has negatives, else 0."""
    row = df.agg(*[F.min(num(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return {c: (-float(row[f"m{i}"]) if row[f"m{i}"] is not None and row[f"m{i}"] < 0 else 0.0)
            for i, c in enumerate(cols)}


def apply_log_shift(df: DataFrame, shifts: dict[str, float]) -> DataFrame:
    """OUT9 apply: log1p(x + train shift) - the same shift on every split."""
    return df.withColumns({c: F.log1p(num(c) + F.lit(s)) for c, s in shifts.items()})
