"""Column profiling (AGG1-AGG23, TOP1-TOP3, SRT1, SMP1-SMP2).

Design rule: one scan per statistic *family*, never one pass per column.
Results are tidy long tables (feature, ...) built from a single wide
aggregate row with ``stack`` - no driver round-trip of data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.operators import ranking
from riskspark.operators.columns import col, is_missing, join_null_safe, num
from riskspark.session import materialize

_Q3 = [0.25, 0.5, 0.75]
PLAIN_WIDTH = 24                          # columns up to which all pairs are terms of one aggregate
SKETCH_K = 4000                           # a KLL sketch of this size ranks within 0.2 % of the rows
KDE_CELLS, KDE_TERMS, KDE_REACH = 10, 9, 9      # cells per bandwidth, terms of the expansion, reach in bandwidths


def _stack(row_df: DataFrame, names: Sequence[str], fields: Sequence[str], prefix_of) -> DataFrame:
    """Turn one wide row (fields per feature ``i``) into one row per feature."""
    parts = []
    for i, n in enumerate(names):
        parts.append(F.struct(F.lit(n).alias("feature"),
                              *[F.col(prefix_of(i, f)).alias(f) for f in fields]))
    return row_df.select(F.explode(F.array(*parts)).alias("_s")).select("_s.*")


def sample_skew(n: Column, g1: Column) -> Column:
    """Bias-corrected skewness G1 from Spark's population ``skewness``."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurt(n: Column, g2: Column) -> Column:
    """Bias-corrected excess kurtosis G2 from Spark's population ``kurtosis``."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


# ------------------------------------------------------------------- AGG1

def describe_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AGG1: feature, count, mean, std, min, p25, p50, p75, max, nan_count."""
    cols = list(cols)
    aggs = []
    for i, c in enumerate(cols):
        x = num(c)
        aggs += [F.count(x).alias(f"{i}_count"), F.avg(x).alias(f"{i}_mean"),
                 F.stddev_samp(x).alias(f"{i}_std"), F.min(x).alias(f"{i}_min"),
                 F.max(x).alias(f"{i}_max"), F.count_if(x.isNull()).alias(f"{i}_nan_count")]
    ps = ranking.percentiles(df, cols, _Q3)[()]
    wide = df.agg(*aggs).select("*", *[F.lit(ps[c][k]).cast("double").alias(f"{i}_{n}")
                                       for i, c in enumerate(cols) for k, n in enumerate(["p25", "p50", "p75"])])
    fields = ["count", "mean", "std", "min", "p25", "p50", "p75", "max", "nan_count"]
    return _stack(wide, cols, fields, lambda i, f: f"{i}_{f}")


# ------------------------------------------------------------------- AGG2

def missing_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """AGG2: feature, missing_count, missing_pct (of all rows), pct descending.
    NULL and NaN are both missing."""
    cols = list(cols or df.columns)
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count_if(is_missing(df, c)).alias(f"m{i}")
                                               for i, c in enumerate(cols)]
    wide = df.agg(*aggs)
    long = _stack(wide.select("*", *[F.col("_n").alias(f"n{i}") for i in range(len(cols))]),
                  cols, ["missing_count", "rows"], lambda i, f: f"m{i}" if f == "missing_count" else f"n{i}")
    return long.select("feature", "missing_count",
                       (F.col("missing_count") / F.col("rows") * 100.0).alias("missing_pct")) \
        .orderBy(F.desc("missing_pct"), "feature")


# ------------------------------------------------------------------- AGG3

def categorical_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AGG3: feature, value, count - missing counted as level ``nan``,
    count descending within feature. One unpivot + one grouped count
    (map-side combine keeps the shuffle at levels x partitions)."""
    s = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in cols])
    long = s.unpivot([], list(cols), "feature", "value")
    return long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("count")) \
        .orderBy("feature", F.desc("count"), "value")


# --------------------------------------------------------- AGG4, TOP1, AGG5

def variances(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AGG4: feature, variance (sample)."""
    wide = df.agg(*[F.var_samp(num(c)).alias(f"v{i}") for i, c in enumerate(cols)])
    return _stack(wide, cols, ["variance"], lambda i, f: f"v{i}")


def top_variance(df: DataFrame, cols: Sequence[str], n: int) -> DataFrame:
    """TOP1: the n columns with the largest sample variance (name breaks ties)."""
    return variances(df, cols).orderBy(F.desc("variance"), "feature").limit(n)


def top_variance_names(df: DataFrame, cols: Sequence[str], n: int) -> list[str]:
    if len(cols) <= n:
        return list(cols)
    return [r["feature"] for r in top_variance(df, cols, n).collect()]


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """AGG5: feature, n_distinct (NULL excluded). ``approx`` uses HLL.

    Exact counts go through (column, value) rows, deduplicated map-side: a row of the
    table makes one narrow row per column, where a ``count(DISTINCT)`` of each would
    make one as wide as all of them. Values are told apart by their text."""
    cols = list(cols)
    if approx:
        wide = df.agg(*[F.approx_count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols)])
        return _stack(wide, cols, ["n_distinct"], lambda i, _: f"d{i}")
    types = dict(df.dtypes)
    # 0.0 and -0.0 are one value
    value = lambda c: (F.col(c) + F.lit(0.0).cast(types[c]) if types[c] in ("float", "double") else F.col(c)).cast("string")
    parts = F.array(*[F.struct(F.lit(i).alias("i"), value(c).alias("v")) for i, c in enumerate(cols)])
    long = df.select(F.explode(F.filter(parts, lambda x: x["v"].isNotNull())).alias("x")).select("x.i", "x.v")
    counts = long.distinct().groupBy("i").agg(F.count(F.lit(1)).alias("n_distinct"))      # a row per column
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "i int, feature string")
    return names.join(counts, "i", "left").select("feature", F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """AGG6: distinct values of one column."""
    return df.select(col).distinct()


# ------------------------------------------------------------- AGG7, AGG8

def quantiles(df: DataFrame, col: str, qs: Sequence[float], approx: bool = False) -> DataFrame:
    """AGG7: exact linear-interpolated quantiles -> (q, value);
    ``approx`` uses ``percentile_approx``."""
    spark = df.sparkSession
    if approx:
        row = df.agg(F.percentile_approx(num(col), list(qs), 100_000).alias("p")).first()
        vals = list(row["p"] or [None] * len(qs))
    else:
        vals = ranking.percentile_column(df, col, qs)
    return spark.createDataFrame([(float(q), None if v is None else float(v)) for q, v in zip(qs, vals)],
                                 "q double, value double")


def sketch_quantiles(df: DataFrame, col: str, qs: Sequence[float], by: str, k: int = SKETCH_K) -> DataFrame:
    """AGG7, approximate: quantiles (q, value) from a KLL sketch per ``by`` group, merged.
    Sketches are small rows, so they can be kept and merged with later ones."""
    kept = df.where(num(col).isNotNull()).groupBy(by).agg(F.kll_sketch_agg_double(num(col), F.lit(k)).alias("sketch"))
    merged = kept.agg(F.kll_merge_agg_double("sketch").alias("sketch")).where(F.kll_sketch_get_n_double("sketch") > 0)
    pairs = [F.struct(F.lit(float(q)).alias("q"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias("value")) for q in qs]
    return merged.select(F.explode(F.array(*pairs)).alias("s")).select("s.*")


def rank_errors(df: DataFrame, col: str, quantiles_df: DataFrame) -> DataFrame:
    """(q, value, error): how far the rank of ``value`` lies from q, as a share of the
    rows; equal values cover all ranks between the first and the last of them."""
    v = num(col)
    qs = quantiles_df.collect()         # a row per wanted quantile
    wide = df.agg(F.count(v).alias("n"), *[e for i, r in enumerate(qs) for e in (
        F.count_if(v < F.lit(r["value"])).alias(f"l{i}"), F.count_if(v <= F.lit(r["value"])).alias(f"u{i}"))])
    n = F.col("n")
    off = [F.greatest(F.lit(0.0), F.col(f"l{i}") / n - F.lit(r["q"]), F.lit(r["q"]) - F.col(f"u{i}") / n) for i, r in enumerate(qs)]
    rows = F.array(*[F.struct(F.lit(r["q"]).alias("q"), F.lit(r["value"]).alias("value"), e.alias("error")) for r, e in zip(qs, off)])
    return wide.select(F.explode(rows).alias("s")).select("s.*")


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """AGG8: per-column exact median as a small dict (a fitted parameter)."""
    return {c: v[0] for c, v in ranking.percentiles(df, cols, [0.5])[()].items()}


def medians_df(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    m = medians(df, cols)
    return df.sparkSession.createDataFrame([(c, m[c]) for c in cols], "feature string, median double")


# ----------------------------------------------------------- AGG9 - AGG13

def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AGG9 + AGG10 + AGG11: count, mean, std (ddof 1), skew (G1),
    kurtosis (G2), min, max, all_nonneg - all columns in one pass."""
    aggs = []
    for i, c in enumerate(cols):
        x = num(c)
        aggs += [F.count(x).alias(f"{i}_count"), F.avg(x).alias(f"{i}_mean"),
                 F.stddev_samp(x).alias(f"{i}_std"), F.skewness(x).alias(f"{i}_g1"),
                 F.kurtosis(x).alias(f"{i}_g2"), F.min(x).alias(f"{i}_min"), F.max(x).alias(f"{i}_max"),
                 F.coalesce(F.bool_and(x >= 0), F.lit(True)).alias(f"{i}_all_nonneg")]
    wide = df.agg(*aggs)
    wide = wide.select("*", *[
        e for i in range(len(cols)) for e in (
            sample_skew(F.col(f"{i}_count"), F.col(f"{i}_g1")).alias(f"{i}_skew"),
            sample_kurt(F.col(f"{i}_count"), F.col(f"{i}_g2")).alias(f"{i}_kurtosis"))])
    return _stack(wide, cols, ["count", "mean", "std", "skew", "kurtosis", "min", "max", "all_nonneg"],
                  lambda i, f: f"{i}_{f}")


def threshold_counts(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """AGG12: under (x < lo), over (x > hi), strict, and percentages of rows."""
    x = num(col)
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(x < lo).alias("under_count"),
                  F.count_if(x > hi).alias("over_count")) \
        .select("under_count", "over_count",
                (F.col("under_count") / F.col("n") * 100.0).alias("under_pct"),
                (F.col("over_count") / F.col("n") * 100.0).alias("over_pct"))


def mad(df: DataFrame, col: str) -> tuple[float | None, float | None]:
    """AGG13: (median, median(|x - median|)) - two exact selections."""
    med = ranking.percentile_column(df, col, [0.5])[0]
    if med is None:
        return None, None
    dev = ranking.percentile_column(df, F.abs(num(col) - F.lit(med)), [0.5])[0]
    return med, dev


# ------------------------------------------------------------------ AGG14

def correlation(df: DataFrame, cols: Sequence[str], top_k: int | None = None) -> DataFrame:
    """AGG14: long Pearson matrix (f1, f2, corr), pairwise-complete; all columns, or
    the ``top_k`` with the largest variance. One aggregate of d(d+1)/2 terms, or, for
    many columns, one masked Gram matrix."""
    cols = top_variance_names(df, cols, top_k) if top_k and len(cols) > top_k else list(cols)
    if len(cols) > PLAIN_WIDTH:
        return _wide_pairs(df, cols, "corr")
    aggs, pairs = [], []
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            b = cols[j]
            aggs.append(F.corr(num(a), num(b)).alias(f"c{i}_{j}"))
            pairs.append((a, b, f"c{i}_{j}"))
            if i != j:
                pairs.append((b, a, f"c{i}_{j}"))
    wide = df.agg(*aggs)
    parts = [F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(k).alias("corr")) for a, b, k in pairs]
    return wide.select(F.explode(F.array(*parts)).alias("_s")).select("_s.*")


def _wide_pairs(df: DataFrame, cols: Sequence[str], want: str) -> DataFrame:
    """Pairwise-complete ``corr`` or ``cov`` of many columns from second moments.

    A row becomes the vector ``[z*m, m, z^2*m]`` (m: 1 where the value is present, z: the
    value less its mean, by its deviation). Spark ML's summarizer and correlation give
    the vector's mean and covariance, tree aggregates on the executors; every sum over
    the rows that have both of two columns is one entry of them. The driver holds
    9 * d * d numbers."""
    d = len(cols)
    values = df.select(F.array(*[num(c) for c in cols]).alias("x"))

    def masked(rows):
        return rows.select(F.concat(
            F.transform("x", lambda v: F.coalesce(v, F.lit(0.0))), F.transform("x", lambda v: v.isNotNull().cast("double")),
            F.transform("x", lambda v: F.coalesce(v * v, F.lit(0.0)))).alias("v")).select(array_to_vector("v").alias("v"))

    # a first scan for the centre and scale, which only keep the sums well-conditioned
    empty = values.isEmpty()         # the summarizer refuses no rows
    about = np.zeros((3, d)) if empty else np.array(
        masked(values).select(Summarizer.mean(F.col("v"))).first()[0].toArray()).reshape(3, d)
    share = np.where(about[1] > 0, about[1], 1.0)
    mean = about[0] / share
    scale = np.sqrt(np.clip(about[2] / share - mean ** 2, 0, None))
    scale[scale == 0] = 1.0
    centres, scales = (F.array(*[F.lit(float(v)) for v in a]) for a in (mean, scale))
    rows = masked(values.select(F.transform("x", lambda v, i: (v - F.get(centres, i)) / F.get(scales, i)).alias("x")))
    s = None if empty else rows.select(Summarizer.metrics("count", "mean", "variance").summary(F.col("v")).alias("s")).first()["s"]
    n = 0 if empty else int(s["count"])
    out = [[None] * d for _ in range(d)]
    if n > 1:
        mu, sd = np.array(s["mean"].toArray()), np.sqrt(np.array(s["variance"].toArray()))
        corr = np.nan_to_num(Correlation.corr(rows, "v").first()[0].toArray())
        np.fill_diagonal(corr, 1.0)
        # sums over rows of products of two entries
        total = corr * np.outer(sd, sd) * (n - 1) + n * np.outer(mu, mu)
        z, m, q = slice(0, d), slice(d, 2 * d), slice(2 * d, 3 * d)
        both, sx, sxx, sxy = np.rint(total[m, m]), total[z, m], total[q, m], total[z, z]
        for i in range(d):
            for j in range(d):
                k = both[i, j]
                if k < 2:
                    continue
                cov = (sxy[i, j] - sx[i, j] * sx[j, i] / k) / (k - 1)
                vi, vj = ((sxx[a, b] - sx[a, b] ** 2 / k) / (k - 1) for a, b in ((i, j), (j, i)))
                if want == "cov":
                    out[i][j] = float(cov * scale[i] * scale[j])
                elif vi > 1e-12 and vj > 1e-12:
                    out[i][j] = float(min(1.0, max(-1.0, cov / math.sqrt(vi * vj))))
    return df.sparkSession.createDataFrame([(a, b, out[i][j]) for i, a in enumerate(cols) for j, b in enumerate(cols)],
                                           f"f1 string, f2 string, {want} double")


def covariance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AGG23: long sample covariance (f1, f2, cov), pairwise-complete."""
    if len(cols) > PLAIN_WIDTH:
        return _wide_pairs(df, list(cols), "cov")
    aggs, pairs = [], []
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            b = cols[j]
            aggs.append(F.covar_samp(num(a), num(b)).alias(f"c{i}_{j}"))
            pairs.append((a, b, f"c{i}_{j}"))
            if i != j:
                pairs.append((b, a, f"c{i}_{j}"))
    wide = df.agg(*aggs)
    parts = [F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(k).alias("cov")) for a, b, k in pairs]
    return wide.select(F.explode(F.array(*parts)).alias("_s")).select("_s.*")


# ------------------------------------------------------------------ AGG15

def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """AGG15: label, count, share of rows."""
    w = Window.partitionBy()  # over the tiny grouped result only (a few labels)
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    return g.select(label, "count", (F.col("count") / F.sum("count").over(w)).alias("share"))


# ------------------------------------------------------------ AGG16, AGG17

def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """AGG16: fixed-width histogram (bin, lo, hi, count), last bin closed,
    empty bins zero-filled."""
    x = num(col)
    mm = df.agg(F.min(x).alias("mn"), F.max(x).alias("mx")).first()
    mn, mx = mm["mn"], mm["mx"]
    spark = df.sparkSession
    if mn is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, count long")
    width = (mx - mn) / bins if mx > mn else 1.0
    b = F.least(F.floor((x - F.lit(mn)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(x.isNotNull()).select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    # counts has at most `bins` rows (one per bin id): bounded by the parameter, not the data
    return grid.join(F.broadcast(counts), "bin", "left").select(
        "bin", (F.lit(mn) + F.col("bin") * F.lit(width)).alias("lo"),
        (F.lit(mn) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


def kde(df: DataFrame, col: str, grid_size: int = 200, cut: float = 3.0) -> DataFrame:
    """AGG17: Gaussian KDE on a regular grid (Scott bandwidth), as plot data.

    A row costs the same whatever the grid: rows are counted in cells of a tenth of the
    bandwidth, with the power sums of their places in the cell. A cell's kernel sum at a
    grid point is its Hermite expansion (at |u| <= 1/20 the terms left out are below
    1e-15), taken only at grid points within ``KDE_REACH`` bandwidths; further ones
    would get less than 1e-17 of a row."""
    x = num(col)
    st = df.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"), F.min(x).alias("mn"),
                F.max(x).alias("mx")).first()
    spark = df.sparkSession
    n, sd = st["n"], st["sd"]
    if not n or sd is None or sd == 0:
        return spark.createDataFrame([], "grid_id int, x double, density double")
    h = sd * n ** (-0.2)
    lo, hi = st["mn"] - cut * h, st["mx"] + cut * h
    step = (hi - lo) / (grid_size - 1)
    width = h / KDE_CELLS
    u = (x - F.lit(lo)) / F.lit(width)
    placed = df.where(x.isNotNull()).select(F.floor(u).alias("cell"), ((u - F.floor(u) - 0.5) / KDE_CELLS).alias("u"))
    cells = placed.groupBy("cell").agg(*[F.sum(F.pow("u", k) / math.factorial(k)).alias(f"p{k}") for k in range(KDE_TERMS)])
    centre = F.lit(lo) + (F.col("cell") + 0.5) * F.lit(width)
    near = lambda side: (centre + F.lit(side * KDE_REACH * h) - F.lit(lo)) / F.lit(step)
    ids = F.sequence(F.greatest(F.ceil(near(-1)), F.lit(0)).cast("int"), F.least(F.floor(near(1)), F.lit(grid_size - 1)).cast("int"))
    some = F.ceil(near(-1)) <= F.floor(near(1))       # a coarse grid may have no point in reach
    t = (F.lit(lo) + F.col("grid_id") * F.lit(step) - centre) / F.lit(h)
    at = cells.where(some).select("*", F.explode(ids).alias("grid_id")).withColumn("t", t)
    # Hermite polynomials, a column each
    for k in range(2, KDE_TERMS):
        before = F.col(f"h{k - 1}") if k > 2 else F.col("t")
        at = at.withColumn(f"h{k}", F.col("t") * before - (k - 1) * (F.col(f"h{k - 2}") if k > 3 else F.col("t") if k == 3 else F.lit(1.0)))
    terms = F.col("p0") + F.col("p1") * F.col("t")
    for k in range(2, KDE_TERMS):
        terms = terms + F.col(f"p{k}") * F.col(f"h{k}")
    sums = at.groupBy("grid_id").agg(F.sum(F.exp(-F.col("t") * F.col("t") / 2) * terms).alias("kernel"))
    grid = spark.range(grid_size).select(F.col("id").cast("int").alias("grid_id"), (F.lit(lo) + F.col("id") * F.lit(step)).alias("x"))
    # sums has at most a row per grid point
    return grid.join(F.broadcast(sums), "grid_id", "left").select(
        "grid_id", "x", (F.coalesce("kernel", F.lit(0.0)) / F.lit(n * h * math.sqrt(2 * math.pi))).alias("density"))


# ------------------------------------------------------------------ AGG18

def box_stats(df: DataFrame, cols: Sequence[str], by: str | None = "label", top_n: int | None = None) -> DataFrame:
    """AGG18: box-plot statistics per (group, feature): q1, median, q3,
    whiskers (extreme values inside the 1.5 IQR fences) and outlier count.
    All columns by default; ``top_n`` keeps those with the largest variance.
    Groups, the NULL group among them, stay in tables throughout."""
    by_cols = [by] if by else []
    # read once: the percentiles' passes and the whiskers' see the same kept columns
    df = df.select(*[col(c) for c in dict.fromkeys([*by_cols, *cols])]).persist()
    cols = top_variance_names(df, cols, top_n) if top_n else list(cols)
    ps = ranking.percentile_table(df, cols, _Q3, by=by_cols)
    at = lambda q: F.max(F.when(F.col("q") == q, F.col("value")))
    iqr = F.col("q3") - F.col("q1")
    fences = (ps.groupBy(*[col(b) for b in by_cols], "feature").agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))
              .withColumn("fence_lo", F.col("q1") - 1.5 * iqr).withColumn("fence_hi", F.col("q3") + 1.5 * iqr))
    # a row meets its group's fences at once, not each of its values its own
    of = lambda c, e: F.max(F.when(F.col("feature") == c, F.col(e)))
    sides = [(f"_{s}{i}", of(c, e)) for i, c in enumerate(cols) for s, e in (("l", "fence_lo"), ("h", "fence_hi"))]
    wide = fences.groupBy(*[col(b) for b in by_cols]).agg(*[e.alias(n) for n, e in sides])
    rows = join_null_safe(df.select(*[col(b) for b in by_cols], *[num(c).alias(f"_v{i}") for i, c in enumerate(cols)]), wide, by_cols)
    values = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"_v{i}").alias("v"), F.col(f"_l{i}").alias("l"), F.col(f"_h{i}").alias("h"))
                       for i in range(len(cols))])
    long = rows.select(*[col(b) for b in by_cols], F.explode(values).alias("_s")).where(F.col("_s.v").isNotNull())
    v = F.col("_s.v")
    inside = (v >= F.col("_s.l")) & (v <= F.col("_s.h"))
    out = long.groupBy(*[col(b) for b in by_cols], F.col("_s.f").alias("_f")).agg(
        F.min(F.when(inside, v)).alias("whisker_lo"), F.max(F.when(inside, v)).alias("whisker_hi"), F.count_if(~inside).alias("n_outliers"))
    out = out.withColumn("feature", F.array(*[F.lit(c) for c in cols])[F.col("_f")]).drop("_f")
    out = materialize(join_null_safe(fences.drop("fence_lo", "fence_hi"), out, [*by_cols, "feature"]))      # a row per group and feature
    df.unpersist()
    return out


# ------------------------------------------------------------ AGG20 - AGG22

def is_standardized(df: DataFrame, cols: Sequence[str], mean_tol: float = 1e-2,
                    std_lo: float = 0.9, std_hi: float = 1.1) -> DataFrame:
    """AGG20: every column has |mean| < tol and population std in (lo, hi)."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    cond = F.lit(True)
    for i, c in enumerate(cols):
        aggs += [F.avg(num(c)).alias(f"m{i}"), F.stddev_pop(num(c)).alias(f"s{i}")]
    wide = df.agg(*aggs)
    for i in range(len(cols)):
        cond = cond & (F.abs(F.col(f"m{i}")) < mean_tol) & (F.col(f"s{i}") > std_lo) & (F.col(f"s{i}") < std_hi)
    return wide.select(F.coalesce(cond, F.lit(False)).alias("is_standardized"))


def cv_summary(scores: DataFrame, keys: Sequence[str] = ("variant", "model"),
               metrics: Sequence[str] = ("roc_auc", "ap")) -> DataFrame:
    """AGG21: mean and population std of fold scores per key."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return scores.groupBy(*keys).agg(*aggs)


def shape(df: DataFrame) -> DataFrame:
    """AGG22: (rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(len(df.columns)).alias("columns"))


# ------------------------------------------------------------- TOP, SMP, SRT

def sort_desc(df: DataFrame, value: str, name: str) -> DataFrame:
    """SRT1: value descending, name ascending as tie-break."""
    return df.orderBy(F.desc(value), F.asc(name))


def head(df: DataFrame, value: str, name: str, n: int) -> DataFrame:
    """TOP2: first n after SRT1 (TakeOrdered: n rows per task, bounded)."""
    return sort_desc(df, value, name).limit(n)


def first_reaching(df: DataFrame, idx: str, cum: str, threshold: float) -> int | None:
    """TOP3: first index whose cumulative value reaches the threshold."""
    r = df.where(F.col(cum) >= threshold).agg(F.min(idx).alias("k")).first()
    return None if r is None else r["k"]


def bounded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """SMP1: deterministic sample of min(n, rows) rows: the n smallest
    md5(seed|key). Runs as TakeOrderedAndProject - n rows per task."""
    h = ranking.md5_hash(key, seed)
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def pairplot_sample(df: DataFrame, cols: Sequence[str], key: str, n_cols: int = 6, n: int = 2000,
                    seed: int = 42) -> DataFrame:
    """SMP2: top-variance columns, complete rows only, bounded sample."""
    top = top_variance_names(df, cols, n_cols)
    return bounded_sample(df.select(key, *top).dropna("any", subset=top), key, n, seed)
