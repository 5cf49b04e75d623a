"""Principal components (PCA1-PCA9, WIN1, WIN2).

Fit = two tree aggregates over row vectors (moments, correlation), the same
for every width; the d x d eigen-decomposition runs on the driver, which only
ever holds d^2 numbers. A few components of many columns (:func:`fit_pca_truncated`)
need no d x d matrix: implicit products with the centred rows. Scores are one
projection.

Conventions: components sorted by variance (descending); each component's
sign is chosen so its largest-magnitude loading is positive; variance uses
the n - 1 denominator (ratios do not depend on it).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.operators.columns import num

# Component naming rules (first match wins) and their names.
NAMING_RULES = [
    (("credit_amount", "monthly_payment"), "综合消费力"),
    (("age", "duration"), "客户稳定性"),
    (("existing_credits", "installment"), "还款能力"),
    (("savings", "employment"), "经济状况"),
]
FALLBACK_PREFIX = "综合因子"  # followed by the component number

PLAIN_WIDTH = 24           # columns up to which all pairs fit one generated aggregate


@dataclass
class PCAModel:
    features: list[str]
    mean: list[float]
    components: list[list[float]]   # one row per component
    explained_variance: list[float]
    ratio: list[float]
    n: int

    def to_params(self) -> dict:
        return dict(self.__dict__)

    @classmethod
    def from_params(cls, p: dict) -> PCAModel:
        return cls(**p)


def _sign_fix(vecs: np.ndarray) -> np.ndarray:
    """Rows of ``vecs`` flipped so the largest |entry| of each is positive."""
    idx = np.argmax(np.abs(vecs), axis=1)
    signs = np.sign(vecs[np.arange(vecs.shape[0]), idx])
    signs[signs == 0] = 1.0
    return vecs * signs[:, None]


def _exprs(df: DataFrame, cols: Sequence[str] | None, vector: str | None):
    if vector is not None:
        d = df.where(F.col(vector).isNotNull()).select(F.size(vector)).first()[0]
        return [num(F.col(vector)[i]) for i in range(d)], [f"{vector}_{i}" for i in range(d)]
    return [num(c) for c in cols], list(cols)


def _plain_covariance(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    d = len(cols)
    rows = df.select(*[num(c).alias(f"c{i}") for i, c in enumerate(cols)]).dropna()
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    r = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"c{i}").alias(f"m{i}") for i in range(d)],
                 *[F.covar_samp(f"c{i}", f"c{j}").alias(f"v{i}_{j}") for i, j in pairs]).first()
    n = int(r["n"])
    if n == 0:
        return 0, np.zeros(d), np.zeros((d, d))
    cov = np.zeros((d, d))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = r[f"v{i}_{j}"] or 0.0
    return n, np.array([float(r[f"m{i}"]) for i in range(d)]), cov if n > 1 else np.zeros((d, d))


def _vector_moments(rows: DataFrame, column: str, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and variances of a vector column (the summarizer refuses no rows)."""
    if rows.isEmpty():
        return 0, np.zeros(d), np.zeros(d)
    s = rows.select(Summarizer.metrics("count", "mean", "variance").summary(F.col(column)).alias("s")).first()["s"]
    return int(s["count"]), np.array(s["mean"].toArray()), np.array(s["variance"].toArray())


def covariance(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, sample covariance) of complete rows, one way for every width: the
    rows become vectors, Spark ML's summarizer gives count, means and variances, and
    its correlation (a tree aggregate of the Gram matrix on the executors) the rest.
    Few columns need no vectors: one aggregate in generated code, one scan. The driver
    holds d * d numbers either way."""
    if len(cols) <= PLAIN_WIDTH:
        return _plain_covariance(df, cols)
    va = VectorAssembler(inputCols=list(cols), outputCol="_vec", handleInvalid="skip")
    v = va.transform(df.select(*[num(c).alias(c) for c in cols]).dropna()).select("_vec")
    d = len(cols)
    n, mean, var = _vector_moments(v, "_vec", d)
    if n < 2:
        return n, mean, np.zeros((d, d))
    corr = np.nan_to_num(Correlation.corr(v, "_vec").first()[0].toArray())      # constant columns have none
    sd = np.sqrt(var)
    cov = corr * sd[:, None] * sd[None, :]
    cov[np.diag_indices(d)] = var
    return n, mean, (cov + cov.T) / 2


def fit_pca(df: DataFrame, cols: Sequence[str] | None = None, vector: str | None = None) -> PCAModel:
    """PCA1/PCA2: full fit (k = d) on rows without missing values."""
    exprs, names = _exprs(df, cols, vector)
    src = df.select(*[e.alias(n) for e, n in zip(exprs, names)])
    n, mean, cov = covariance(src, names)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    vals, comps = np.clip(vals[order], 0.0, None), _sign_fix(np.asarray(vecs[:, order].T, dtype=float))
    tot = float(vals.sum())
    ratio = vals / tot if tot > 0 else np.zeros_like(vals)
    return PCAModel(names, mean.tolist(), comps.tolist(), vals.tolist(), ratio.tolist(), n)


def _row_arrays(df: DataFrame, cols: Sequence[str] | None, vector: str | None, out: str, keep: Sequence[str] = (),
                d: int | None = None) -> tuple[DataFrame, list[str]]:
    """``keep`` and the row as one array of doubles, rows with a missing value left out."""
    if vector is None:
        x, names = F.array(*[num(c) for c in cols]), list(cols)
    else:
        if d is None:
            first = df.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
            d = first[0] if first else 0
        # shorter vectors end in NULLs and so count as missing, as in the narrow form
        x = F.transform(F.sequence(F.lit(0), F.lit(max(d, 1) - 1)), lambda i: num(F.get(F.col(vector), i)))
        names = [f"{vector}_{i}" for i in range(d)]
    return df.select(*keep, x.alias(out)).where(~F.exists(out, lambda v: v.isNull())), names


def fit_pca_truncated(df: DataFrame, k: int, cols: Sequence[str] | None = None, vector: str | None = None) -> PCAModel:
    """PCA1/PCA7 for ``k`` much smaller than the width: the ``k`` leading components by
    a truncated singular value decomposition of the centred rows.

    One scan gives count, means and the total variance (so ratios are of the whole);
    every Lanczos step is then one tree-aggregated product with the rows, persisted
    once. Neither the driver nor a task holds a d x d matrix once d is 100 or more and
    k at most d / 2; a narrower Gram matrix is formed, which is then the smaller one.
    Components beyond the rank of the data are not returned; without any variance the
    components are unit vectors of variance 0. Missing values as in :func:`fit_pca`."""
    rows, names = _row_arrays(df, cols, vector, "x")
    d = len(names)
    k = min(k, d)
    n, mean, var = _vector_moments(rows.select(array_to_vector("x").alias("v")), "v", d)
    total = float(var.sum()) if n > 1 else 0.0
    if total <= 0:
        return PCAModel(names, mean.tolist(), np.eye(d)[:k].tolist(), [0.0] * k, [0.0] * k, n)
    centres = F.array(*[F.lit(float(m)) for m in mean])
    centred = MLUtils.convertVectorColumnsFromML(
        rows.select(array_to_vector(F.zip_with("x", centres, lambda v, m: v - m)).alias("v")), "v").persist()
    try:
        svd = RowMatrix(centred, n, d).computeSVD(k)
    finally:
        centred.unpersist()
    vals = np.asarray(svd.s.toArray()) ** 2 / (n - 1)
    comps = _sign_fix(np.asarray(svd.V.toArray()).T)
    return PCAModel(names, mean.tolist(), comps.tolist(), vals.tolist(), (vals / total).tolist(), n)


def eigen_residuals(df: DataFrame, model: PCAModel, cols: Sequence[str] | None = None, vector: str | None = None) -> list[float]:
    """Largest entry of ``|C v - lambda v|`` per component, as a share of the first
    variance, from one product of the data with each component."""
    d, k = len(model.features), len(model.components)
    rows, _ = _row_arrays(df, cols, vector, "x", d=d)
    centres = F.array(*[F.lit(float(m)) for m in model.mean])
    x = rows.select(F.zip_with("x", centres, lambda v, m: v - m).alias("x"))
    got = {r["j"]: r for r in _products(x, model.components).collect()}     # d rows of k numbers
    top = max(model.explained_variance[:1] + [1e-300])
    return [float(np.abs(np.array([got[j][f"p{i}"] for j in range(d)]) / (model.n - 1) - lam * np.array(v)).max() / top)
            for i, (v, lam) in enumerate(zip(model.components, model.explained_variance))]


def _products(x: DataFrame, components: Sequence[Sequence[float]]) -> DataFrame:
    """``X' (X v)`` of every component ``v`` for the rows ``x``: (j, p0, p1, ...). Exploding keeps
    a row's products apart from its entries; inlined, each entry would compute them anew."""
    entries = (x.select("x", *[_dot(F.col("x"), c).alias(f"t{i}") for i, c in enumerate(components)])
               .select(F.posexplode("x").alias("j", "v"), *[f"t{i}" for i in range(len(components))]))
    return entries.groupBy("j").agg(*[F.sum(F.col("v") * F.col(f"t{i}")).alias(f"p{i}") for i in range(len(components))])


def _dot(x: Column, weights: Sequence[float]) -> Column:
    w = F.array(*[F.lit(float(v)) for v in weights])
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def project_arrays(df: DataFrame, model: PCAModel, keep: Sequence[str] = (), cols: Sequence[str] | None = None,
                   vector: str | None = None) -> DataFrame:
    """PCA4/PCA7 for wide rows: ``keep`` and PC1.. of every row without missing values.
    A component is one array literal, so the plan does not grow with d * k terms."""
    rows, _ = _row_arrays(df, cols, vector, "_x", keep, len(model.features))
    centres = F.array(*[F.lit(float(m)) for m in model.mean])
    rows = rows.select(*keep, F.zip_with("_x", centres, lambda v, m: v - m).alias("_x"))
    return rows.select(*keep, *[_dot(F.col("_x"), c).alias(f"PC{i + 1}") for i, c in enumerate(model.components)])


def choose_k(ratio: Sequence[float], threshold: float, rule: str = "min2", max_k: int | None = None) -> int:
    """PCA3a (``rule='min2'``): first k with cumulative >= threshold (1 when
    never reached), at least 2, at most ``max_k``. PCA3b (``rule='cap_d'``):
    first k reaching the threshold, d when never reached."""
    cum = np.cumsum(np.asarray(ratio, dtype=float))
    hit = np.nonzero(cum >= threshold)[0]
    if rule == "cap_d":
        return int(hit[0] + 1) if len(hit) else len(ratio)
    k = int(hit[0] + 1) if len(hit) else 1
    k = max(2, k)
    return min(k, max_k) if max_k is not None else k


def variance_table(model: PCAModel, spark, limit: int | None = None) -> DataFrame:
    """PCA2/PCA8 + WIN1: (pc, explained_variance, ratio, cumulative). The
    running sum is a window over the d-row component table only."""
    rows = [(i + 1, float(v), float(r)) for i, (v, r) in enumerate(zip(model.explained_variance, model.ratio))]
    if limit is not None:
        rows = rows[:limit]
    t = spark.createDataFrame(rows, "pc int, explained_variance double, ratio double")
    w = Window.orderBy("pc").rowsBetween(Window.unboundedPreceding, 0)  # d rows, not data rows
    return t.withColumn("cumulative", F.sum("ratio").over(w))


def loadings(model: PCAModel, spark, k: int | None = None) -> DataFrame:
    """PCA5: long (component, feature, loading)."""
    k = k or len(model.components)
    rows = [(f"PC{i + 1}", f, float(v)) for i in range(k) for f, v in zip(model.features, model.components[i])]
    return spark.createDataFrame(rows, "component string, feature string, loading double")


def score_columns(model: PCAModel, k: int, prefix: str = "PC", names: Sequence[str] | None = None) -> list[Column]:
    """PCA4: score_i = sum_j c_ij * (x_j - mean_j) as plain Column arithmetic
    (stays inside whole-stage codegen)."""
    out = []
    for i in range(k):
        terms = [F.lit(float(c)) * (num(f) - F.lit(float(m)))
                 for f, c, m in zip(model.features, model.components[i], model.mean)]
        s = terms[0]
        for t in terms[1:]:
            s = s + t
        out.append(s.alias(names[i] if names else f"{prefix}{i + 1}"))
    return out


def transform(df: DataFrame, model: PCAModel, k: int, keep: Sequence[str] = (), vector: str | None = None,
              names: Sequence[str] | None = None) -> DataFrame:
    """PCA4/PCA7: scores for every row (train, test or a stream)."""
    if vector is not None:
        df = df.select(*keep, *[F.col(vector)[i].cast("double").alias(f) for i, f in enumerate(model.features)])
    return df.select(*keep, *score_columns(model, k, names=names))


def top_features(load: DataFrame, n: int = 5) -> DataFrame:
    """WIN2: top-n features per component by |loading| (ties by name)."""
    w = Window.partitionBy("component").orderBy(F.abs("loading").desc(), "feature")
    return load.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def interpret(load: DataFrame, n: int = 5) -> DataFrame:
    """PCA6: (component, name, top_features, positive, negative). Names come
    from ordered substring rules on the joined top-n feature names."""
    top = top_features(load, n)
    g = top.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("rank", "feature", "loading"))).alias("t"))
    feats = F.transform("t", lambda s: s["feature"])
    joined = F.array_join(feats, " ")
    idx = F.regexp_extract(F.col("component"), r"(\d+)", 1)
    name = None
    for tokens, label in NAMING_RULES:
        cond = None
        for tok in tokens:
            c = joined.contains(tok)
            cond = c if cond is None else (cond | c)
        name = F.when(cond, F.lit(label)) if name is None else name.when(cond, F.lit(label))
    name = name.otherwise(F.concat(F.lit(FALLBACK_PREFIX), idx))
    pos = F.slice(F.transform(F.filter("t", lambda s: s["loading"] > 0), lambda s: s["feature"]), 1, 3)
    neg = F.slice(F.transform(F.filter("t", lambda s: s["loading"] < 0), lambda s: s["feature"]), 1, 3)
    return g.select("component", name.alias("name"), F.array_join(feats, ", ").alias("top_features"),
                    F.array_join(pos, ", ").alias("positive"), F.array_join(neg, ", ").alias("negative"))


def standardize_if_needed(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, bool]:
    """PCA9: scale (population std) only when AGG20 says the columns are not
    already standardized."""
    from riskspark.operators.features import apply_scaler, fit_scaler
    from riskspark.operators.profile import is_standardized
    ok = bool(is_standardized(df, cols).first()["is_standardized"])
    return (df, True) if ok else (apply_scaler(df, fit_scaler(df, cols)), False)
