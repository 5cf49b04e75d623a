"""Binary linear discriminant analysis (LDA1-LDA4) in closed form.

Fit is one grouped aggregate (count and means per class) and the covariance of
all rows; the within-class scatter is the total scatter less that of the class
means, so no per-class cross products are needed. The d x d pooled covariance
is solved on the driver with a pseudo-inverse (rank-deficient inputs are fine):

    Sw = (S_0 + S_1) / (n - 2),   w = pinv(Sw) (m_1 - m_0),
    b  = -(m_1 + m_0) . w / 2 + ln(p_1 / p_0)

``score = x . w + b`` is the log-posterior ratio of the two Gaussian
classes with shared covariance; prediction is ``score > 0``.
(Spark ML's ``LDA`` is topic modelling, unrelated.)
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.scalar import posterior
from riskspark.operators.columns import col, num
from riskspark.operators.reduce import covariance


@dataclass
class LDAModel:
    """All fields are JSON values (lists by class, in the order of ``classes``), so a
    saved model is equal to the loaded one."""
    features: list[str]
    coef: list[float]
    intercept: float
    class_counts: list[int]
    class_means: list[list[float]]
    priors: list[float]
    classes: list[int] = field(default_factory=lambda: [0, 1])
    explained_ratio: float = 1.0

    def to_params(self) -> dict:
        return dict(self.__dict__)

    @classmethod
    def from_params(cls, p: dict) -> LDAModel:
        return cls(**p)


def fit_lda(df: DataFrame, cols: Sequence[str], label: str = "label", priors: Sequence[float] | None = None) -> LDAModel:
    """LDA1. ``priors``: of classes 0 and 1 (default: their shares)."""
    cols = list(cols)
    src = df.select(col(label).cast("int").alias("_y"), *[num(c).alias(c) for c in cols]).dropna()
    # two classes and something else to complain about: three rows at most
    rows = src.groupBy("_y").agg(F.count(F.lit(1)).alias("n"), *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(cols)]) \
        .orderBy("_y").limit(3).collect()
    if [r["_y"] for r in rows] != [0, 1]:
        raise ValueError(f"binary LDA needs classes 0 and 1, got {[r['_y'] for r in rows]}")
    (n0, m0), (n1, m1) = ((int(r["n"]), np.array([float(r[f"m{i}"]) for i in range(len(cols))])) for r in rows)
    n, mean, cov = covariance(src, cols)
    # within-class scatter = total scatter - scatter of the class means
    between = n0 * np.outer(m0 - mean, m0 - mean) + n1 * np.outer(m1 - mean, m1 - mean)
    sw = ((n - 1) * cov - between) / max(n - 2, 1)
    w = np.linalg.pinv(sw, hermitian=True) @ (m1 - m0)
    p0, p1 = priors or (n0 / n, n1 / n)
    b = -float((m1 + m0) @ w) / 2.0 + math.log(p1 / p0)
    return LDAModel(cols, [float(x) for x in w], b, [n0, n1], [m0.tolist(), m1.tolist()], [float(p0), float(p1)])


def score(model: LDAModel) -> Column:
    s = F.lit(model.intercept)
    for f, c in zip(model.features, model.coef):
        s = s + F.lit(c) * num(f)
    return s


def predict(df: DataFrame, model: LDAModel, keep: Sequence[str] | None = None) -> DataFrame:
    """LDA3: score, class (score > 0) and posterior probability of class 1."""
    s = score(model)
    cols = list(keep) if keep is not None else df.columns
    return df.select(*cols, s.alias("score")).withColumns(
        {"pred": (F.col("score") > 0).cast("int"), "prob": posterior(F.col("score"))})


def coefficients(model: LDAModel, spark) -> DataFrame:
    """LDA2: (feature, coefficient, abs_coefficient), largest magnitude first."""
    t = spark.createDataFrame([(f, float(c)) for f, c in zip(model.features, model.coef)],
                              "feature string, coefficient double")
    return t.withColumn("abs_coefficient", F.abs("coefficient")).orderBy(F.desc("abs_coefficient"), "feature")


def summary(model: LDAModel, spark) -> DataFrame:
    """LDA4: explained ratio (1.0 for two classes), classes, feature count."""
    return spark.createDataFrame(
        [(float(model.explained_ratio), ",".join(str(k) for k in model.classes), len(model.features),
          float(model.intercept))],
        "explained_ratio double, classes string, n_features int, intercept double")
