"""Scalar column builders (SCL1-SCL12, TGT2). All return JVM-side Columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for identical results.
EPS = 1e-8
AGE_EDGES = [0, 25, 35, 50, 120]
AGE_LABELS = ["<25", "25-34", "35-49", "50+"]
MAD_SCALE = 1.4826


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x, lo: float | None, hi: float | None) -> Column:
    """SCL1: clip to [lo, hi]; missing stays missing (``greatest``/``least``
    skip NULLs, so the guard is required)."""
    c = _c(x)
    y = c
    if hi is not None:
        y = F.least(y, F.lit(float(hi)))
    if lo is not None:
        y = F.greatest(y, F.lit(float(lo)))
    return F.when(c.isNotNull(), y)


def log1p(x) -> Column:
    """SCL2: log(1 + x); NULL for x <= -1."""
    return F.log1p(_c(x))


def safe_div(a, b, eps: float = EPS) -> Column:
    """SCL3: a / (b + eps)."""
    return _c(a) / (_c(b) + F.lit(eps))


def zero_to(x, value: float = 1.0) -> Column:
    """SCL4: replace exact zeros by ``value``."""
    c = _c(x)
    return F.when(c == 0, F.lit(value)).otherwise(c)


def ratio(num, den, zero_to_one: bool = True, eps: float = EPS) -> Column:
    """FE2 building block: num / (den' + eps), den' = den with 0 -> 1."""
    d = zero_to(den, 1.0) if zero_to_one else _c(den)
    return safe_div(num, d, eps)


def cut_right(x, edges: Sequence[float] = AGE_EDGES, labels: Sequence[str] = AGE_LABELS) -> Column:
    """SCL5: right-closed bins (a, b], the first bin also takes its left edge;
    out-of-range or missing -> NULL."""
    c = _c(x)
    expr = None
    for i, lab in enumerate(labels):
        lo, hi = float(edges[i]), float(edges[i + 1])
        cond = ((c >= lo) if i == 0 else (c > lo)) & (c <= hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def flag(x, threshold: float, op: str = ">") -> Column:
    """SCL6: 0/1 threshold flag, missing -> 0."""
    c = _c(x)
    t = F.lit(float(threshold))
    cond = {">": c > t, ">=": c >= t, "<": c < t, "<=": c <= t}[op]
    return F.coalesce(cond.cast("int"), F.lit(0))


def to_double(x) -> Column:
    """SCL7 / PRJ6: tolerant numeric coercion (bad text -> NULL, not an error)."""
    return _c(x).try_cast("double")


def norm_text(x) -> Column:
    """SCL8: lower(trim(x))."""
    return F.lower(F.trim(_c(x).cast("string")))


def posterior(score) -> Column:
    """SCL12: binary posterior from a log-odds score."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(score)))


def lookup(x, mapping: Mapping, default=None) -> Column:
    """JN4 (small dictionary form): literal map lookup with default."""
    if not mapping:
        return F.lit(default)
    m = F.create_map(*[e for k, v in mapping.items() for e in (F.lit(k), F.lit(v))])
    val = m[_c(x).cast("string")]
    return val if default is None else F.coalesce(val, F.lit(default))


# --------------------------------------------------------------- targets (TGT2)

# Tokens that mark the positive class in each rule.
TARGET_TOKENS_CONTAINS_STRICT = ["bad", "yes", "true"]      # substring match
TARGET_EQUALS_STRICT = ["1", "t"]                           # exact match
TARGET_TOKENS_CONTAINS_LOOSE = ["bad", "yes", "1", "default", "t"]  # substring match
TARGET_TOKENS_EXACT = ["bad", "1", "yes", "true", "t"]      # exact match


def target_rule(x, rule: str = "contains_strict") -> Column:
    """TGT2a/b/c text rules mapping a label value to 0/1 (NULL stays NULL).

    ``contains_strict`` (profiling): contains bad/yes/true, or equals 1/t.
    ``contains_loose`` (featurize): contains any of bad/yes/1/default/t.
    ``exact`` (winsorize): lower-case value is one of bad/1/yes/true/t.
    """
    c = _c(x)
    s = F.lower(F.trim(c.cast("string")))
    if rule == "contains_strict":
        pos = F.lit(False)
        for t in TARGET_TOKENS_CONTAINS_STRICT:
            pos = pos | s.contains(t)
        pos = pos | s.isin(*TARGET_EQUALS_STRICT)
    elif rule == "contains_loose":
        pos = F.lit(False)
        for t in TARGET_TOKENS_CONTAINS_LOOSE:
            pos = pos | s.contains(t)
    elif rule == "exact":
        pos = F.lower(c.cast("string")).isin(*TARGET_TOKENS_EXACT)
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return F.when(c.isNotNull(), pos.cast("int"))
