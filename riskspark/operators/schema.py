"""Schema discovery, predicates and target handling (PRJ5-PRJ8, PRD1, TGT1, TGT2).

Column-kind decisions read ``df.schema`` on the driver (free); anything
data-dependent is ONE aggregate over all candidate columns, guarded by a
cardinality check before any ``collect_set``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from riskspark.functions.scalar import target_rule
from riskspark.operators.columns import col as named

# Target name lists and token sets of the three discovery rules.
TARGET_NAMES = {
    "eda": ["default.payment.next.month", "default", "Class", "class", "target", "DEFAULT", "y", "label"],
    "featurize": ["class", "Class", "default.payment.next.month", "default", "target", "y", "label"],
    "inline": ["default.payment.next.month", "default", "Class", "class", "target", "default_payment_next_month"],
}
EDA_TOKENS = ["0", "1", "yes", "no", "y", "n", "good", "bad", "true", "false"]
INLINE_TOKENS = ["0", "1", "0.0", "1.0", "yes", "no", "YES", "NO", "good", "bad", "Good", "Bad"]

KEY_SUFFIXES = ("key", "_id")


def is_key(name: str) -> bool:
    n = name.lower()
    return n.endswith(KEY_SUFFIXES) or n in ("row_id", "id")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = (), drop_keys: bool = True) -> list[str]:
    """PRJ5: numeric columns by type, minus excluded and key columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)
            and f.name not in exclude and not (drop_keys and is_key(f.name))]


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in exclude]


def coerce_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """PRJ6: tolerant cast of the columns (default: all) to double, bad text
    -> NULL; other columns are kept as they are."""
    cols = list(cols or df.columns)
    return df.withColumns({c: named(c).try_cast("double") for c in cols})


def numeric_or_coerced(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """PRJ5 + PRJ6: numeric columns, or all columns coerced when none is numeric."""
    num = numeric_columns(df, exclude, drop_keys=False)
    if num:
        return df, num
    cols = [c for c in df.columns if c not in exclude]
    return coerce_numeric(df, cols), cols


def onehot_like(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[list[str], list[str]]:
    """PRJ7: split into (numeric, one-hot): one-hot = every non-null value in
    {0, 1} AND an underscore in the name. One aggregate for all columns."""
    cols = list(cols or numeric_columns(df, drop_keys=False))
    row = df.agg(*[F.coalesce(F.bool_and(named(c).isin(0, 1)), F.lit(True)).alias(f"b{i}")
                   for i, c in enumerate(cols)]).first()
    oh = [c for i, c in enumerate(cols) if row[f"b{i}"] and "_" in c]
    return [c for c in cols if c not in oh], oh


def pick_existing(df: DataFrame, candidates: Sequence[str]) -> list[str]:
    """PRJ8: candidates that exist, else fall back to numeric columns."""
    got = [c for c in candidates if c in df.columns]
    return got or numeric_columns(df)


def domain_subset(df: DataFrame, cols: Sequence[str], domain: Sequence[str], lower: bool = True) -> dict[str, bool]:
    """PRD1: is every non-null value (as text) inside ``domain``?"""
    dom = [d.lower() for d in domain] if lower else list(domain)
    def txt(c):
        t = named(c).cast("string")
        return F.lower(t) if lower else t
    row = df.agg(*[F.coalesce(F.bool_and(txt(c).isin(*dom)), F.lit(True)).alias(f"b{i}")
                   for i, c in enumerate(cols)]).first()
    return {c: bool(row[f"b{i}"]) for i, c in enumerate(cols)}


def identify_target(df: DataFrame, rule: str = "eda", max_levels: int = 3) -> str | None:
    """TGT1a/b/c: a known target name, else the first column whose values
    look binary. One guarded aggregate decides for all columns at once:
    the exact distinct count is only followed by ``collect_set`` for columns
    that passed the approximate cardinality check."""
    for name in TARGET_NAMES[rule]:
        if name in df.columns:
            return name
    cols = list(df.columns)
    approx = df.agg(*[F.approx_count_distinct(named(c)).alias(f"a{i}") for i, c in enumerate(cols)]).first()
    small = [c for i, c in enumerate(cols) if (approx[f"a{i}"] or 0) <= max_levels + 2]
    if not small:
        return None
    # bounded: every column here has at most a handful of distinct values
    row = df.agg(*[e for i, c in enumerate(small) for e in (
        F.count_distinct(named(c)).alias(f"n{i}"), F.collect_set(named(c).cast("string")).alias(f"s{i}"))]).first()
    for i, c in enumerate(small):
        n, vals = int(row[f"n{i}"]), set(row[f"s{i}"])
        if n < 2:
            continue  # an all-null or constant column is not a target
        if rule == "eda" and n <= 3 and {v.lower() for v in vals} <= set(EDA_TOKENS):
            return c
        if rule == "featurize" and n == 2:
            return c
        if rule == "inline" and n <= 3 and vals <= set(INLINE_TOKENS):
            return c
    return None


def normalize_target(df: DataFrame, col: str, rule: str = "contains_strict", out: str = "label",
                     drop_missing: bool = True) -> DataFrame:
    """TGT2a/b/c: numeric 0/1 domain -> int as is; otherwise the text rule.
    Missing labels are dropped (reported by the caller), not mapped to 0."""
    is_num01 = domain_subset(df, [col], ["0", "1", "0.0", "1.0"], lower=False)[col]
    if is_num01:
        lab = named(col).cast("double").cast("int")
    else:
        lab = target_rule(named(col), rule)
    res = df.withColumn(out, lab)
    return res.where(F.col(out).isNotNull()) if drop_missing else res


def target_mapping(df: DataFrame, col: str, label: str = "label") -> DataFrame:
    """TGT2 mapping report: distinct (value, label) pairs."""
    return df.select(named(col).cast("string").alias("value"), named(label)).distinct()
