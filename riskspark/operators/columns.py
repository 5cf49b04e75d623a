"""Column access shared by the operators: names with dots, missing values, joins
on keys that may be NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """The column of that exact name, dots included."""
    return F.col(quoted(name))


def num(name: str | Column) -> Column:
    """A column as double with NaN as NULL: both mean missing, whatever the format
    the data came from. Filters on the raw column still reach the scan."""
    x = (col(name) if isinstance(name, str) else name).cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN in a floating column."""
    floating = dict(df.dtypes)[name] in ("double", "float")
    return col(name).isNull() | F.isnan(col(name)) if floating else col(name).isNull()


def join_null_safe(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; ``b``'s keys are dropped."""
    right = b.select(*[col(k).alias(f"_r{i}") for i, k in enumerate(keys)], *[col(c) for c in b.columns if c not in keys])
    cond = None
    for i, k in enumerate(keys):
        e = col(k).eqNullSafe(F.col(f"_r{i}"))
        cond = e if cond is None else cond & e
    j = a.join(right, cond, how) if keys else a.crossJoin(right)
    return j.drop(*[f"_r{i}" for i in range(len(keys))])
