"""Query registry: name -> (spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6, overrides: dict[str, int] | None = None) -> DataFrame:
    """Round every floating column (value-hash hygiene for the oracle compare)."""
    overrides = overrides or {}
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            out.append(F.round(F.col(f.name).cast("double"), overrides.get(f.name, digits)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def rsql(inner: str, dbl: Sequence[str], digits: int = 6, overrides: dict[str, int] | None = None) -> str:
    """Wrap oracle SQL so the listed DOUBLE columns are rounded like :func:`rounded`."""
    overrides = overrides or {}
    if not dbl:
        return inner
    rep = ", ".join(f"round(CAST({c} AS DOUBLE), {overrides.get(c, digits)}) AS {c}" for c in dbl)
    return f"SELECT * REPLACE ({rep}) FROM (\n{inner}\n) _q"
