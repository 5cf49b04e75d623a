"""Train-fitted feature engineering (FE1-FE11, JN1, JN4).

``fit`` functions run aggregations on the *train* rows and return small
dicts; ``apply`` functions are projections, so the whole transform of
:class:`FeatureSpec` compiles to one whole-stage-codegen span per split.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.scalar import clip, cut_right, flag, lookup, ratio, safe_div
from riskspark.operators import ranking
from riskspark.operators.columns import col, num

MAX_LEVELS = 1000  # wide one-hot: levels become columns
MAX_SPARSE_LEVELS = 2_000_000  # sparse one-hot: a model of them has one coefficient each on the driver
MAX_FOLDS = 1000   # folds of one cross-validation


# ------------------------------------------------------------ scaler (FE8)

def fit_scaler(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """FE8 fit: mean and *population* std per column (std 0 -> 1)."""
    row = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.avg(num(c)).alias(f"m{i}"), F.stddev_pop(num(c)).alias(f"s{i}"))]
                 ).first()
    out = {}
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        out[c] = (0.0 if m is None else float(m), 1.0 if (s is None or s == 0) else float(s))
    return out


def apply_scaler(df: DataFrame, params: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (num(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()})


# ------------------------------------------------------------ impute (FE7)

def fit_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """FE7 fit: exact per-column medians (one selection job for all columns)."""
    return {c: v[0] for c, v in ranking.percentiles(df, cols, [0.5])[()].items()}


def apply_impute(df: DataFrame, values: Mapping[str, float | None]) -> DataFrame:
    """FE7 apply: missing (NULL or NaN) -> the fitted value, as double, so that an
    integer column takes a fractional median unharmed."""
    return df.withColumns({c: F.coalesce(num(c), F.lit(float(v))) for c, v in values.items() if v is not None})


# ------------------------------------------------------- ordinal / one-hot

def apply_ordinal(df: DataFrame, maps: Mapping[str, Mapping[str, int]], suffix: str = "_ord") -> DataFrame:
    """FE5: dictionary ordinal code, unknown or missing -> NULL (double)."""
    return df.withColumns({f"{c}{suffix}": lookup(col(c), m).cast("double") for c, m in maps.items()})


def lookup_join(df: DataFrame, column: str, dim: DataFrame, dim_key: str, dim_val: str, out: str,
                default=None, max_broadcast_rows: int = ranking.BROADCAST_ROW_LIMIT) -> DataFrame:
    """JN4 (large dictionary form): left join to a dimension table + default.

    The dimension is broadcast only after its row count is checked."""
    n = dim.count()
    d = dim.select(F.col(dim_key).alias("_k"), F.col(dim_val).alias(out))
    d = F.broadcast(d) if n <= max_broadcast_rows else d
    j = df.join(d, col(column) == F.col("_k"), "left").drop("_k")
    return j if default is None else j.withColumn(out, F.coalesce(F.col(out), F.lit(default)))


def fit_onehot(df: DataFrame, cols: Sequence[str], max_levels: int = MAX_LEVELS) -> dict[str, list[str]]:
    """FE6 fit: sorted train levels per column; missing is the level ``nan``.

    The wide form makes a column of every level, so it is for columns with at most
    ``max_levels`` of them; :func:`onehot_long` has no such bound. One job: at most
    one level more than allowed per column reaches the driver."""
    s = df.select(*[F.coalesce(col(c).cast("string"), F.lit("nan")).alias(f"c{i}") for i, c in enumerate(cols)])
    rows = (s.unpivot([], [f"c{i}" for i in range(len(cols))], "f", "v").distinct()
            .limit(max_levels * len(cols) + 1).collect())
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        out[cols[int(r["f"][1:])]].append(r["v"])
    for c, v in out.items():
        if len(v) > max_levels or len(rows) > max_levels * len(cols):
            raise ValueError(f"{c}: more than {max_levels} levels do not make sensible columns; use onehot_long")
    return {c: sorted(v) for c, v in out.items()}


def onehot_long(df: DataFrame, key: str, cols: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """FE6 in long form (key, feature, value): one row per column and row whose level
    occurs in ``train`` (default: the same rows). Any number of levels; the zeros of
    the wide form are the rows that are not there."""
    def long(d, *keep):
        parts = F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(col(c).cast("string"), F.lit("nan")).alias("v")) for c in cols])
        return d.select(*keep, F.explode(parts).alias("_s")).select(*keep, F.concat_ws("_", "_s.c", "_s.v").alias("feature"))

    out = long(df, key)
    if train is not None:
        out = out.join(long(train).distinct(), "feature", "left_semi")
    return out.select(key, "feature", F.lit(1.0).alias("value"))


def level_tokens(cols: Sequence[str]) -> Column:
    """The row's levels, one ``number:value`` per column (missing is ``nan``): the long
    form before it is exploded."""
    return F.array(*[F.concat(F.lit(f"{i}:"), F.coalesce(col(c).cast("string"), F.lit("nan"))) for i, c in enumerate(cols)])


def count_levels(df: DataFrame, cols: Sequence[str]) -> int:
    """Number of different levels of ``cols`` together, the missing one included."""
    return df.select(F.explode(level_tokens(cols)).alias("t")).distinct().count()


def fit_sparse_onehot(train: DataFrame, cols: Sequence[str], max_levels: int = MAX_SPARSE_LEVELS,
                      out: str = "levels") -> CountVectorizerModel:
    """FE6/FE10 fit for columns of many levels: the train levels of ``cols``, counted on
    the executors, as the places of one sparse vector. More than ``max_levels`` in all
    are refused (none is dropped): that many names are broadcast, and a model of them
    holds as many coefficients. Train without rows is refused too."""
    tokens = train.select(level_tokens(cols).alias("_tokens"))
    if tokens.isEmpty():
        raise ValueError("no rows to take levels from")
    model = CountVectorizer(inputCol="_tokens", outputCol=out, vocabSize=max_levels + 1, minDF=1.0, binary=True).fit(tokens)
    if len(model.vocabulary) > max_levels:
        raise ValueError(f"{', '.join(cols)}: more than {max_levels} levels")
    return model


def sparse_onehot_names(model: CountVectorizerModel, cols: Sequence[str]) -> list[str]:
    """The wide form's column name of every place of the vector."""
    return [f"{cols[int(i)]}_{v}" for i, v in (t.split(":", 1) for t in model.vocabulary)]


def apply_sparse_onehot(df: DataFrame, model: CountVectorizerModel, cols: Sequence[str]) -> DataFrame:
    """FE6/FE10 apply: one sparse 0/1 vector column, as wide as the fit has levels; an
    unseen level has no place. The rows are not moved, and the schema carries the width
    only, not a name per level."""
    out = model.getOutputCol()
    got = model.transform(df.withColumn("_tokens", level_tokens(cols))).drop("_tokens")
    return got.withColumn(out, F.col(out).alias(out, metadata={"ml_attr": {"num_attrs": len(model.vocabulary)}}))


def onehot_names(levels: Mapping[str, Sequence[str]]) -> list[str]:
    return [f"{c}_{v}" for c, vs in levels.items() for v in vs]


def apply_onehot(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """FE6 apply: one 0/1 double column per train level; unseen -> all zero."""
    cols = {}
    for c, vs in levels.items():
        v = F.coalesce(col(c).cast("string"), F.lit("nan"))
        for lvl in vs:
            cols[f"{c}_{lvl}"] = F.when(v == F.lit(lvl), F.lit(1.0)).otherwise(F.lit(0.0))
    return df.withColumns(cols)


# -------------------------------------------------- engineered (FE1-FE4)

def engineered(df: DataFrame, amount: str, lo: float, hi: float, duration: str = "duration",
               existing: str = "existing_credits", installment: str = "installment_commitment",
               age: str = "age", dependents: str = "num_dependents") -> DataFrame:
    """FE1-FE4 as one projection."""
    a = F.col(amount)
    mp = ratio(a, F.col(duration))
    return df.withColumns({
        f"{amount}_wins": clip(a, lo, hi),
        f"{amount}_log": F.log1p(a),
        "high_amount_flag": flag(a, hi, ">"),
        "monthly_payment": mp,
        "credit_per_existing": ratio(a, F.col(existing)),
        "installment_rel": safe_div(mp, F.col(installment)),
        "age_bucket": cut_right(F.col(age)),
        "many_dependents_flag": flag(F.col(dependents), 2, ">="),
    })


# Names of the engineered columns and of the raw numeric ones.
ENGINEERED = ["credit_amount_wins", "credit_amount_log", "high_amount_flag", "monthly_payment",
              "credit_per_existing", "installment_rel", "many_dependents_flag"]


NUMERIC = ("duration", "credit_amount", "installment_commitment", "residence_since", "age", "existing_credits",
           "num_dependents")


@dataclass
class FeatureSpec:
    """FE10: declarative featurization (replaces hard-coded column names)."""
    amount: str = "credit_amount"
    numeric: Sequence[str] = NUMERIC
    ordinal: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    onehot: Sequence[str] = ()
    lower_pct: float = 1.0
    upper_pct: float = 99.0
    params: dict = field(default_factory=dict)

    def _numeric_keep(self) -> list[str]:
        eng = [f"{self.amount}_wins", f"{self.amount}_log"] + ENGINEERED[2:]
        return eng + list(self.numeric) + [f"{c}_ord" for c in self.ordinal]

    def _pre(self, df: DataFrame, lo: float, hi: float) -> DataFrame:
        return apply_ordinal(engineered(df, self.amount, lo, hi), self.ordinal)

    def fit(self, train: DataFrame) -> FeatureSpec:
        """Three fits on train, which is materialized once: all quantiles and medians
        in one selection, the one-hot levels, the scaler."""
        from riskspark.session import materialize
        train = materialize(train)
        try:
            return self._fit(train)
        finally:
            train.unpersist()

    def _fit(self, train: DataFrame) -> FeatureSpec:
        low, high = self.lower_pct / 100, self.upper_pct / 100
        num_cols = self._numeric_keep()
        clipped, flagged = f"{self.amount}_wins", "high_amount_flag"
        # features that need no fences; the two that do follow from the amount's own
        # middle values, which lie within the fences
        free = [c for c in num_cols if c not in (clipped, flagged)]
        ps = ranking.percentiles(self._pre(train, 0.0, 0.0), free, sorted({low, 0.5, high}))[()]
        at = dict(zip(sorted({low, 0.5, high}), zip(*[ps[c] for c in free])))
        amount = free.index(self.amount)
        lo, hi = at[low][amount], at[high][amount]
        med = dict(zip(free, at[0.5]))
        if low <= 0.5 <= high:
            med |= {clipped: med[self.amount], flagged: None if med[self.amount] is None else 0.0}
        else:
            med |= fit_medians(self._pre(train, lo, hi), [clipped, flagged])
        levels = fit_onehot(train, self.onehot) if self.onehot else {}
        scale = fit_scaler(apply_impute(self._pre(train, lo, hi), med), num_cols)
        self.params = {"winsor": {"column": self.amount, "lower_pct": self.lower_pct, "upper_pct": self.upper_pct,
                                  "lo": lo, "hi": hi},
                       "levels": levels, "medians": {c: med[c] for c in num_cols}, "scaler": scale,
                       "ordinal_maps": {k: dict(v) for k, v in self.ordinal.items()},
                       "feature_list": num_cols + onehot_names(levels)}
        return self

    def to_params(self) -> dict:
        """Everything that :meth:`transform` needs, as plain JSON values."""
        return {"amount": self.amount, "numeric": list(self.numeric), "onehot": list(self.onehot),
                "ordinal": {k: dict(v) for k, v in self.ordinal.items()}, "lower_pct": self.lower_pct,
                "upper_pct": self.upper_pct, "params": {**self.params, "scaler": {c: list(v) for c, v in self.params["scaler"].items()}}}

    @classmethod
    def from_params(cls, p: dict) -> FeatureSpec:
        return cls(**p)

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """One projection: engineered -> ordinal -> one-hot -> impute -> scale."""
        p = self.params
        w = p["winsor"]
        out = apply_onehot(self._pre(df, w["lo"], w["hi"]), p["levels"])
        out = apply_impute(out, p["medians"])
        out = apply_scaler(out, {c: tuple(v) for c, v in p["scaler"].items()})
        return out.select(*keep, *[num(c).alias(c) for c in p["feature_list"]])


VARIANT_NAMES = ("baseline", "winsorize_1_99", "log1p")


def variants(train: DataFrame, cols: Sequence[str], names: Sequence[str] = VARIANT_NAMES) -> dict:
    """FE11 fit: baseline (impute + scale), winsorize_1_99 (+clip), log1p
    (+train shift), each scaled on train. Returns params per requested variant."""
    return _fit_variants(train, cols, names, ranking.percentiles(train, cols, _VARIANT_QS, fill=True))[()]


def fold_variants(folds: DataFrame, cols: Sequence[str], names: Sequence[str] = VARIANT_NAMES, fold: str = "fold") -> dict[int, dict]:
    """FE11 parameters of every leave-one-fold-out training set: fold -> variant -> params.

    Quantiles come from counts per fold, added up for each training set that a fold is
    in; for the moments a row counts for each such set, combined map-side. So all sets
    are fitted by the same few jobs, however many folds and variants there are."""
    ids = [r[0] for r in folds.select(fold).distinct().limit(MAX_FOLDS + 1).collect()]
    if len(ids) > MAX_FOLDS:
        raise ValueError(f"more than {MAX_FOLDS} folds")
    folds = folds.where(col(fold).isNotNull())      # such a row is in no training set
    ps = ranking.percentiles(folds, cols, _VARIANT_QS, without=fold, fill=True)
    sets = folds.select(*[col(c) for c in cols], col(fold), F.explode(F.array(*[F.lit(i) for i in sorted(ids)])).alias("_without"))
    fitted = _fit_variants(sets.where(F.col("_without") != col(fold)).drop(fold), cols, names, ps, "_without")
    return {group[0]: params for group, params in fitted.items()}


_VARIANT_QS = (0.5, 0.0, 0.01, 0.99)


def _fit_variants(rows: DataFrame, cols: Sequence[str], names: Sequence[str], ps: dict, by: str | None = None) -> dict[tuple, dict]:
    """Parameters per group from ``ps``, the ``_VARIANT_QS`` of its columns filled with
    their medians, and the mean and deviation of every variant's columns, one aggregate."""
    keys, cols = [by] if by else [], list(cols)
    med = {g: {c: v[0] for c, v in per.items()} for g, per in ps.items()}

    def pick(values: dict):
        """A group's own number, as a literal per group."""
        if not by:
            return F.lit(values.get(())).cast("double")
        out = F.lit(None).cast("double")
        for g, v in values.items():
            out = F.when(F.col(by) == g[0], F.lit(v)).otherwise(out)
        return out

    filled = rows.select(*keys, *[F.coalesce(num(c), pick({g: m[c] for g, m in med.items()})).alias(f"c{i}") for i, c in enumerate(cols)])
    mine = [f"c{i}" for i in range(len(cols))]
    bounds = {g: {c: (per[c][2], per[c][3]) for c in cols} for g, per in ps.items()}
    shift = {g: {c: -per[c][1] if per[c][1] is not None and per[c][1] < 0 else 0.0 for c in cols} for g, per in ps.items()}
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(mine[i])
        lo, hi = (pick({g: b[c][side] for g, b in bounds.items()}) for side in (0, 1))
        forms = {"baseline": x, "winsorize_1_99": F.when(x.isNotNull(), F.greatest(F.least(x, hi), lo)),
                 "log1p": F.log1p(x + pick({g: s[c] for g, s in shift.items()}))}
        for v in names:
            aggs += [F.avg(forms[v]).alias(f"m{i}_{v}"), F.stddev_pop(forms[v]).alias(f"s{i}_{v}")]
    out = {}
    for r in filled.groupBy(*keys).agg(*aggs).limit(MAX_FOLDS + 1).collect():
        g = (r[by],) if by else ()

        def scaler(v, r=r):
            pairs = ((c, r[f"m{i}_{v}"], r[f"s{i}_{v}"]) for i, c in enumerate(cols))
            return {c: (0.0 if m is None else float(m), 1.0 if not s else float(s)) for c, m, s in pairs}

        more = {"baseline": {}, "winsorize_1_99": {"bounds": bounds.get(g)}, "log1p": {"shift": shift.get(g)}}
        nothing = dict.fromkeys(cols)
        out[g] = {v: {"medians": med.get(g, nothing), **more[v], "scaler": scaler(v)} for v in names}
    return out


def apply_variant(df: DataFrame, name: str, params: dict) -> DataFrame:
    from riskspark.operators.outlier import apply_log_shift, apply_winsorize
    out = apply_impute(df, params["medians"])
    if name == "winsorize_1_99":
        out = apply_winsorize(out, params["bounds"])
    elif name == "log1p":
        out = apply_log_shift(out, params["shift"])
    return apply_scaler(out, params["scaler"])
