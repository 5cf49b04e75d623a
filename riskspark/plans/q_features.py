"""Registered feature-engineering queries (FE1-FE11) with DuckDB oracles.

Wide feature tables are reported in long form ``(row_id, split, feature,
value)`` so the oracle needs no data-dependent column list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.operators import features as FE
from riskspark.operators import ranking
from riskspark.plans.fixtures import LABELED_SQL, LOAN_VIEW_SQL, NUMERIC_COLS, ONEHOT_COLS, ORDINAL_MAPS, \
    split_loans, split_sql, with_cte
from riskspark.plans.registry import register, rounded, rsql
from riskspark.session import materialize

_PRE = (LOAN_VIEW_SQL, LABELED_SQL, split_sql("labeled"))
_TRAIN = "split = 'train'"


def loan_spec() -> FE.FeatureSpec:
    return FE.FeatureSpec(amount="credit_amount", numeric=NUMERIC_COLS, ordinal=ORDINAL_MAPS, onehot=ONEHOT_COLS,
                          lower_pct=1.0, upper_pct=99.0)


def _train(s: DataFrame) -> DataFrame:
    return s.where(F.col("split") == "train")


def _long(df: DataFrame, ids, cols) -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(ids), list(cols), "feature", "value")


# ---------------------------------------------------------------- SQL pieces

_WB = f"""wb AS (SELECT quantile_cont(credit_amount, 0.01) AS lo, quantile_cont(credit_amount, 0.99) AS hi
       FROM splitted WHERE {_TRAIN})"""


def _z1(c: str) -> str:
    return f"(CASE WHEN {c} = 0 THEN 1.0 ELSE {c} END)"


_MP = f"credit_amount / ({_z1('duration')} + 1e-8)"
_ENG_SQL = {
    "credit_amount_wins": "CASE WHEN credit_amount IS NOT NULL THEN greatest(lo, least(credit_amount, hi)) END",
    "credit_amount_log": "CASE WHEN credit_amount > -1 THEN ln(1 + credit_amount) END",
    "high_amount_flag": "coalesce(CAST(credit_amount > hi AS INTEGER), 0)",
    "monthly_payment": _MP,
    "credit_per_existing": f"credit_amount / ({_z1('existing_credits')} + 1e-8)",
    "installment_rel": f"({_MP}) / (installment_commitment + 1e-8)",
    "many_dependents_flag": "coalesce(CAST(num_dependents >= 2 AS INTEGER), 0)",
}


def _ord_sql(col: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in ORDINAL_MAPS[col].items())
    return f"CASE {col} {whens} END"


_NUM_FEATURES = list(_ENG_SQL) + NUMERIC_COLS + [f"{c}_ord" for c in ORDINAL_MAPS]
_PRE_SQL = "pre AS (SELECT s.row_id, s.split, " + ", ".join(
    [f"{e} AS {n}" for n, e in _ENG_SQL.items()] + NUMERIC_COLS + [f"{_ord_sql(c)} AS {c}_ord" for c in ORDINAL_MAPS] +
    ONEHOT_COLS) + " FROM splitted s, wb)"
_LEVELS_SQL = "lv AS (" + "\nUNION ALL ".join(
    f"SELECT DISTINCT {i} AS ci, '{c}' AS col, coalesce(CAST({c} AS VARCHAR), 'nan') AS lvl FROM splitted "
    f"WHERE {_TRAIN}" for i, c in enumerate(ONEHOT_COLS)) + ")"


def _onehot_case(alias: str = "p") -> str:
    return "CASE lv.col " + " ".join(
        f"WHEN '{c}' THEN coalesce(CAST({alias}.{c} AS VARCHAR), 'nan')" for c in ONEHOT_COLS) + " END"


def _num_long(src: str, cols) -> str:
    return "\nUNION ALL ".join(f"SELECT row_id, split, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {src}"
                               for c in cols)


# ---------------------------------------------------------------- FE1-FE4

def _engineered(spark, d):
    s = split_loans(spark, d)
    lo, hi = ranking.percentile_column(_train(s), "credit_amount", [0.01, 0.99])
    return FE.engineered(s, "credit_amount", lo, hi)


@register("fe1_amount_features", rsql(with_cte(*_PRE, _WB) + """
SELECT row_id, """ + ", ".join(f"{_ENG_SQL[c]} AS {c}" for c in
                              ["credit_amount_wins", "credit_amount_log", "high_amount_flag"]) +
    " FROM splitted, wb", ["credit_amount_wins", "credit_amount_log"]))
def fe1_amount_features(spark, d):
    return rounded(_engineered(spark, d).select("row_id", "credit_amount_wins", "credit_amount_log",
                                                "high_amount_flag"))


@register("fe2_ratios", rsql(with_cte(*_PRE) + """
SELECT row_id, """ + ", ".join(f"{_ENG_SQL[c]} AS {c}" for c in
                              ["monthly_payment", "credit_per_existing", "installment_rel"]) + " FROM splitted",
    ["monthly_payment", "credit_per_existing", "installment_rel"], 4))
def fe2_ratios(spark, d):
    return rounded(_engineered(spark, d).select("row_id", "monthly_payment", "credit_per_existing",
                                                "installment_rel"), 4)


@register("fe3_age_bucket", with_cte(LOAN_VIEW_SQL) + """
SELECT row_id, CASE WHEN age >= 0 AND age <= 25 THEN '<25' WHEN age > 25 AND age <= 35 THEN '25-34'
                    WHEN age > 35 AND age <= 50 THEN '35-49' WHEN age > 50 AND age <= 120 THEN '50+' END AS age_bucket
FROM loan_view""")
def fe3_age_bucket(spark, d):
    from riskspark.plans.fixtures import loan_view
    lv = loan_view(spark, d)
    return FE.engineered(lv, "credit_amount", 0.0, 0.0).select("row_id", "age_bucket")


@register("fe4_many_dependents_flag", with_cte(LOAN_VIEW_SQL) + f"""
SELECT row_id, {_ENG_SQL['many_dependents_flag']} AS many_dependents_flag FROM loan_view""")
def fe4_many_dependents_flag(spark, d):
    from riskspark.plans.fixtures import loan_view
    return FE.engineered(loan_view(spark, d), "credit_amount", 0.0, 0.0).select("row_id", "many_dependents_flag")


# ---------------------------------------------------------------- FE5-FE9

@register("fe5_ordinal", with_cte(LOAN_VIEW_SQL) + "\nSELECT row_id, " + ", ".join(
    f"{_ord_sql(c)} AS {c}_ord" for c in ORDINAL_MAPS) + " FROM loan_view")
def fe5_ordinal(spark, d):
    from riskspark.plans.fixtures import loan_view
    return FE.apply_ordinal(loan_view(spark, d), ORDINAL_MAPS).select("row_id",
                                                                      *[f"{c}_ord" for c in ORDINAL_MAPS])


# one-hot fitted on train only; NULL injected so that 'nan' is a level, and the
# train side never sees 'MACHINERY', so that level is unseen (all zeros) in test
_FE6_SRC = """fe6 AS (SELECT row_id, split,
       CASE WHEN row_id % 83 = 0 THEN NULL ELSE employment END AS employment,
       CASE WHEN employment = 'MACHINERY' THEN 'train_never' ELSE split END AS fit_split FROM splitted)"""


def _fe6_frame(spark, d):
    s = split_loans(spark, d)
    return s.select("row_id", "split",
                    F.when(F.col("row_id") % 83 != 0, F.col("employment")).alias("employment"),
                    F.when(F.col("employment") == "MACHINERY", "train_never").otherwise(F.col("split"))
                    .alias("fit_split"))


@register("fe6_onehot", with_cte(*_PRE, _FE6_SRC, """
lv AS (SELECT DISTINCT coalesce(employment, 'nan') AS lvl FROM fe6 WHERE fit_split = 'train')""") + """
SELECT f.row_id, 'employment_' || lv.lvl AS feature,
       CASE WHEN coalesce(f.employment, 'nan') = lv.lvl THEN 1.0 ELSE 0.0 END AS value FROM fe6 f, lv""")
def fe6_onehot(spark, d):
    f = _fe6_frame(spark, d)
    levels = FE.fit_onehot(f.where(F.col("fit_split") == "train"), ["employment"])
    return _long(FE.apply_onehot(f, levels), ["row_id"], FE.onehot_names(levels))


@register("fe6_unseen_rows", with_cte(*_PRE, _FE6_SRC) + """
SELECT row_id FROM fe6 WHERE employment = 'MACHINERY'""")
def fe6_unseen_rows(spark, d):
    f = _fe6_frame(spark, d)
    levels = FE.fit_onehot(f.where(F.col("fit_split") == "train"), ["employment"])
    names = FE.onehot_names(levels)
    oh = FE.apply_onehot(f, levels)
    # rows whose one-hot block is all zero are exactly the unseen level
    return oh.where(reduce(lambda a, b: a + b, [F.col(c) for c in names]) == 0).select("row_id")


_FE7_COLS = ["credit_amount", "age", "duration"]


@register("fe7_median_impute", rsql(with_cte(*_PRE, "med AS (SELECT " + ", ".join(
    f"median({c}) AS m_{c}" for c in _FE7_COLS) + f" FROM splitted WHERE {_TRAIN})") + "\nSELECT row_id, " +
    ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in _FE7_COLS) + " FROM splitted, med", _FE7_COLS))
def fe7_median_impute(spark, d):
    s = split_loans(spark, d).select("row_id", "split", *_FE7_COLS)
    med = FE.fit_medians(_train(s), _FE7_COLS)
    return rounded(FE.apply_impute(s, med).select("row_id", *_FE7_COLS))


@register("fe8_standard_scale", rsql(with_cte(*_PRE, "sc AS (SELECT " + ", ".join(
    f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in NUMERIC_COLS) + f" FROM splitted WHERE {_TRAIN})") +
    "\nSELECT row_id, " + ", ".join(
        f"({c} - mu_{c}) / CASE WHEN sd_{c} IS NULL OR sd_{c} = 0 THEN 1 ELSE sd_{c} END AS {c}"
        for c in NUMERIC_COLS) + " FROM splitted, sc", NUMERIC_COLS))
def fe8_standard_scale(spark, d):
    s = split_loans(spark, d).select("row_id", "split", *NUMERIC_COLS)
    return rounded(FE.apply_scaler(s, FE.fit_scaler(_train(s), NUMERIC_COLS)).select("row_id", *NUMERIC_COLS))


@register("fe8_zero_variance", "SELECT r_regionkey, 0.0 AS const FROM region")
def fe8_zero_variance(spark, d):
    from riskspark.plans.fixtures import table
    r = table(spark, d, "region").select("r_regionkey", F.lit(7.0).alias("const"))
    return FE.apply_scaler(r, FE.fit_scaler(r, ["const"])).select("r_regionkey", "const")


_FE9_SQL = with_cte(*_PRE, _LEVELS_SQL, "num AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i + 1}, '{c}')" for i, c in enumerate(_NUM_FEATURES)) + ") t(ord, feature))") + f"""
SELECT ord, feature FROM num
UNION ALL
SELECT {len(_NUM_FEATURES)} + row_number() OVER (ORDER BY ci, lvl) AS ord, col || '_' || lvl AS feature FROM lv"""


@register("fe9_feature_list", _FE9_SQL)
def fe9_feature_list(spark, d):
    s = split_loans(spark, d)
    spec = loan_spec().fit(_train(s))
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(spec.params["feature_list"])],
                                 "ord int, feature string")


# ---------------------------------------------------------------- FE10, FE11

_FE10_SQL = rsql(with_cte(*_PRE, _WB, _PRE_SQL, _LEVELS_SQL, f"""
all_long AS (
  SELECT row_id, split, feature, value, 1 AS is_num FROM ({_num_long('pre', _NUM_FEATURES)})
  UNION ALL
  SELECT p.row_id, p.split, lv.col || '_' || lv.lvl AS feature,
         CASE WHEN {_onehot_case()} = lv.lvl THEN 1.0 ELSE 0.0 END AS value, 0 AS is_num FROM pre p, lv),
med AS (SELECT feature, median(value) AS m FROM all_long WHERE {_TRAIN} GROUP BY feature),
imp AS (SELECT a.row_id, a.split, a.feature, a.is_num, coalesce(a.value, med.m) AS value
        FROM all_long a JOIN med ON a.feature = med.feature),
sc AS (SELECT feature, avg(value) AS mu, stddev_pop(value) AS sd FROM imp WHERE {_TRAIN} AND is_num = 1
       GROUP BY feature)""") + """
SELECT i.row_id, i.split, i.feature,
       CASE WHEN i.is_num = 1 THEN (i.value - sc.mu) / CASE WHEN sc.sd IS NULL OR sc.sd = 0 THEN 1 ELSE sc.sd END
            ELSE i.value END AS value
FROM imp i LEFT JOIN sc ON i.feature = sc.feature""", ["value"])


@register("fe10_featurize", _FE10_SQL)
def fe10_featurize(spark, d):
    s = materialize(split_loans(spark, d))      # joined once for the fit and the features
    spec = loan_spec().fit(_train(s))
    out = spec.transform(s, keep=["row_id", "split"])
    return rounded(_long(out, ["row_id", "split"], spec.params["feature_list"]))


def _fe11_sql(cols) -> str:
    imp = ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in cols)
    wins = ", ".join(f"greatest(lo_{c}, least({c}, hi_{c})) AS {c}" for c in cols)
    logs = ", ".join(f"CASE WHEN {c} + sh_{c} > -1 THEN ln(1 + {c} + sh_{c}) END AS {c}" for c in cols)
    v_long = "\nUNION ALL ".join(
        f"SELECT variant, row_id, split, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM v" for c in cols)
    return rsql(with_cte(*_PRE, f"""
med AS (SELECT {', '.join(f'median({c}) AS m_{c}' for c in cols)} FROM splitted WHERE {_TRAIN}),
imp AS (SELECT row_id, split, {imp} FROM splitted, med),
wb AS (SELECT {', '.join(f'quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}' for c in cols)}
       FROM imp WHERE {_TRAIN}),
mn AS (SELECT {', '.join(f'CASE WHEN min({c}) < 0 THEN -min({c}) ELSE 0 END AS sh_{c}' for c in cols)}
       FROM imp WHERE {_TRAIN}),
v AS (SELECT 'baseline' AS variant, row_id, split, {', '.join(cols)} FROM imp
      UNION ALL SELECT 'winsorize_1_99', row_id, split, {wins} FROM imp, wb
      UNION ALL SELECT 'log1p', row_id, split, {logs} FROM imp, mn),
vl AS ({v_long}),
sc AS (SELECT variant, feature, avg(value) AS mu, stddev_pop(value) AS sd FROM vl WHERE {_TRAIN}
       GROUP BY variant, feature)""") + """
SELECT vl.variant, vl.row_id, vl.split, vl.feature,
       (vl.value - sc.mu) / CASE WHEN sc.sd IS NULL OR sc.sd = 0 THEN 1 ELSE sc.sd END AS value
FROM vl JOIN sc ON vl.variant = sc.variant AND vl.feature = sc.feature""", ["value"])


def variant_frames(s: DataFrame, cols) -> DataFrame:
    """FE11: the three preprocessing variants, fitted on train, stacked with a
    ``variant`` column (one projection per variant over the same input)."""
    params = FE.variants(_train(s), cols)
    parts = [FE.apply_variant(s, name, p).select(F.lit(name).alias("variant"), "row_id", "split", *cols)
             for name, p in params.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("fe11_preprocess_variants", _fe11_sql(NUMERIC_COLS))
def fe11_preprocess_variants(spark, d):
    # the fit and every variant read the joined view
    s = materialize(split_loans(spark, d).select("row_id", "split", *NUMERIC_COLS))
    return rounded(_long(variant_frames(s, NUMERIC_COLS), ["variant", "row_id", "split"], NUMERIC_COLS))
