"""Registered projection, predicate, target, scalar, set and join queries
(PRJ1-PRJ8, FLT1-FLT2, PRD1, TGT1-TGT2, SCL1-SCL12, SET1-SET2, JN1-JN4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.functions import scalar as S
from riskspark.operators import features as FE
from riskspark.operators import schema as SC
from riskspark.plans.fixtures import LABELED_SQL, LOAN_VIEW_SQL, ORDINAL_MAPS, labeled_loans, loan_view, \
    split_loans, split_sql, table, with_cte
from riskspark.plans.registry import register, rounded, rsql

_LV = with_cte(LOAN_VIEW_SQL)
_LOAN_PRE = (LOAN_VIEW_SQL, LABELED_SQL, split_sql("labeled"))


def _sql_list(vals) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in vals)


# ------------------------------------------------------------ projections

@register("prj1_select", _LV + "\nSELECT row_id, credit_amount, duration FROM loan_view")
def prj1_select(spark, d):
    return loan_view(spark, d).select("row_id", "credit_amount", "duration")


@register("prj2_drop", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def prj2_drop(spark, d):
    # absent names are ignored, as in the reference
    return table(spark, d, "orders").drop("o_orderdate", "o_orderpriority", "no_such_column")


@register("prj3_derive", rsql(_LV + """
SELECT row_id, credit_amount / 1000.0 AS credit_amount, duration + installment_commitment AS load
FROM loan_view""", ["credit_amount", "load"]))
def prj3_derive(spark, d):
    lv = loan_view(spark, d)
    out = lv.withColumns({"credit_amount": F.col("credit_amount") / 1000.0,
                          "load": F.col("duration") + F.col("installment_commitment")})
    return rounded(out.select("row_id", "credit_amount", "load"))


@register("prj4_transpose", rsql("""
SELECT stat, value FROM (SELECT avg(c_acctbal) AS mean_acctbal, min(c_acctbal) AS min_acctbal,
                                max(c_acctbal) AS max_acctbal FROM customer)
UNPIVOT (value FOR stat IN (mean_acctbal, min_acctbal, max_acctbal))""", ["value"]))
def prj4_transpose(spark, d):
    wide = table(spark, d, "customer").agg(F.avg("c_acctbal").alias("mean_acctbal"),
                                           F.min("c_acctbal").alias("min_acctbal"),
                                           F.max("c_acctbal").alias("max_acctbal"))
    return rounded(wide.unpivot([], ["mean_acctbal", "min_acctbal", "max_acctbal"], "stat", "value"))


def _kinds(df, cols_num, cols_cat):
    aggs = [F.count(c).alias(f"n{i}") for i, c in enumerate(cols_num + cols_cat)]
    row_df = df.agg(*aggs)
    parts = [F.struct(F.lit(c).alias("feature"), F.lit("numeric" if c in cols_num else "categorical").alias("kind"),
                      F.col(f"n{i}").alias("non_null")) for i, c in enumerate(cols_num + cols_cat)]
    return row_df.select(F.explode(F.array(*parts)).alias("_s")).select("_s.*")


_PRJ5_NUM = ["duration", "credit_amount", "installment_commitment", "residence_since", "age", "existing_credits",
             "num_dependents"]
_PRJ5_CAT = ["savings_status", "employment", "purpose", "housing"]
_PRJ5_SQL = _LV + "\n" + "\nUNION ALL\n".join(
    [f"SELECT '{c}' AS feature, 'numeric' AS kind, count({c}) AS non_null FROM loan_view" for c in _PRJ5_NUM] +
    [f"SELECT '{c}' AS feature, 'categorical' AS kind, count({c}) AS non_null FROM loan_view" for c in _PRJ5_CAT])


@register("prj5_dtype_split", _PRJ5_SQL)
def prj5_dtype_split(spark, d):
    lv = loan_view(spark, d)
    num = SC.numeric_columns(lv)                       # row_id is a key, dropped
    cat = SC.categorical_columns(lv, exclude=["class"])  # the target is held apart
    return _kinds(lv, num, cat)


@register("prj6_coerce_numeric", """
SELECT p_partkey, TRY_CAST(p_brand AS DOUBLE) AS p_brand, TRY_CAST(substr(p_brand, 7) AS DOUBLE) AS brand_no
FROM part""")
def prj6_coerce_numeric(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.substring("p_brand", 7, 100).alias("brand_no"))
    return SC.coerce_numeric(p, ["p_brand", "brand_no"])


_PRJ7_COLS = ["duration", "num_dependents", "label", "many_dependents_flag", "housing_own", "housing_rent"]


def _prj7_frame(spark, d):
    lv = labeled_loans(spark, d)
    return lv.select(
        "duration", "num_dependents", "label",
        S.flag("num_dependents", 2, ">=").alias("many_dependents_flag"),
        F.when(F.col("housing") == "own", 1.0).otherwise(0.0).alias("housing_own"),
        F.when(F.col("housing") == "rent", 1.0).otherwise(0.0).alias("housing_rent"))


@register("prj7_onehot_split", with_cte(LOAN_VIEW_SQL, LABELED_SQL, """
f AS (SELECT duration, num_dependents, label,
             CASE WHEN num_dependents >= 2 THEN 1 ELSE 0 END AS many_dependents_flag,
             CASE WHEN housing = 'own' THEN 1.0 ELSE 0.0 END AS housing_own,
             CASE WHEN housing = 'rent' THEN 1.0 ELSE 0.0 END AS housing_rent FROM labeled),
b AS (SELECT """ + ", ".join(f"coalesce(bool_and({c} IN (0, 1)), true) AS {c}" for c in _PRJ7_COLS) + " FROM f)") +
    "\n" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, CASE WHEN {c} AND {str('_' in c).lower()} THEN 'onehot' ELSE 'numeric' END AS kind "
        f"FROM b" for c in _PRJ7_COLS))
def prj7_onehot_split(spark, d):
    num, oh = SC.onehot_like(_prj7_frame(spark, d), _PRJ7_COLS)
    rows = [(c, "onehot") for c in oh] + [(c, "numeric") for c in num]
    return spark.createDataFrame(rows, "feature string, kind string")


@register("prj8_pick_existing", _LV + "\nSELECT credit_amount, age FROM loan_view")
def prj8_pick_existing(spark, d):
    lv = loan_view(spark, d)
    return lv.select(*SC.pick_existing(lv, ["credit_amount", "no_such_column", "age"]))


# ------------------------------------------------------------ filters

@register("flt1_dropna_one", _LV + "\nSELECT row_id FROM loan_view WHERE credit_amount IS NOT NULL")
def flt1_dropna_one(spark, d):
    return loan_view(spark, d).dropna(subset=["credit_amount"]).select("row_id")


@register("flt2_dropna_any", _LV + "\nSELECT row_id FROM loan_view WHERE credit_amount IS NOT NULL AND age IS NOT NULL")
def flt2_dropna_any(spark, d):
    return loan_view(spark, d).dropna("any", subset=["credit_amount", "age"]).select("row_id")


_PRD1 = [("orders", "o_orderstatus", ["f", "o", "p"]), ("orders", "o_orderpriority", ["1-urgent", "2-high"]),
         ("labels", "quality", ["0", "1"]), ("customer", "c_mktsegment", ["automobile", "building", "furniture",
                                                                         "household", "machinery"])]


@register("prd1_domain_subset", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS tab, '{c}' AS feature, coalesce(bool_and(lower(CAST({c} AS VARCHAR)) IN ({_sql_list(dom)})), "
    f"true) AS in_domain FROM {t}" for t, c, dom in _PRD1))
def prd1_domain_subset(spark, d):
    rows = [(t, c, SC.domain_subset(table(spark, d, t), [c], dom)[c]) for t, c, dom in _PRD1]
    return spark.createDataFrame(rows, "tab string, feature string, in_domain boolean")


# ------------------------------------------------------------ targets

_TGT1_CASES = [("labels", "eda"), ("labels", "featurize"), ("labels", "inline"), ("embeddings", "eda"),
               ("embeddings", "inline"), ("orders", "featurize")]
_TGT1_COLS = {"labels": ["doc_id", "quality", "toxic"], "embeddings": ["vec_id", "embedding", "label"],
              "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]}


def _tgt1_sql(t: str, rule: str) -> str:
    cols = _TGT1_COLS[t]
    named = [n for n in SC.TARGET_NAMES[rule] if n in cols]
    if named:
        # name rule: resolved from the schema; the scan proves the table is readable
        return f"SELECT '{t}' AS tab, '{rule}' AS rule, '{named[0]}' AS target FROM (SELECT count(*) FROM {t})"
    whens = []
    for c in cols:
        n = f"count(DISTINCT {c})"
        if rule == "eda":
            cond = f"{n} BETWEEN 2 AND 3 AND bool_and(lower(CAST({c} AS VARCHAR)) IN ({_sql_list(SC.EDA_TOKENS)}))"
        elif rule == "featurize":
            cond = f"{n} = 2"
        else:
            cond = f"{n} BETWEEN 2 AND 3 AND bool_and(CAST({c} AS VARCHAR) IN ({_sql_list(SC.INLINE_TOKENS)}))"
        whens.append(f"WHEN {cond} THEN '{c}'")
    return f"SELECT '{t}' AS tab, '{rule}' AS rule, CASE {' '.join(whens)} END AS target FROM {t}"


@register("tgt1_identify_target", "\nUNION ALL\n".join(_tgt1_sql(t, r) for t, r in _TGT1_CASES))
def tgt1_identify_target(spark, d):
    rows = []
    for t, rule in _TGT1_CASES:
        df = table(spark, d, t)
        rows.append((t, rule, SC.identify_target(df, rule, max_levels=2 if rule == "featurize" else 3)))
    return spark.createDataFrame(rows, "tab string, rule string, target string")


_TEXT_SOURCES = [("orders", "o_orderpriority"), ("orders", "o_orderstatus"), ("customer", "c_mktsegment"),
                 ("events", "event_type"), ("part", "p_brand")]


def _rule_sql(rule: str, v: str = "value") -> str:
    s = f"lower(trim({v}))"
    if rule == "contains_strict":
        cond = " OR ".join([f"contains({s}, '{t}')" for t in S.TARGET_TOKENS_CONTAINS_STRICT] +
                           [f"{s} IN ({_sql_list(S.TARGET_EQUALS_STRICT)})"])
    elif rule == "contains_loose":
        cond = " OR ".join(f"contains({s}, '{t}')" for t in S.TARGET_TOKENS_CONTAINS_LOOSE)
    else:
        cond = f"lower({v}) IN ({_sql_list(S.TARGET_TOKENS_EXACT)})"
    return f"CASE WHEN {v} IS NULL THEN NULL WHEN {cond} THEN 1 ELSE 0 END"


def _text_values_sql() -> str:
    return "\nUNION\n".join(f"SELECT '{t}.{c}' AS source, CAST({c} AS VARCHAR) AS value FROM {t}"
                            for t, c in _TEXT_SOURCES)


def _text_values(spark, d):
    out = None
    for t, c in _TEXT_SOURCES:
        part = table(spark, d, t).select(F.lit(f"{t}.{c}").alias("source"), F.col(c).cast("string").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _tgt2(rule):
    sql = f"SELECT source, value, {_rule_sql(rule)} AS label FROM ({_text_values_sql()})"

    def q(spark, d):
        return _text_values(spark, d).withColumn("label", S.target_rule("value", rule))
    return sql, q


for _key, _rule in [("tgt2a_rule_contains_strict", "contains_strict"), ("tgt2b_rule_contains_loose", "contains_loose"),
                    ("tgt2c_rule_exact", "exact")]:
    _s, _q = _tgt2(_rule)
    register(_key, _s)(_q)


@register("tgt2_normalize_numeric_target", "SELECT doc_id, CAST(quality AS INTEGER) AS label FROM labels "
                                           "WHERE quality IS NOT NULL")
def tgt2_normalize_numeric_target(spark, d):
    return SC.normalize_target(table(spark, d, "labels"), "quality", "exact").select("doc_id", "label")


@register("tgt2_normalize_text_target", with_cte(LOAN_VIEW_SQL) + f"""
SELECT row_id, {_rule_sql('contains_strict', 'class')} AS label FROM loan_view""")
def tgt2_normalize_text_target(spark, d):
    return SC.normalize_target(loan_view(spark, d), "class", "contains_strict").select("row_id", "label")


@register("tgt2_target_mapping", with_cte(LOAN_VIEW_SQL) + f"""
SELECT DISTINCT class AS value, {_rule_sql('contains_strict', 'class')} AS label FROM loan_view""")
def tgt2_target_mapping(spark, d):
    lab = SC.normalize_target(loan_view(spark, d), "class", "contains_strict")
    return SC.target_mapping(lab, "class")


# ------------------------------------------------------------ scalar functions

@register("scl1_clip", rsql(_LV + """
SELECT row_id, CASE WHEN credit_amount IS NOT NULL THEN greatest(50000.0, least(credit_amount, 250000.0)) END
       AS credit_amount FROM loan_view""", ["credit_amount"]))
def scl1_clip(spark, d):
    return rounded(loan_view(spark, d).select("row_id", S.clip("credit_amount", 50000.0, 250000.0)
                                              .alias("credit_amount")))


@register("scl2_log1p", rsql("""
SELECT c_custkey, CASE WHEN c_acctbal > -1 THEN ln(1 + c_acctbal) END AS acctbal_log FROM customer""",
    ["acctbal_log"]))
def scl2_log1p(spark, d):
    return rounded(table(spark, d, "customer").select("c_custkey", S.log1p("c_acctbal").alias("acctbal_log")))


@register("scl3_safe_div", rsql(_LV + """
SELECT row_id, CASE WHEN duration <> 0 THEN credit_amount / (duration + 1e-8) END AS per_month,
       CASE WHEN duration = 0 THEN credit_amount / (duration + 1e-8) END AS by_zero FROM loan_view""",
    ["per_month", "by_zero"], overrides={"by_zero": 0}))
def scl3_safe_div(spark, d):
    """Ordinary rows at six digits; a zero duration divides by 1e-8, so those results
    are compared as whole numbers."""
    v = S.safe_div("credit_amount", "duration")
    return rounded(loan_view(spark, d).select("row_id", F.when(F.col("duration") != 0, v).alias("per_month"),
                                              F.when(F.col("duration") == 0, v).alias("by_zero")), overrides={"by_zero": 0})


@register("scl4_zero_to_one", _LV + """
SELECT row_id, CASE WHEN existing_credits = 0 THEN 1.0 ELSE existing_credits END AS existing_credits FROM loan_view""")
def scl4_zero_to_one(spark, d):
    return loan_view(spark, d).select("row_id", S.zero_to("existing_credits", 1.0).alias("existing_credits"))


@register("scl5_cut_right", _LV + """
SELECT row_id, CASE WHEN age >= 0 AND age <= 25 THEN '<25' WHEN age > 25 AND age <= 35 THEN '25-34'
                    WHEN age > 35 AND age <= 50 THEN '35-49' WHEN age > 50 AND age <= 120 THEN '50+' END AS age_bucket
FROM loan_view""")
def scl5_cut_right(spark, d):
    return loan_view(spark, d).select("row_id", S.cut_right("age").alias("age_bucket"))


@register("scl6_flag", _LV + """
SELECT row_id, coalesce(CAST(credit_amount > 200000 AS INTEGER), 0) AS high_flag,
       coalesce(CAST(num_dependents >= 2 AS INTEGER), 0) AS dep_flag FROM loan_view""")
def scl6_flag(spark, d):
    return loan_view(spark, d).select("row_id", S.flag("credit_amount", 200000, ">").alias("high_flag"),
                                      S.flag("num_dependents", 2, ">=").alias("dep_flag"))


@register("scl7_casts", """
SELECT p_partkey, CAST(p_size AS VARCHAR) AS size_text, TRY_CAST(p_brand AS DOUBLE) AS brand_double,
       TRY_CAST(substr(p_brand, 7) AS INTEGER) AS brand_int FROM part""")
def scl7_casts(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.col("p_size").cast("string").alias("size_text"),
                    S.to_double("p_brand").alias("brand_double"),
                    F.substring("p_brand", 7, 100).try_cast("int").alias("brand_int"))


@register("scl8_text", """
SELECT c_custkey, lower(trim(c_mktsegment)) AS seg, contains(lower(c_mktsegment), 'build') AS has_build,
       c_mktsegment = 'MACHINERY' AS is_machinery, c_mktsegment IN ('AUTOMOBILE', 'HOUSEHOLD') AS in_list
FROM customer""")
def scl8_text(spark, d):
    c = F.col("c_mktsegment")
    return table(spark, d, "customer").select(
        "c_custkey", S.norm_text(c).alias("seg"), F.lower(c).contains("build").alias("has_build"),
        (c == "MACHINERY").alias("is_machinery"), c.isin("AUTOMOBILE", "HOUSEHOLD").alias("in_list"))


@register("scl9_abs", rsql("SELECT c_custkey, abs(c_acctbal) AS abs_acctbal FROM customer", ["abs_acctbal"]))
def scl9_abs(spark, d):
    return rounded(table(spark, d, "customer").select("c_custkey", F.abs("c_acctbal").alias("abs_acctbal")))


@register("scl10_name_compose", """
SELECT n_nationkey, 'PC' || CAST(n_regionkey + 1 AS VARCHAR) || '_' || n_name AS pc_name,
       concat_ws('|', n_name, CAST(n_regionkey AS VARCHAR)) AS joined FROM nation""")
def scl10_name_compose(spark, d):
    return table(spark, d, "nation").select(
        "n_nationkey", F.format_string("PC%d_%s", F.col("n_regionkey") + 1, F.col("n_name")).alias("pc_name"),
        F.concat_ws("|", "n_name", F.col("n_regionkey").cast("string")).alias("joined"))


@register("scl11_fillna", _LV + """
SELECT row_id, coalesce(credit_amount, 0.0) AS credit_amount, coalesce(age, -1.0) AS age FROM loan_view""")
def scl11_fillna(spark, d):
    return loan_view(spark, d).select("row_id", "credit_amount", "age").fillna({"credit_amount": 0.0, "age": -1.0})


@register("scl12_posterior", rsql("""
SELECT c_custkey, 1.0 / (1.0 + exp(-(c_acctbal / 1000.0))) AS p FROM customer""", ["p"]))
def scl12_posterior(spark, d):
    return rounded(table(spark, d, "customer").select("c_custkey", S.posterior(F.col("c_acctbal") / 1000.0)
                                                      .alias("p")))


# ------------------------------------------------------------ sets

@register("set1_union_all", with_cte(*_LOAN_PRE) + """
SELECT row_id, label, split FROM splitted WHERE split = 'train'
UNION ALL SELECT row_id, label, split FROM splitted WHERE split = 'test'""")
def set1_union_all(spark, d):
    s = split_loans(spark, d).select("row_id", "label", "split")
    return s.where(F.col("split") == "train").unionByName(s.where(F.col("split") == "test"))


@register("set2_union_missing_columns", rsql("""
SELECT 'c_acctbal' AS feature, avg(c_acctbal) AS mean, NULL::BIGINT AS n_distinct FROM customer
UNION ALL SELECT 'c_mktsegment', NULL, count(DISTINCT c_mktsegment) FROM customer""", ["mean"]))
def set2_union_missing_columns(spark, d):
    c = table(spark, d, "customer")
    a = c.agg(F.avg("c_acctbal").alias("mean")).select(F.lit("c_acctbal").alias("feature"), "mean")
    b = c.agg(F.count_distinct("c_mktsegment").alias("n_distinct")).select(F.lit("c_mktsegment").alias("feature"),
                                                                            "n_distinct")
    return rounded(a.unionByName(b, allowMissingColumns=True))


# ------------------------------------------------------------ joins / alignment

@register("jn1_column_concat", rsql(_LV + """
SELECT row_id, duration, credit_amount, CASE WHEN housing = 'own' THEN 1.0 ELSE 0.0 END AS housing_own,
       CASE WHEN housing = 'rent' THEN 1.0 ELSE 0.0 END AS housing_rent,
       CASE WHEN housing = 'free' THEN 1.0 ELSE 0.0 END AS housing_free FROM loan_view""", ["credit_amount"]))
def jn1_column_concat(spark, d):
    # positional concat of numeric and one-hot parts = one projection (no join, no shuffle)
    lv = loan_view(spark, d)
    oh = FE.apply_onehot(lv, {"housing": ["free", "own", "rent"]})
    return rounded(oh.select("row_id", "duration", "credit_amount", "housing_own", "housing_rent", "housing_free"))


@register("jn2_pair_features_labels", rsql(with_cte(*_LOAN_PRE) + """
SELECT f.row_id, f.credit_amount, y.label FROM loan_view f JOIN splitted y ON f.row_id = y.row_id
WHERE y.split = 'train'""", ["credit_amount"]))
def jn2_pair_features_labels(spark, d):
    x = loan_view(spark, d).select("row_id", "credit_amount")
    y = split_loans(spark, d).where(F.col("split") == "train").select("row_id", "label")
    return rounded(x.join(y, "row_id", "inner"))


@register("jn3_aligned_replace", rsql(with_cte(*_LOAN_PRE, """
tr AS (SELECT row_id, credit_amount * 2 AS credit_amount FROM splitted WHERE split = 'train')""") + """
SELECT s.row_id, tr.credit_amount FROM splitted s LEFT JOIN tr ON s.row_id = tr.row_id""", ["credit_amount"]))
def jn3_aligned_replace(spark, d):
    s = split_loans(spark, d)
    tr = s.where(F.col("split") == "train").select("row_id", (F.col("credit_amount") * 2).alias("credit_amount"))
    return rounded(s.select("row_id").join(tr, "row_id", "left"))


@register("jn4_lookup_map", _LV + "\nSELECT row_id, CASE savings_status " + " ".join(
    f"WHEN '{k}' THEN {v}.0" for k, v in ORDINAL_MAPS["savings_status"].items()) +
    " END AS savings_status_ord FROM loan_view")
def jn4_lookup_map(spark, d):
    return FE.apply_ordinal(loan_view(spark, d).select("row_id", "savings_status"),
                            {"savings_status": ORDINAL_MAPS["savings_status"]}).select("row_id", "savings_status_ord")


@register("jn4_lookup_join", """
SELECT c.c_custkey, coalesce(n.n_name, 'UNKNOWN') AS nation_name
FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 0) n ON c.c_nationkey = n.n_nationkey""")
def jn4_lookup_join(spark, d):
    dim = table(spark, d, "nation").where(F.col("n_regionkey") != 0)
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return FE.lookup_join(c, "c_nationkey", dim, "n_nationkey", "n_name", "nation_name", default="UNKNOWN") \
        .select("c_custkey", "nation_name")
