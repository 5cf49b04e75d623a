"""Registered PCA and LDA queries (PCA1-PCA9, WIN1-WIN2, LDA1-LDA4).

SQL oracles use two features, where the eigen-decomposition and the 2 x 2
inverse have closed forms; general d (and the vector path) is checked by
pytest against numpy and registered here without an oracle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from riskspark.operators import discriminant as DA
from riskspark.operators import evaluate as EV
from riskspark.operators import reduce as R
from riskspark.plans.fixtures import LABELED_SQL, LOAN_VIEW_SQL, loan_view, split_loans, split_sql, table, with_cte
from riskspark.plans.registry import register, rounded, rsql
from riskspark.session import materialize

# ------------------------------------------------------------------ PCA, d = 2

_LI_SRC = """x AS (SELECT l_orderkey, l_linenumber, l_quantity AS fa, l_extendedprice / 1000.0 AS fb
      FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL)"""
_LI_NAMES = ("qty", "price_k")
_LOAN_SRC = """x AS (SELECT row_id, duration AS fa, age AS fb FROM loan_view
      WHERE duration IS NOT NULL AND age IS NOT NULL)"""
_LOAN_NAMES = ("duration", "age")


def _eig_sql(names) -> str:
    """CTEs over ``x(fa, fb)``: ``st`` moments, ``vec`` eigenpairs (pc, lam,
    va, vb) sorted by eigenvalue with sign-fixed unit vectors, ``ld`` long
    loadings."""
    a, b = names
    return f"""
st AS (SELECT count(*) AS n, avg(fa) AS ma, avg(fb) AS mb, var_samp(fa) AS saa,
              covar_samp(fa, fb) AS sab, var_samp(fb) AS sbb FROM x),
ev AS (SELECT *, (saa + sbb) / 2 + sqrt(((saa - sbb) / 2) ^ 2 + sab ^ 2) AS l1,
              (saa + sbb) / 2 - sqrt(((saa - sbb) / 2) ^ 2 + sab ^ 2) AS l2 FROM st),
dir AS (SELECT 1 AS pc, l1 AS lam, sab AS va, l1 - saa AS vb FROM ev
        UNION ALL SELECT 2, l2, sab, l2 - saa FROM ev),
nv AS (SELECT pc, lam, va / sqrt(va * va + vb * vb) AS va, vb / sqrt(va * va + vb * vb) AS vb FROM dir),
vec AS (SELECT pc, lam, va * s AS va, vb * s AS vb FROM
        (SELECT *, CASE WHEN abs(va) >= abs(vb) THEN sign(va) ELSE sign(vb) END AS s FROM nv)),
ld AS (SELECT 'PC' || pc AS component, '{a}' AS feature, va AS loading FROM vec
       UNION ALL SELECT 'PC' || pc, '{b}', vb FROM vec)"""


def _li_frame(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("qty"),
                     (F.col("l_extendedprice") / 1000.0).alias("price_k"))


def _li_model(spark, d):
    return R.fit_pca(_li_frame(spark, d), list(_LI_NAMES))


_VAR_SQL = rsql(with_cte(_LI_SRC, _eig_sql(_LI_NAMES)) + """
SELECT pc, lam AS explained_variance, lam / (SELECT sum(lam) FROM vec) AS ratio,
       sum(lam) OVER (ORDER BY pc ROWS UNBOUNDED PRECEDING) / (SELECT sum(lam) FROM vec) AS cumulative FROM vec""",
    ["explained_variance", "ratio", "cumulative"])


@register("pca1_pca2_explained_variance", _VAR_SQL)
def pca1_pca2_explained_variance(spark, d):
    return rounded(R.variance_table(_li_model(spark, d), spark))


_K_CASES = [("min2", 0.95), ("min2", 0.5), ("cap_d", 0.90), ("cap_d", 0.5), ("cap_d", 1.01)]


@register("pca3_select_k", with_cte(_LI_SRC, _eig_sql(_LI_NAMES), """
r AS (SELECT max(lam) / sum(lam) AS r1 FROM vec)""") + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{rule}' AS rule, CAST({t} AS DOUBLE) AS threshold, " +
    (f"greatest(2, CASE WHEN r1 >= {t} THEN 1 ELSE 2 END)" if rule == "min2" else
     f"CASE WHEN r1 >= {t} THEN 1 ELSE 2 END") + " AS k FROM r" for rule, t in _K_CASES))
def pca3_select_k(spark, d):
    m = _li_model(spark, d)
    rows = [(rule, float(t), R.choose_k(m.ratio, t, rule, max_k=20 if rule == "min2" else None))
            for rule, t in _K_CASES]
    return spark.createDataFrame(rows, "rule string, threshold double, k int")


@register("pca4_scores", rsql(with_cte(_LI_SRC, _eig_sql(_LI_NAMES), """
v1 AS (SELECT va AS a1, vb AS b1 FROM vec WHERE pc = 1), v2 AS (SELECT va AS a2, vb AS b2 FROM vec WHERE pc = 2)""") + """
SELECT l_orderkey, l_linenumber, a1 * (fa - ma) + b1 * (fb - mb) AS PC1, a2 * (fa - ma) + b2 * (fb - mb) AS PC2
FROM x, st, v1, v2""", ["PC1", "PC2"]))
def pca4_scores(spark, d):
    m = _li_model(spark, d)
    return rounded(R.transform(_li_frame(spark, d).dropna(), m, 2, keep=["l_orderkey", "l_linenumber"]))


@register("pca5_loadings", rsql(with_cte(_LI_SRC, _eig_sql(_LI_NAMES)) + "\nSELECT component, feature, loading FROM ld",
                                ["loading"]))
def pca5_loadings(spark, d):
    return rounded(R.loadings(_li_model(spark, d), spark))


def _interpret_sql(src, names) -> str:
    rules = " ".join(f"WHEN {' OR '.join(f'contains(joined, {chr(39)}{t}{chr(39)})' for t in toks)} THEN '{label}'"
                     for toks, label in R.NAMING_RULES)
    return with_cte(*src, _eig_sql(names), """
rk AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY abs(loading) DESC, feature) AS rank FROM ld),
top AS (SELECT * FROM rk WHERE rank <= 5),
sg AS (SELECT *, row_number() OVER (PARTITION BY component, loading > 0 ORDER BY rank) AS srank FROM top),
agg AS (SELECT component, string_agg(feature, ' ' ORDER BY rank) AS joined,
               string_agg(feature, ', ' ORDER BY rank) AS top_features,
               coalesce(string_agg(feature, ', ' ORDER BY rank) FILTER (WHERE loading > 0 AND srank <= 3), '')
                 AS positive,
               coalesce(string_agg(feature, ', ' ORDER BY rank) FILTER (WHERE loading < 0 AND srank <= 3), '')
                 AS negative
        FROM sg GROUP BY component)""") + f"""
SELECT component, CASE {rules} ELSE '{R.FALLBACK_PREFIX}' || substr(component, 3) END AS name,
       top_features, positive, negative FROM agg"""


@register("pca6_interpret", _interpret_sql((_LI_SRC,), _LI_NAMES))
def pca6_interpret(spark, d):
    return R.interpret(R.loadings(_li_model(spark, d), spark), 5)


@register("pca6_interpret_loans", _interpret_sql((LOAN_VIEW_SQL, _LOAN_SRC), _LOAN_NAMES))
def pca6_interpret_loans(spark, d):
    lv = loan_view(spark, d).select("duration", "age")
    return R.interpret(R.loadings(R.fit_pca(lv, list(_LOAN_NAMES)), spark), 5)


@register("pca8_scree", rsql(with_cte(_LI_SRC, _eig_sql(_LI_NAMES), """
t AS (SELECT pc, lam / (SELECT sum(lam) FROM vec) AS ratio FROM vec),
c AS (SELECT pc, ratio, sum(ratio) OVER (ORDER BY pc ROWS UNBOUNDED PRECEDING) AS cumulative FROM t)""") + """
SELECT pc, ratio, cumulative, cumulative >= 0.95 AS reaches_95, cumulative >= 0.90 AS reaches_90 FROM c
WHERE pc <= 20""", ["ratio", "cumulative"]))
def pca8_scree(spark, d):
    t = R.variance_table(_li_model(spark, d), spark, limit=20)
    return rounded(t.select("pc", "ratio", "cumulative", (F.col("cumulative") >= 0.95).alias("reaches_95"),
                            (F.col("cumulative") >= 0.90).alias("reaches_90")))


@register("pca9_standardize_if_needed", rsql(with_cte(_LI_SRC, """
s AS (SELECT avg(fa) AS ma, stddev_pop(fa) AS sa, avg(fb) AS mb, stddev_pop(fb) AS sb FROM x),
ok AS (SELECT abs(ma) < 0.01 AND sa > 0.9 AND sa < 1.1 AND abs(mb) < 0.01 AND sb > 0.9 AND sb < 1.1 AS std FROM s)""") +
    """
SELECT l_orderkey, l_linenumber, CASE WHEN std THEN fa ELSE (fa - ma) / sa END AS qty,
       CASE WHEN std THEN fb ELSE (fb - mb) / sb END AS price_k FROM x, s, ok""", ["qty", "price_k"]))
def pca9_standardize_if_needed(spark, d):
    out, _ = R.standardize_if_needed(_li_frame(spark, d).dropna(), list(_LI_NAMES))
    return rounded(out.select("l_orderkey", "l_linenumber", *_LI_NAMES))


# ------------------------------------------------------------ PCA, general d (no SQL twin)

@register("pca1_loan_features_variance")
def pca1_loan_features_variance(spark, d):
    from riskspark.plans.q_features import _train, loan_spec
    s = materialize(split_loans(spark, d))      # joined once for the fit and the features
    spec = loan_spec().fit(_train(s))
    num = [c for c in spec.params["feature_list"] if c in spec.params["scaler"]]
    feats = materialize(spec.transform(_train(s), keep=["row_id"]))
    try:
        return rounded(R.variance_table(R.fit_pca(feats, num), spark))
    finally:
        feats.unpersist()


@register("pca1_embeddings_variance")
def pca1_embeddings_variance(spark, d):
    emb = table(spark, d, "embeddings")
    return rounded(R.variance_table(R.fit_pca(emb, vector="embedding"), spark))


@register("pca7_projection_2d")
def pca7_projection_2d(spark, d):
    from riskspark.plans.fixtures import NUMERIC_COLS
    from riskspark.plans.q_features import variant_frames
    # the fits of the variants and of their components read the joined view
    s = materialize(split_loans(spark, d).select("row_id", "split", *NUMERIC_COLS))
    v = variant_frames(s, NUMERIC_COLS)
    parts = []
    for name in ("baseline", "winsorize_1_99", "log1p"):
        part = v.where(F.col("variant") == name)
        m = R.fit_pca(part, NUMERIC_COLS)
        parts.append(R.transform(part, m, 2, keep=["variant", "row_id", "split"]))
    return rounded(reduce(lambda a, b: a.unionByName(b), parts))


# ------------------------------------------------------------ PCA, 2 of 128 components

_WIDTH, _SQUARINGS = 128, 9
# Shares of a document's words per bucket of their md5: 128 columns. The oracle squares
# the covariance matrix nine times, which leaves its leading eigenvector (512th power),
# takes that part away and squares the rest.
_WORDS_SRC = f"""w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
                       lambda x: x <> '')) AS word FROM documents)""", f"""
cnt AS (SELECT doc_id, CAST('0x' || substr(md5(word), 1, 2) AS INTEGER) % {_WIDTH} AS i, count(*) AS c FROM w GROUP BY ALL)""", """
tot AS (SELECT doc_id, sum(c) AS t FROM cnt GROUP BY doc_id)""", f"""
x AS MATERIALIZED (SELECT tot.doc_id, r.i, coalesce(c, 0) / CAST(t AS DOUBLE) AS v
      FROM tot CROSS JOIN (SELECT unnest(range({_WIDTH})) AS i) r LEFT JOIN cnt ON cnt.doc_id = tot.doc_id AND cnt.i = r.i)""", """
mu AS MATERIALIZED (SELECT i, avg(v) AS m FROM x GROUP BY i)""", """
xc AS MATERIALIZED (SELECT doc_id, x.i, v - m AS v FROM x JOIN mu ON x.i = mu.i)""", """
c0 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v) / ((SELECT count(*) FROM tot) - 1) AS v
      FROM xc a JOIN xc b ON a.doc_id = b.doc_id GROUP BY a.i, b.i)"""


def _leading_sql(pc: int, c: str) -> tuple[str, ...]:
    """CTEs ``v{pc}`` (unit vector, sign-fixed) and ``l{pc}`` (eigenvalue) of matrix ``c``."""
    steps = [f"p{pc}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {c} WHERE i = j) AS v FROM {c})"]
    for s in range(_SQUARINGS):
        steps.append(f"q{pc}_{s} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM p{pc}_{s} a JOIN p{pc}_{s} b ON a.j = b.i "
                     f"GROUP BY a.i, b.j)")
        steps.append(f"p{pc}_{s + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM q{pc}_{s} WHERE i = j) AS v FROM q{pc}_{s})")
    p = f"p{pc}_{_SQUARINGS}"
    steps.append(f"""v{pc} AS MATERIALIZED (SELECT i, v / sqrt((SELECT max(v) FROM {p} WHERE i = j)) AS v FROM {p}
      WHERE j = (SELECT i FROM {p} WHERE i = j ORDER BY v DESC LIMIT 1))""")
    steps.append(f"l{pc} AS MATERIALIZED (SELECT sum(a.v * c.v * b.v) AS lam FROM v{pc} a JOIN {c} c ON a.i = c.i JOIN v{pc} b ON b.i = c.j)")
    return tuple(steps)


_TOP2_SRC = (*_WORDS_SRC, *_leading_sql(1, "c0"), """
c1 AS MATERIALIZED (SELECT c0.i, c0.j, c0.v - l1.lam * a.v * b.v AS v FROM c0 JOIN v1 a ON a.i = c0.i JOIN v1 b ON b.i = c0.j, l1)""",
    *_leading_sql(2, "c1"))


def _word_shares(spark, d):
    """doc_id, shares: the share of the document's words in each bucket."""
    docs = table(spark, d, "documents")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = docs.select("doc_id", F.explode(words).alias("w")).select("doc_id", (F.conv(F.substring(F.md5("w"), 1, 2), 16, 10).cast("int") % _WIDTH).alias("b"))
    g = n.groupBy("doc_id").pivot("b", list(range(_WIDTH))).count().select(
        F.col("doc_id").alias("doc_id"), F.array(*[F.coalesce(F.col(str(i)), F.lit(0)) for i in range(_WIDTH)]).alias("c"))
    total = F.aggregate("c", F.lit(0).cast("long"), lambda t, x: t + x)
    return g.select("doc_id", "c", total.alias("t")).select("doc_id", F.transform("c", lambda x: x / F.col("t")).alias("shares"))


@register("pca1_truncated_loadings", rsql(with_cte(*_TOP2_SRC) + """
SELECT 1 AS pc, 'shares_' || i AS feature, lam AS explained_variance, lam / (SELECT sum(v) FROM c0 WHERE i = j) AS ratio, v AS loading, 0.0 AS residual
FROM v1, l1
UNION ALL SELECT 2, 'shares_' || i, lam, lam / (SELECT sum(v) FROM c0 WHERE i = j), v, 0.0 FROM v2, l2""",
    ["explained_variance", "ratio", "loading"], 5))
def pca1_truncated_loadings(spark, d):
    """Two of 128 components by implicit products: variances, shares of the total,
    loadings and the residual of the eigenvalue equation."""
    x = materialize(_word_shares(spark, d))
    try:
        m = R.fit_pca_truncated(x, 2, vector="shares")
        res = R.eigen_residuals(x, m, vector="shares")
    finally:
        x.unpersist()
    rows = [(i + 1, f, float(m.explained_variance[i]), float(m.ratio[i]), float(v), res[i])
            for i in range(len(m.components)) for f, v in zip(m.features, m.components[i])]
    return rounded(spark.createDataFrame(rows, "pc int, feature string, explained_variance double, ratio double, loading double, residual double"), 5)


@register("pca7_truncated_projection", rsql(with_cte(*_TOP2_SRC) + """
SELECT xc.doc_id, sum(xc.v * v1.v) AS PC1, sum(xc.v * v2.v) AS PC2 FROM xc JOIN v1 ON xc.i = v1.i JOIN v2 ON xc.i = v2.i GROUP BY xc.doc_id""",
    ["PC1", "PC2"], 5))
def pca7_truncated_projection(spark, d):
    """Every document with words on the two leading components of its word shares."""
    x = materialize(_word_shares(spark, d))
    return rounded(R.project_arrays(x, R.fit_pca_truncated(x, 2, vector="shares"), ["doc_id"], vector="shares"), 5)


# ------------------------------------------------------------------ LDA, d = 2

_LDA_PRE = (LOAN_VIEW_SQL, LABELED_SQL, split_sql("labeled"), """
src AS (SELECT row_id, split, label, credit_amount / 1000.0 AS amount_k, duration FROM splitted
        WHERE credit_amount IS NOT NULL AND duration IS NOT NULL)""", """
tr AS (SELECT * FROM src WHERE split = 'train')""", """
g AS (SELECT avg(amount_k) AS g1, avg(duration) AS g2 FROM tr)""", """
c AS (SELECT label, count(*) AS nc, avg(amount_k - g1) AS m1, avg(duration - g2) AS m2,
             sum((amount_k - g1) * (amount_k - g1)) AS s11, sum((amount_k - g1) * (duration - g2)) AS s12,
             sum((duration - g2) * (duration - g2)) AS s22 FROM tr, g GROUP BY label)""", """
sw AS (SELECT sum(s11 - nc * m1 * m1) / (sum(nc) - 2) AS a, sum(s12 - nc * m1 * m2) / (sum(nc) - 2) AS b,
              sum(s22 - nc * m2 * m2) / (sum(nc) - 2) AS d FROM c)""", """
dm AS (SELECT max(m1) FILTER (WHERE label = 1) - max(m1) FILTER (WHERE label = 0) AS d1,
              max(m2) FILTER (WHERE label = 1) - max(m2) FILTER (WHERE label = 0) AS d2,
              max(m1) FILTER (WHERE label = 1) + max(m1) FILTER (WHERE label = 0) + 2 * max(g1) AS t1,
              max(m2) FILTER (WHERE label = 1) + max(m2) FILTER (WHERE label = 0) + 2 * max(g2) AS t2,
              max(nc) FILTER (WHERE label = 1) AS n1, max(nc) FILTER (WHERE label = 0) AS n0 FROM c, g)""", """
w AS (SELECT (d * d1 - b * d2) / (a * d - b * b) AS w1, (a * d2 - b * d1) / (a * d - b * b) AS w2, t1, t2, n1, n0
      FROM sw, dm)""", """
m AS (SELECT w1, w2, -(t1 * w1 + t2 * w2) / 2 + ln(CAST(n1 AS DOUBLE) / n0) AS b0 FROM w)""", """
pr AS (SELECT row_id, split, label, w1 * amount_k + w2 * duration + b0 AS score FROM src, m)""")
_LDA_COLS = ["amount_k", "duration"]


def _lda_frame(spark, d):
    s = split_loans(spark, d)
    return s.select("row_id", "split", "label", (F.col("credit_amount") / 1000.0).alias("amount_k"), "duration") \
        .dropna(subset=_LDA_COLS)


def _lda_model(spark, d):
    f = _lda_frame(spark, d)
    return f, DA.fit_lda(f.where(F.col("split") == "train"), _LDA_COLS, "label")


@register("lda1_fit_summary", rsql(with_cte(*_LDA_PRE) + """
SELECT 1.0 AS explained_ratio, '0,1' AS classes, 2 AS n_features, b0 AS intercept FROM m""", ["intercept"], 4))
def lda1_fit_summary(spark, d):
    _, m = _lda_model(spark, d)
    return rounded(DA.summary(m, spark), 4)


@register("lda2_coefficients", rsql(with_cte(*_LDA_PRE) + """
SELECT 'amount_k' AS feature, w1 AS coefficient, abs(w1) AS abs_coefficient FROM m
UNION ALL SELECT 'duration', w2, abs(w2) FROM m""", ["coefficient", "abs_coefficient"]))
def lda2_coefficients(spark, d):
    _, m = _lda_model(spark, d)
    return rounded(DA.coefficients(m, spark))


@register("lda3_predict", rsql(with_cte(*_LDA_PRE) + """
SELECT row_id, split, score, CAST(score > 0 AS INTEGER) AS pred, 1.0 / (1.0 + exp(-score)) AS prob FROM pr""",
    ["score", "prob"], 4))
def lda3_predict(spark, d):
    f, m = _lda_model(spark, d)
    return rounded(DA.predict(f, m, keep=["row_id", "split"]), 4)


@register("lda4_evl_metrics", rsql(with_cte(*_LDA_PRE, """
p AS (SELECT *, CAST(score > 0 AS INTEGER) AS pred FROM pr)""", """
t AS (SELECT split, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp,
             count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
             count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn,
             count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn FROM p GROUP BY split)""", """
cm AS (SELECT split, CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS accuracy,
              coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
              coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall FROM t)""", """
gs AS (SELECT split, score AS s, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS np_,
              sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS nn FROM p GROUP BY split, score)""", """
cs AS (SELECT *, sum(np_) OVER (PARTITION BY split ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cp,
              sum(nn) OVER (PARTITION BY split ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cn FROM gs)""", """
rm AS (SELECT split, sum(nn * (cp - np_ + np_ / 2.0)) / (sum(np_) * sum(nn)) AS roc_auc,
              sum(np_ * cp / (cp + cn)) / sum(np_) AS ap FROM cs GROUP BY split)""") + """
SELECT cm.split, accuracy, precision, recall,
       coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, roc_auc, ap
FROM cm JOIN rm ON cm.split = rm.split""", ["accuracy", "precision", "recall", "f1", "roc_auc", "ap"], 4))
def lda4_evl_metrics(spark, d):
    f, m = _lda_model(spark, d)
    p = DA.predict(f, m, keep=["split", "label"])
    cls = EV.classification_metrics(p, "label", "pred", by=["split"])
    rk = EV.rank_metrics(p, "score", "label", by=["split"]).select("split", "roc_auc", "ap")
    return rounded(cls.join(rk, "split"), 4)


# ------------------------------------------------------------ end-to-end (no SQL twin)

@register("pipeline_featurize_pca_lda")
def pipeline_featurize_pca_lda(spark, d):
    """Entry B: featurize -> PCA at 95 % (k in [2, 20]) -> LDA on the scores
    -> per-split metrics; everything keyed by row_id, no positional pairing."""
    from riskspark.plans.q_features import _train, loan_spec
    s = materialize(split_loans(spark, d))      # joined once for the fit and the features
    spec = loan_spec().fit(_train(s))
    num = [c for c in spec.params["feature_list"] if c in spec.params["scaler"]]
    feats = materialize(spec.transform(s, keep=["row_id", "split", "label"]))
    pca = R.fit_pca(feats.where(F.col("split") == "train"), num)
    k = R.choose_k(pca.ratio, 0.95, "min2", max_k=20)
    pcs = [f"PC{i + 1}" for i in range(k)]
    scores = R.transform(feats, pca, k, keep=["row_id", "split", "label"])
    lda = DA.fit_lda(scores.where(F.col("split") == "train"), pcs, "label")
    p = DA.predict(scores, lda, keep=["split", "label"])
    cls = EV.classification_metrics(p, "label", "pred", by=["split"])
    rk = EV.rank_metrics(p, "score", "label", by=["split"]).select("split", "roc_auc", "ap")
    return rounded(cls.join(rk, "split").withColumn("k", F.lit(k)), 4)


# ------------------------------------------------------------ WIN1, WIN2 on their own

@register("win1_cumulative_variance", rsql(with_cte(_LI_SRC, _eig_sql(_LI_NAMES)) + """
SELECT pc, sum(lam) OVER (ORDER BY pc ROWS UNBOUNDED PRECEDING) / (SELECT sum(lam) FROM vec) AS cumulative
FROM vec""", ["cumulative"]))
def win1_cumulative_variance(spark, d):
    return rounded(R.variance_table(_li_model(spark, d), spark).select("pc", "cumulative"))


@register("win2_top_features", rsql(with_cte(_LI_SRC, _eig_sql(_LI_NAMES)) + """
SELECT component, feature, loading, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY component ORDER BY abs(loading) DESC, feature) AS rank FROM ld)
WHERE rank <= 1""", ["loading"]))
def win2_top_features(spark, d):
    return rounded(R.top_features(R.loadings(_li_model(spark, d), spark), 1))
