"""Models and cross-validation (MDL1-MDL7) on Spark ML.

* MDL2 logistic regression: sklearn's ``C`` objective (sum of weighted
  losses + ||w||^2 / (2C)) equals Spark's mean-loss objective with
  ``regParam = 1 / (C * sum(weights))``; features are not standardized
  inside the model (the variants are already scaled).
* MDL3 boosted trees (re-aimed from XGBoost: 100 rounds, depth 6, step 0.3),
  MDL4 random forest (200 trees; many rows: a task per tree, see ``forest.py``).
* MDL5 k-fold CV: the preprocessing of every training set is fitted by the
  same few jobs (:func:`riskspark.operators.features.fold_variants`), both
  kinds of model see all rows of one materialised fold table, a bounded
  number of fits runs at once, each in a scheduler pool of its own, and all
  fold scores are ranked in ONE grouped job (exact AUC / step-wise AP).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.operators.columns import col
from riskspark.operators.evaluate import rank_metrics
from riskspark.operators.features import MAX_FOLDS
from riskspark.operators.forest import fit_forest, grows_by_tree
from riskspark.operators.split import stratified_folds

SEED = 42
# Model settings of the compared estimators.
LOGISTIC_C = 1.0
GBT_ROUNDS, GBT_DEPTH, GBT_STEP = 100, 6, 0.3
# In a CV grid a fit ends before GBT_ROUNDS when a tenth of its training rows, by the hash
# of their key, gains less than this share of its loss by a round.
GBT_HELD_SHARE, GBT_TOLERANCE = 10, 0.01
RF_TREES = 200
# The compared forest grows full trees; Spark's deepest setting is 30. Depth 12 parts the
# rows of these tables nearly fully at a bounded number of nodes per level.
RF_DEPTH = 12
GBT_PARTITION_ROWS = 1_000_000
# A forest level sends the statistics of every node from every partition, whatever its rows: as few
# partitions as fill the cores, and large ones beyond.
RF_PARTITION_ROWS, MIN_PARTITION_ROWS = 2_000_000, 10_000
TREE_MEMORY_MB = 512
SCORE_WAVES = 4
LINEAR_HINT_GAP = 0.03
MAX_CLASSES = 100


def balanced_weights(counts: dict) -> dict:
    """MDL1 as parameters: class -> n / (k * n_c) from the class counts."""
    n, k = sum(counts.values()), len(counts)
    return {c: n / (k * nc) for c, nc in counts.items()}


def _with_weight(df: DataFrame, weights: dict, label: str, out: str = "weight") -> DataFrame:
    m = F.create_map(*[e for c, w in weights.items() for e in (F.lit(c), F.lit(float(w)))])
    return df.withColumn(out, m[F.col(label)])


def _assemble(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep").transform(df)


def fit_model(train: DataFrame, cols: Sequence[str], kind: str, label: str = "label", counts: dict | None = None,
              held: str | None = None, tol: float = 1e-6, cores: int | None = None):
    """Fit one estimator on ``train`` (a DataFrame of numeric ``cols``; a sparse one-hot
    vector counts as one of them). ``counts``: its rows per class, if they are known;
    ``held``: a boolean column of rows on which boosted trees decide when to stop (all
    rounds without it); ``tol``: where the logistic fit ends; ``cores``: how many of them
    trees may fill (all, unless several fits run at once)."""
    t = _assemble(train, cols)
    if kind == "logistic":
        counts = counts or _class_counts(train, label)
        t = _with_weight(t, balanced_weights(counts), label)
        total = sum(counts.values())  # balanced weights sum to the row count
        est = LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight",
                                 regParam=1.0 / (LOGISTIC_C * total), elasticNetParam=0.0, standardization=False,
                                 maxIter=200, tol=tol)
    elif kind == "gbt":
        est = GBTClassifier(featuresCol="features", labelCol=label, maxIter=GBT_ROUNDS, maxDepth=GBT_DEPTH,
                            stepSize=GBT_STEP, seed=SEED, checkpointInterval=-1, maxMemoryInMB=TREE_MEMORY_MB)
        if held:
            est = est.setParams(validationIndicatorCol=held, validationTol=GBT_TOLERANCE)
        return _fit_spread(est, t.select("features", label, *([held] if held else [])), GBT_PARTITION_ROWS, counts, cores)
    elif kind == "rf":
        est = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=RF_TREES, maxDepth=RF_DEPTH, seed=SEED,
                                     maxMemoryInMB=TREE_MEMORY_MB)
        counts = counts or _class_counts(train, label)
        width = t.schema["features"].metadata.get("ml_attr", {}).get("num_attrs")
        if grows_by_tree(est, counts, width):
            return fit_forest(est, t, label, sum(counts.values()), width)
        return _fit_spread(est, t.select("features", label), RF_PARTITION_ROWS, counts, cores)
    else:
        raise ValueError(f"unknown model {kind!r}")
    return est.fit(t)


def _fit_spread(est, t: DataFrame, partition_rows: int, counts: dict | None, cores: int | None):
    """Fit trees on rows dealt over the cores: a tree level is a job over all partitions,
    and the view's own, sized by their bytes, are fewer than the cores."""
    n = sum(counts.values()) if counts else t.count()
    t = t.repartition(tree_partitions(n, partition_rows, cores or t.sparkSession.sparkContext.defaultParallelism)).persist()
    try:
        return est.fit(t)
    finally:
        t.unpersist()


def tree_partitions(n: int, partition_rows: int, cores: int) -> int:
    """All cores where each gets enough rows (tiny tasks cost more than they do), more
    partitions only beyond ``partition_rows`` in each."""
    return max(1, min(cores, -(-n // MIN_PARTITION_ROWS)), -(-n // partition_rows))


def _class_counts(df: DataFrame, label: str) -> dict:
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label}: more than {MAX_CLASSES} values are not classes")
    return {r[label]: int(r["n"]) for r in rows}


def score(model, df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Probability of class 1 as ``score``. A forest's rows are dealt over the cores: each
    walks all its trees, and the view's partitions are few."""
    if isinstance(model, RandomForestClassificationModel):
        df = df.repartition(SCORE_WAVES * df.sparkSession.sparkContext.defaultParallelism)
    out = model.transform(_assemble(df, cols))
    return out.select(*keep, vector_to_array("probability")[1].alias("score"))


def cross_validate(df: DataFrame, cols: Sequence[str], key: str, label: str = "label",
                   models: Sequence[str] = ("logistic", "gbt"), k: int = 5, seed: int = SEED,
                   prepare: Callable[[DataFrame], dict[tuple[str, int], Callable[[DataFrame], DataFrame]]] | None = None,
                   threads: int = 8, folds: DataFrame | None = None) -> DataFrame:
    """MDL5: fold scores (variant, model, fold, n_pos, n_neg, roc_auc, ap).

    ``prepare(folds)`` fits the preprocessing of every cell at once and returns, per
    (variant, fold), a projection fitted on the other folds; the default is one
    identity variant ``raw``. ``folds`` (``df`` with a ``fold`` column) may be passed
    to reuse one assignment across several CV runs. At most ``threads`` fits run at
    once, whatever the grid; the result has a row per cell and model."""
    sc = df.sparkSession.sparkContext
    table = (stratified_folds(df, label, key, k, seed) if folds is None else folds).persist()

    def fitted(task) -> DataFrame:
        (variant, i), project, m = task
        sc.setLocalProperty("spark.scheduler.pool", f"cv-{variant}-{i}-{m}")
        try:
            train, test = project(table.where(F.col("fold") != i)), project(table.where(F.col("fold") == i))
            held = None
            if m == "gbt":
                held = "_held"
                train = train.withColumn(held, F.pmod(F.xxhash64(col(key).cast("string")), F.lit(GBT_HELD_SHARE)) == 0)
            model = fit_model(train, cols, m, label, counts[i], held, cores=share)
            return score(model, test, cols, keep=[label]).select(
                F.lit(variant).alias("variant"), F.lit(m).alias("model"), F.lit(i).alias("fold"), label, "score")
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)

    try:
        counts = _counts_without(table, label)
        cells = prepare(table) if prepare else {("raw", i): (lambda d: d) for i in range(k)}
        # the long fits first
        tasks = [(c, project, m) for m in sorted(models) for c, project in cells.items()]
        share = -(-sc.defaultParallelism // max(1, min(threads, len(cells))))   # fits at once share the cores
        with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
            parts = list(pool.map(fitted, tasks))
        scored = reduce(lambda a, b: a.unionByName(b), parts)
        metrics = rank_metrics(scored, "score", label, by=["variant", "model", "fold"])
        # a row per cell and model: computed before the fold table is released
        return df.sparkSession.createDataFrame(metrics.collect(), metrics.schema)
    finally:
        table.unpersist()


def _counts_without(folds: DataFrame, label: str) -> dict[int, dict]:
    """Fold -> rows per class of all other folds: totals less the fold's own."""
    own: dict = {}
    for r in folds.groupBy("fold", label).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES * MAX_FOLDS + 1).collect():
        own.setdefault(r["fold"], {})[r[label]] = int(r["n"])
    total: dict = {}
    for per in own.values():
        for c, n in per.items():
            total[c] = total.get(c, 0) + n
    if len(total) > MAX_CLASSES:
        raise ValueError(f"{label}: more than {MAX_CLASSES} values are not classes")
    return {i: {c: n - per.get(c, 0) for c, n in total.items() if n > per.get(c, 0)} for i, per in own.items()}


def linear_hint(summary: DataFrame, linear: str = "logistic", tree: str = "gbt",
                gap: float = LINEAR_HINT_GAP) -> DataFrame:
    """MDL7: per variant, 'linear' when tree AUC - linear AUC < gap."""
    p = summary.groupBy("variant").agg(
        F.max(F.when(F.col("model") == linear, F.col("roc_auc_mean"))).alias("linear_auc"),
        F.max(F.when(F.col("model") == tree, F.col("roc_auc_mean"))).alias("tree_auc"))
    return p.withColumn("gap", F.col("tree_auc") - F.col("linear_auc")).withColumn(
        "hint", F.when(F.col("gap") < gap, F.lit("linear")).otherwise(F.lit("nonlinear")))
