"""Tree ensembles as tables (MDL3, MDL4): a fitted model's nodes are rows, and scoring is
a join per level.

The table scores rows without the model's code: in SQL, in a stream, or where only the
stored parameters are at hand. A level is one hash join of the rows' places with the
nodes; all levels are one stage, and only the sums per row are shuffled, combined
map-side over the trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.operators.columns import num
from riskspark.operators.ranking import BROADCAST_ROW_LIMIT

BROADCAST_NODES = 20 * BROADCAST_ROW_LIMIT       # seven numbers a node


def saved_nodes(spark: SparkSession, path: str) -> DataFrame:
    """``tree, node, feature, threshold, left, right, weight, value, share`` of an ensemble
    saved by Spark ML: ``value`` is a leaf's prediction, ``share`` its share of class 1
    (classification trees), ``feature`` is -1 in a leaf."""
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "metadata", "weight").select("tree", "weight")
    stats = F.col("nodeData.impurityStats")
    n = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"), F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"), F.col("nodeData.prediction").alias("value"),
        F.try_divide(F.get(stats, F.lit(1)), F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)).alias("share"))
    return n.join(weights, "tree")          # a row per tree


def tree_scores(rows: DataFrame, cols: Sequence[str], nodes: DataFrame, kind: str, key: str) -> DataFrame:
    """(key, score): probability of class 1 by joining rows with ``nodes`` level by level.

    ``key`` is unique. ``kind``: ``gbt`` (sum of weighted leaves, logistic link of twice
    the margin) or ``rf`` (mean share of class 1). A missing feature goes right, as in
    the model, whose vectors hold NaN there."""
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tree").alias("trees")).first()
    depth = _depth(nodes)
    table = F.broadcast(nodes) if size["n"] <= BROADCAST_NODES else nodes
    at = rows.select(F.col(key), F.array(*[num(c) for c in cols]).alias("_x"),
                     F.explode(F.sequence(F.lit(0), F.lit(size["trees"] - 1))).alias("tree")).withColumn("node", F.lit(0))
    for _ in range(depth):
        step = at.join(table.select("tree", "node", "feature", "threshold", "left", "right"), ["tree", "node"])
        goes_left = F.coalesce(F.get("_x", F.col("feature")) <= F.col("threshold"), F.lit(False))
        at = step.select(key, "_x", "tree", F.when(F.col("feature") < 0, F.col("node")).when(goes_left, F.col("left")).otherwise(F.col("right")).alias("node"))
    leaf = at.join(table.select("tree", "node", "weight", "value", "share"), ["tree", "node"])
    if kind == "gbt":
        s = leaf.groupBy(key).agg(F.sum(F.col("weight") * F.col("value")).alias("m"))
        return s.select(key, (1 / (1 + F.exp(-2 * F.col("m")))).alias("score"))
    if kind == "rf":
        return leaf.groupBy(key).agg(F.avg("share").alias("score"))
    raise ValueError(f"unknown model {kind!r}")


def _depth(nodes: DataFrame) -> int:
    """Levels below the roots: the table is walked from its roots, a join per level."""
    reached, depth = nodes.where("node = 0"), 0
    nodes = nodes.persist()
    try:
        while True:
            children = reached.where("feature >= 0").select("tree", F.explode(F.array("left", "right")).alias("node"))
            reached = nodes.join(children, ["tree", "node"])
            if reached.isEmpty():
                return depth
            depth += 1
    finally:
        nodes.unpersist()
