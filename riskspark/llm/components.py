"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label``: the smallest node of its component, for every node of an edge.

    Each round hooks every node to the smallest of itself and its neighbours and
    contracts the edges by those hooks; a node that is no local minimum disappears,
    so at least half of the nodes with edges do, and the number of rounds grows with
    the logarithm of a component's size. Hooks of all rounds are then composed from
    the last to the first. Every round is a table in the shared folder. A node with
    very many edges is pre-aggregated map-side (a minimum) and joined by key, which
    the skew handling of joins can split."""
    e = stored(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "edges")
    hooks: list[DataFrame] = []
    while not e.isEmpty():
        both = e.select(F.col("a").alias("node"), F.col("b").alias("other")).union(e.select("b", "a"))
        hook = stored(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("to")), "hooks")
        hooks.append(hook)
        up, low = hook.select(F.col("node").alias("a"), F.col("to").alias("ta")), hook.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        e = stored(e.join(up, "a").join(low, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
                   .where("a < b").distinct(), "edges")
    labels = None
    for hook in reversed(hooks):
        if labels is None:
            labels = hook.select("node", F.col("to").alias("label"))
        else:
            later = labels.select(F.col("node").alias("to"), "label")
            labels = hook.join(later, "to", "left").select("node", F.coalesce("label", "to").alias("label"))
        labels = stored(labels, "labels")
    if labels is None:
        labels = e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
