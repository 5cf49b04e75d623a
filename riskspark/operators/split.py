"""Exact stratified split and folds (WIN3, WIN4) without a global window.

Order inside each label is ``md5(seed|key)`` then ``key`` - shared with the
SQL oracle. Rows are bucketed by the leading bits of the hash (uniform, so
buckets are balanced even when one label holds a third of all rows or more).

The bucket count is fixed (:data:`HASH_BUCKETS`): small enough that the
per-(label, bucket) counts combine map-side (a task emits at most one
partial row per bucket it touches), large enough that the one boundary
bucket ranked per label stays task-sized (1e12 rows per label -> about 15M
rows in that bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.operators.columns import col, join_null_safe
from riskspark.operators.ranking import hash_bucket, md5_hash
from riskspark.session import materialize

HASH_BUCKETS = 1 << 16


def order_hash(key: str, seed: int, tie: Sequence[str] = ()) -> Column:
    """The order key of a row. A NULL key is replaced by ``tie`` columns (or by a
    fixed token, which puts all such rows next to each other), so no row is lost."""
    k = col(key).cast("string")
    rest = F.concat_ws("|", F.lit("null"), *[F.coalesce(col(t).cast("string"), F.lit("")) for t in tie])
    return md5_hash(F.coalesce(k, rest), seed)


def stratified_split(df: DataFrame, label: str, key: str, test_frac: float = 0.2, seed: int = 42,
                     buckets: int = HASH_BUCKETS, out: str = "split", tie: Sequence[str] = ()) -> DataFrame:
    """WIN3: per label, the first ``round(test_frac * n_label)`` rows in
    hash order are ``test``, the rest ``train``. Exact, two scans:

    the first counts rows per (label, hash bucket); windows over that small table
    give each label's total, its test size and its boundary bucket; the second ranks
    the rows of the boundary buckets only. The cut points (one row per label, any
    number of labels, NULL among them) are computed once and joined back.
    """
    order = [key, *tie]
    h = order_hash(key, seed, tie)
    hb = df.select(label, *order, h.alias("_h")).withColumn("_b", hash_bucket(F.col("_h"), buckets))
    counts = hb.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_c"))
    wl = Window.partitionBy(label)
    cum_w = wl.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    k = F.floor(F.lit(float(test_frac)) * F.sum("_c").over(wl) + F.lit(0.5))  # round half up, as the oracle
    cum = counts.select(label, "_b", "_c", F.sum("_c").over(cum_w).alias("_cum"), k.alias("_k"))
    edge = (cum.where((F.col("_k") > 0) & (F.col("_cum") - F.col("_c") < F.col("_k")) & (F.col("_cum") >= F.col("_k")))
            .select(label, "_b", (F.col("_k") - (F.col("_cum") - F.col("_c"))).alias("_kin")))
    # a row per label: stored, so that its size decides how it is joined before any row is shuffled
    edge = materialize(edge)
    wr = Window.partitionBy(label, "_b").orderBy("_h", *order)
    cuts = (join_null_safe(hb, edge, [label, "_b"]).withColumn("_rn", F.row_number().over(wr)).where("_rn = _kin")
            .select(label, F.col("_h").alias("_ch"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(order)]))
    cuts = materialize(cuts)
    j = join_null_safe(df.withColumn("_h", h), cuts, [label], "left")
    before = F.col("_h") < F.col("_ch")
    same = F.col("_h") == F.col("_ch")
    for i, c in enumerate(order):       # NULL sorts first, as in the window
        mine, cut = col(c), F.col(f"_c{i}")
        lower = F.coalesce(mine < cut, mine.isNull() & cut.isNotNull())
        before = before | (same & lower)
        same = same & mine.eqNullSafe(cut)
    is_test = F.coalesce(before | same, F.lit(False))
    return j.withColumn(out, F.when(is_test, F.lit("test")).otherwise(F.lit("train"))).drop(
        "_h", "_ch", *[f"_c{i}" for i in range(len(order))])


def stratified_rank(df: DataFrame, label: str, key: str, seed: int = 42, buckets: int = HASH_BUCKETS,
                    out: str = "rank", tie: Sequence[str] = ()) -> DataFrame:
    """1-based rank of each row inside its label in hash order: bucket offset
    (running sum over the small per-(label, bucket) count table) + row_number
    inside the bucket. No driver round trip; the offsets join is left to
    AQE, which broadcasts it when its measured size is small."""
    hb = df.withColumn("_h", order_hash(key, seed, tie)).withColumn("_b", hash_bucket(F.col("_h"), buckets))
    counts = hb.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_c"))
    wprev = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = counts.select(label, "_b", F.coalesce(F.sum("_c").over(wprev), F.lit(0)).alias("_off"))
    j = join_null_safe(hb, off, [label, "_b"])
    wr = Window.partitionBy(label, "_b").orderBy("_h", key, *tie)
    return j.withColumn(out, (F.col("_off") + F.row_number().over(wr)).cast("long")).drop("_h", "_b", "_off")


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42,
                     buckets: int = HASH_BUCKETS, out: str = "fold", tie: Sequence[str] = ()) -> DataFrame:
    """WIN4: fold = (rank inside label - 1) mod k, so every fold keeps the
    class shares."""
    r = stratified_rank(df, label, key, seed, buckets, "_rank", tie)
    return r.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")
