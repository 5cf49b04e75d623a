"""Bindings from the driver tables to the risk-table shape.

``loan_view`` is one row per order with credit-style columns (see
FIXTURES.md F3); the same definition exists as SQL for the DuckDB oracle.
Every column is derived from the tables by Spark, so the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions.scalar import target_rule
from riskspark.operators.features import NUMERIC
from riskspark.operators.ranking import md5_hash
from riskspark.sources.io import read_table

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Ordinal dictionaries for the loan view (one level of each is
# deliberately left out so that "unknown -> missing" is exercised).
SAVINGS_ORDINAL = {"5-LOW": 0, "4-NOT SPECIFIED": 1, "3-MEDIUM": 2, "2-HIGH": 3}
EMPLOYMENT_ORDINAL = {"AUTOMOBILE": 0, "BUILDING": 1, "FURNITURE": 2, "HOUSEHOLD": 3}
ORDINAL_MAPS = {"savings_status": SAVINGS_ORDINAL, "employment": EMPLOYMENT_ORDINAL}
ONEHOT_COLS = ["purpose", "housing"]
NUMERIC_COLS = list(NUMERIC)
SPLIT_SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def loan_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    li = table(spark, sf_dir, "lineitem")
    # pre-aggregate lineitem before the join: one row per order crosses the shuffle
    lines = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("line_count"))
    geo = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")
    j = (o.join(c, o.o_custkey == c.c_custkey)
         .join(lines, o.o_orderkey == lines.l_orderkey, "left")
         .join(geo, c.c_nationkey == geo.n_nationkey, "left"))
    rid = F.col("o_orderkey")
    return j.select(
        rid.alias("row_id"),
        (6 * F.coalesce(F.col("line_count"), F.lit(0))).cast("double").alias("duration"),
        F.when(rid % 97 != 0, F.col("o_totalprice")).cast("double").alias("credit_amount"),
        (1 + rid % 4).cast("double").alias("installment_commitment"),
        (1 + F.col("c_nationkey") % 4).cast("double").alias("residence_since"),
        F.when(rid % 89 != 0, 18 + (F.col("c_custkey") * 7) % 110).cast("double").alias("age"),
        (F.col("o_custkey") % 5).cast("double").alias("existing_credits"),
        (1 + F.col("o_custkey") % 2).cast("double").alias("num_dependents"),
        F.col("o_orderpriority").alias("savings_status"),
        F.col("c_mktsegment").alias("employment"),
        F.col("r_name").alias("purpose"),
        F.when(F.col("c_acctbal") < 0, "rent").when(F.col("c_acctbal") < 5000, "own")
         .otherwise("free").alias("housing"),
        F.when(F.col("o_orderstatus") == "F", "bad").otherwise("good").alias("class"),
    )


LOAN_VIEW_SQL = """
loan_view AS (
  SELECT o.o_orderkey AS row_id,
         CAST(6 * coalesce(lc.line_count, 0) AS DOUBLE) AS duration,
         CAST(CASE WHEN o.o_orderkey % 97 <> 0 THEN o.o_totalprice END AS DOUBLE) AS credit_amount,
         CAST(1 + o.o_orderkey % 4 AS DOUBLE) AS installment_commitment,
         CAST(1 + c.c_nationkey % 4 AS DOUBLE) AS residence_since,
         CAST(CASE WHEN o.o_orderkey % 89 <> 0 THEN 18 + (c.c_custkey * 7) % 110 END AS DOUBLE) AS age,
         CAST(o.o_custkey % 5 AS DOUBLE) AS existing_credits,
         CAST(1 + o.o_custkey % 2 AS DOUBLE) AS num_dependents,
         o.o_orderpriority AS savings_status,
         c.c_mktsegment AS employment,
         g.r_name AS purpose,
         CASE WHEN c.c_acctbal < 0 THEN 'rent' WHEN c.c_acctbal < 5000 THEN 'own' ELSE 'free' END AS housing,
         CASE WHEN o.o_orderstatus = 'F' THEN 'bad' ELSE 'good' END AS class
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS line_count FROM lineitem GROUP BY l_orderkey) lc
         ON o.o_orderkey = lc.l_orderkey
  LEFT JOIN (SELECT n.n_nationkey, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey) g
         ON c.c_nationkey = g.n_nationkey
)"""


def split_sql(src: str = "loan_view", key: str = "row_id", label: str = "label",
              test_frac: float = 0.2, seed: int = SPLIT_SEED) -> str:
    """SQL twin of :func:`riskspark.operators.split.stratified_split`."""
    return f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {label}
                               ORDER BY md5('{seed}|' || CAST({key} AS VARCHAR)), {key}) AS _rk,
         count(*) OVER (PARTITION BY {label}) AS _n
  FROM {src}
),
splitted AS (
  SELECT * EXCLUDE (_rk, _n),
         CASE WHEN _rk <= round({test_frac} * _n) THEN 'test' ELSE 'train' END AS split
  FROM ranked
)"""


LABELED_SQL = """
labeled AS (
  SELECT *, CASE WHEN lower(trim(class)) LIKE '%bad%' OR lower(trim(class)) LIKE '%yes%'
                   OR lower(trim(class)) LIKE '%1%' OR lower(trim(class)) LIKE '%default%'
                   OR lower(trim(class)) LIKE '%t%' THEN 1 ELSE 0 END AS label
  FROM loan_view
)"""


def labeled_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lv = loan_view(spark, sf_dir)
    return lv.withColumn("label", target_rule(F.col("class"), "contains_loose"))


def split_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labeled loans with the exact stratified ``split`` column. Lazy: a consumer's
    scans read the columns it needs; the split itself keeps one cut point per label."""
    from riskspark.operators.split import stratified_split
    return stratified_split(labeled_loans(spark, sf_dir), "label", "row_id", 0.2, SPLIT_SEED)


def loans_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labeled loans for queries that run several jobs over the view."""
    return labeled_loans(spark, sf_dir)


def with_cte(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)


__all__ = ["loan_view", "labeled_loans", "split_loans", "LOAN_VIEW_SQL", "LABELED_SQL", "split_sql",
           "with_cte", "md5_hash", "table"]


# Binary target for evaluation and models: documents with their quality label.
def labeled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), "toxic")
    return docs.join(lab, "doc_id")


LABELED_DOCS_SQL = """
labeled_docs AS (
  SELECT d.doc_id, d.n_chars, d.lang, d.source, l.quality AS label, l.toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""
