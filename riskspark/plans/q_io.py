"""Registered source / sink round trips (SRC1-SRC4, SNK1-SNK4).

Each query writes under a fresh folder inside the cluster's shared
``spark.checkpoint.dir`` and reads the result back; the oracle is the
source table itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskspark.operators import discriminant as DA
from riskspark.operators import outlier as O
from riskspark.plans.fixtures import table
from riskspark.plans.registry import register, rounded, rsql
from riskspark.sources import io
from riskspark.session import checkpoint_dir

_ORD_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/stage/{name}-{uuid.uuid4().hex}"


@register("src1_snk1_csv_roundtrip", "SELECT " + ", ".join(_ORD_COLS) + " FROM orders")
def src1_snk1_csv_roundtrip(spark, d):
    src = table(spark, d, "orders").select(*_ORD_COLS)
    path = scratch(spark, "orders_csv")
    io.write_table(src, path, fmt="csv")
    return io.read_table(spark, path, schema=src.schema)


@register("src1_csv_inferred_schema", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src1_csv_inferred_schema(spark, d):
    src = table(spark, d, "nation")
    path = scratch(spark, "nation_csv")
    io.write_table(src, path, fmt="csv")
    return io.read_table(spark, path)  # inferSchema fallback


@register("src2_parquet_scan", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45""")
def src2_parquet_scan(spark, d):
    # the filter and the 3-column projection reach the parquet scan
    li = io.read_table(spark, f"{d.rstrip('/')}/lineitem.parquet")
    return li.where(F.col("l_quantity") > 45).select("l_orderkey", "l_linenumber", "l_quantity")


@register("src3_read_stage", rsql("""
SELECT c_custkey, c_acctbal / 1000.0 AS acctbal_k FROM customer""", ["acctbal_k"]))
def src3_read_stage(spark, d):
    stage = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 1000.0).alias("acctbal_k"))
    path = scratch(spark, "stage")
    io.write_table(stage, path)
    return rounded(io.read_stage(spark, path))


@register("src4_label_file", """
SELECT quality AS label FROM labels WHERE quality IS NOT NULL AND (doc_id % 7 = 0 OR doc_id % 11 <> 0)""")
def src4_label_file(spark, d):
    lab = table(spark, d, "labels")
    text = (F.when(F.col("doc_id") % 7 == 0, (F.col("quality") + 0.7).cast("string"))
            .when(F.col("doc_id") % 11 == 0, F.lit("n/a")).otherwise(F.col("quality").cast("string")))
    header = spark.createDataFrame([("class",)], "v string")
    raw = header.unionByName(lab.select(text.alias("v")))
    path = scratch(spark, "labels_txt")
    raw.write.mode("overwrite").option("header", False).csv(path)
    return io.read_labels(spark, path)


@register("snk2_params_json", rsql("""
SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events""", ["lo", "hi"]))
def snk2_params_json(spark, d):
    lo, hi = O.winsor_bounds(table(spark, d, "events"), "value", 1.0, 99.0)
    path = scratch(spark, "params")
    io.write_params(spark, {"column": "value", "lower_pct": 1.0, "upper_pct": 99.0, "lo": lo, "hi": hi}, path)
    p = io.read_params(spark, path)
    return rounded(spark.createDataFrame([(p["lo"], p["hi"])], "lo double, hi double"))


@register("snk3_model_roundtrip", rsql("""
WITH g AS (SELECT avg(l_quantity) AS g1, avg(l_discount) AS g2 FROM lineitem),
s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity, l_discount FROM lineitem),
c AS (SELECT y, count(*) AS nc, avg(l_quantity - g1) AS m1, avg(l_discount - g2) AS m2,
             sum((l_quantity - g1) * (l_quantity - g1)) AS s11, sum((l_quantity - g1) * (l_discount - g2)) AS s12,
             sum((l_discount - g2) * (l_discount - g2)) AS s22 FROM s, g GROUP BY y),
sw AS (SELECT sum(s11 - nc * m1 * m1) / (sum(nc) - 2) AS a, sum(s12 - nc * m1 * m2) / (sum(nc) - 2) AS b,
              sum(s22 - nc * m2 * m2) / (sum(nc) - 2) AS d FROM c),
dm AS (SELECT max(m1) FILTER (WHERE y = 1) - max(m1) FILTER (WHERE y = 0) AS d1,
              max(m2) FILTER (WHERE y = 1) - max(m2) FILTER (WHERE y = 0) AS d2 FROM c)
SELECT 'l_quantity' AS feature, (d * d1 - b * d2) / (a * d - b * b) AS coefficient FROM sw, dm
UNION ALL SELECT 'l_discount', (a * d2 - b * d1) / (a * d - b * b) FROM sw, dm""", ["coefficient"], 4))
def snk3_model_roundtrip(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"),
                                            "l_quantity", "l_discount")
    m = DA.fit_lda(li, ["l_quantity", "l_discount"], "label")
    path = scratch(spark, "lda_model")
    io.write_params(spark, m.to_params(), path)
    back = DA.LDAModel.from_params(io.read_params(spark, path))
    return rounded(spark.createDataFrame(list(zip(back.features, back.coef)), "feature string, coefficient double"),
                   4)


@register("snk4_report_table", """
SELECT 'shape' AS section, 1 AS ord, 'rows' AS key, CAST(count(*) AS VARCHAR) AS value FROM orders
UNION ALL SELECT 'shape', 2, 'columns', '6' FROM (SELECT 1)
UNION ALL SELECT 'target', 3, o_orderstatus, CAST(count(*) AS VARCHAR) FROM orders GROUP BY o_orderstatus""")
def snk4_report_table(spark, d):
    o = table(spark, d, "orders")
    shape = o.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("shape").alias("section"), F.lit(1).alias("ord"), F.lit("rows").alias("key"),
        F.col("n").cast("string").alias("value"))
    cols = spark.createDataFrame([("shape", 2, "columns", str(len(o.columns)))],
                                 "section string, ord int, key string, value string")
    target = o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("target").alias("section"), F.lit(3).alias("ord"), F.col("o_orderstatus").alias("key"),
        F.col("n").cast("string").alias("value"))
    report = shape.unionByName(cols).unionByName(target)
    path = scratch(spark, "report")
    io.write_table(report.coalesce(1), path)
    return spark.read.parquet(path)
