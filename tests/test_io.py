"""Sources and sinks round trips."""

import pytest

from riskspark.sources import io


def test_csv_roundtrip_and_params(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, -1.0)], "k int, s string, v double")
    io.write_table(df, str(tmp_path / "t"), fmt="csv")
    back = io.read_table(spark, str(tmp_path / "t"), schema=df.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    io.write_params(spark, {"lo": 1.5, "levels": ["a", "b"]}, str(tmp_path / "p"))
    assert io.read_params(spark, str(tmp_path / "p")) == {"lo": 1.5, "levels": ["a", "b"]}


def test_nan_becomes_null(spark, tmp_path):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    df.write.parquet(str(tmp_path / "n.parquet"))
    back = io.read_table(spark, str(tmp_path / "n.parquet"), normalize_nan=True)
    assert sorted(r[0] for r in back.collect() if r[0] is not None) == [1.0]
    assert back.where("v IS NULL").count() == 1


def test_read_stage_missing_fails(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        io.read_stage(spark, str(tmp_path / "absent"))


def test_label_cleaning(spark, tmp_path):
    p = tmp_path / "labels.csv"
    p.write_text("class\n1\n0\n1.7\n0.0\nabc\n2\n")
    assert [r[0] for r in io.read_labels(spark, str(p)).collect()] == [1, 0, 1, 0]


def test_commit_survives_a_failed_write(spark, tmp_path):
    """A write that fails half way leaves the earlier version in force."""
    from pyspark.sql import functions as F
    at = str(tmp_path / "stage")
    first = spark.range(10).withColumn("v", F.lit(1))
    io.commit_stage(first, at)
    broken = spark.range(0, 1000, 1, 4).withColumn("v", F.when(F.col("id") < 900, 2).otherwise(F.raise_error(F.lit("lost")).cast("int")))
    with pytest.raises(Exception, match="lost"):
        io.commit_stage(broken, at)
    assert sorted(map(tuple, io.read_stage(spark, at).collect())) == [(k, 1) for k in range(10)]
    reader = io.read_stage(spark, at)                 # began before the next switch
    io.commit_stage(spark.range(3).withColumn("v", F.lit(3)), at)
    assert reader.count() == 10 and io.read_stage(spark, at).count() == 3
    io.commit_stage(spark.range(4).withColumn("v", F.lit(4)), at)
    assert io.read_stage(spark, at).count() == 4 and len([p for p in (tmp_path / "stage").iterdir() if p.name.startswith("version-")]) == 2
