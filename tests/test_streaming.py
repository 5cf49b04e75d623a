"""Fitted projections run unchanged on a stream."""

from riskspark.operators import features as FE
from riskspark.streaming import score_stream


def test_scaler_on_stream_matches_batch(spark, tmp_path):
    df = spark.createDataFrame([(float(i), "a" if i % 2 else "b") for i in range(40)], "x double, c string")
    src = str(tmp_path / "src")
    df.write.parquet(src)
    params = FE.fit_scaler(df, ["x"])
    levels = FE.fit_onehot(df, ["c"])

    def transform(d):
        return FE.apply_onehot(FE.apply_scaler(d, params), levels).select("x", *FE.onehot_names(levels))

    q = score_stream(spark, src, df.schema, transform, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted(tuple(r) for r in transform(df).collect())
    assert got == want and len(got) == 40
