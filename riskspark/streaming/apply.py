"""Score a stream with fitted parameters (no state, no watermark needed)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def score_stream(spark: SparkSession, source_dir: str, schema: StructType,
                 transform: Callable[[DataFrame], DataFrame], sink_dir: str, checkpoint: str,
                 fmt: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """Read new files from ``source_dir``, apply ``transform`` (for example
    ``FeatureSpec.transform`` or a PCA / LDA projection fitted in batch), and
    append to ``sink_dir``. ``checkpoint`` must be a shared folder (the
    query's offsets and commits live there, so a restarted driver resumes)."""
    stream = spark.readStream.schema(schema).format(fmt).load(source_dir)
    writer = transform(stream).writeStream.format(fmt).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(sink_dir)
