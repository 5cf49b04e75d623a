"""Helpers shared by the training-data operators: table access, shared-folder
tables, Arrow mapping and bounded samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.session import ship as ship_package

ARROW_BYTES = 8 << 20      # bytes of an Arrow batch, so that a worker's memory does not follow the texts' lengths
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Before Python runs on the executors: they get this package, and the session's
    Arrow batches are bounded by bytes (lowered only, never raised)."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if not now.isdigit() or int(now) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local master may run without the setting (tests); a cluster without
    it is an error, because a machine-local folder would lose files."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    d = tempfile.mkdtemp(prefix="riskspark-shared-")
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder (never reused, so reruns cannot collide)."""
    return f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later jobs
    survive lost executors without recomputing, and lineage is cut. The shuffle files
    of the write go with its end, not with the driver's next garbage collection."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that no later job reads."""
    for t in tables:
        spark = t.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at).getParent()     # made for this table alone
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict | None], schema: str) -> DataFrame:
    """Map Arrow batches: ``fn`` gets a batch and yields dicts of column lists."""
    ship(df.sparkSession)
    out = to_arrow(schema)

    def run(batches):
        for b in batches:
            for cols in as_iter(fn(b)):
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_col: str, mask: Callable) -> DataFrame:
    """The rows of ``df``, all columns unchanged, for which ``mask(texts)`` holds;
    decided batch by batch where the rows lie, without a shuffle."""
    ship(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(mask(b.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def as_iter(x):
    if x is None:
        return ()
    return (x,) if isinstance(x, dict) else x


def to_arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(T.StructType.fromDDL(schema))


def fold(key: Column, parts: int) -> Column:
    """``crc32(key as text) mod parts``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads: extra columns, whatever their
    names, are ignored and cannot clash with results."""
    return df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"))


def bounded_sample(labelled: DataFrame, key: str, bound: int) -> DataFrame:
    """The ``bound`` rows with the smallest hash of ``key`` (ties by key): a
    deterministic sample, all rows of a table that has no more.

    Rows are counted by the length of their hash in bits (64 numbers). Lengths double
    the range of hashes, so the shortest ones that hold ``bound`` rows hold some two
    times as many, whatever the table's size and partitions; only these are sorted."""
    least = F.xxhash64(F.col(key).cast("string"))
    length = F.length(F.bin(least.bitwiseXOR(F.lit(-(1 << 63)))))      # of the hash, moved to start at 0
    counts = dict(labelled.groupBy(length.alias("length")).agg(F.count("*").alias("n")).collect())
    within = accumulate(counts.get(k, 0) for k in range(1, 65))
    cut = next((k for k, n in enumerate(within, 1) if n >= bound), 64)
    return labelled.where(length <= cut).orderBy(least, F.col(key)).limit(bound)
