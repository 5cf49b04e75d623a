"""Sources and sinks (SRC1-SRC4, SNK1-SNK4).

Reads are lazy and keep Catalyst's column pruning / predicate pushdown:
nothing here touches data until an action runs downstream.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark keeps NaN apart from NULL (NaN sorts above every number and
    poisons ``avg``); the pandas semantics we match treat both as missing."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            exprs.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs)


def read_table(spark: SparkSession, path: str, schema: StructType | None = None,
               normalize_nan: bool = False) -> DataFrame:
    """SRC1 + SRC2: parquet when the path ends in ``.parquet`` (file or
    folder), header CSV otherwise; explicit schema if given, else inferred.

    NaN is left in the data, whatever the format, so that filters reach the scan: the
    operators treat NaN as missing. ``normalize_nan`` maps it to NULL on reading."""
    p = path.rstrip("/")
    is_parquet = p.endswith(".parquet")
    if is_parquet:
        df = spark.read.schema(schema).parquet(p) if schema is not None else spark.read.parquet(p)
    else:
        rd = spark.read.option("header", True)
        rd = rd.schema(schema) if schema is not None else rd.option("inferSchema", True)
        df = rd.csv(p)
    return nan_to_null(df) if normalize_nan else df


def read_stage(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """SRC3: read an earlier stage's output, failing clearly if it is absent. A stage
    written by :func:`commit_stage` is read in its committed version."""
    version = committed_version(spark, path)
    if version is not None:
        path = f"{path.rstrip('/')}/{version}"
    try:
        if fmt == "csv":
            return spark.read.option("header", True).option("inferSchema", True).csv(path)
        return spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"stage output missing: {path}; run the producing stage first") from e
        raise


def clean_labels(df: DataFrame, col: str, out: str = "label") -> DataFrame:
    """SRC4 semantics as a projection: keep rows whose text parses as a
    number that truncates to 0 or 1 (``1.7`` -> 1); header text and junk drop."""
    v = F.expr(f"try_cast(`{col}` AS DOUBLE)")
    t = F.when(v.isNotNull() & ~F.isnan(v), F.expr(f"try_cast(try_cast(`{col}` AS DOUBLE) AS INT)"))
    return df.withColumn(out, t).where(F.col(out).isin(0, 1))


def read_labels(spark: SparkSession, path: str, out: str = "label") -> DataFrame:
    """SRC4: headerless one-column label file -> cleaned 0/1 labels."""
    raw = spark.read.option("header", False).csv(path).toDF("_raw")
    return clean_labels(raw, "_raw", out).select(out)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """SNK1: table sink; parquet by default, CSV with header on request."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


MANIFEST = "_commit-"


def _files(spark: SparkSession, path: str):
    """Hadoop's file system that holds ``path``, and its package of types."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    return fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), fs


def _commits(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, version) of the finished commits in ``path``, oldest first."""
    files, fs = _files(spark, path)
    if not files.exists(fs.Path(path)):
        return []
    names = [s.getPath().getName() for s in files.listStatus(fs.Path(path))]
    found = [n.removeprefix(MANIFEST).split("-", 1) for n in names if n.startswith(MANIFEST)]
    return sorted((int(number), version) for number, version in found)


def committed_version(spark: SparkSession, path: str) -> str | None:
    """The folder inside ``path`` that the last finished :func:`commit_stage` wrote."""
    done = _commits(spark, path.rstrip("/"))
    return done[-1][1] if done else None


def commit_stage(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    """SNK1 with a commit: the rows go beside the earlier version, and only then the
    stage's manifest is switched, by creating one empty file whose name holds the
    commit's number and its version. A job that fails half way leaves the earlier
    version in force; a reader never sees parts of two versions. The version before
    stays for readers that began before the switch; older ones and those of failed
    jobs are removed (one writer at a time)."""
    spark, root = df.sparkSession, path.rstrip("/")
    version = f"version-{uuid.uuid4().hex}"
    write_table(df, f"{root}/{version}", fmt, "errorifexists", partition_by)
    files, fs = _files(spark, root)
    done = _commits(spark, root)
    number = done[-1][0] + 1 if done else 0
    if not files.createNewFile(fs.Path(f"{root}/{MANIFEST}{number:012d}-{version}")):
        raise RuntimeError(f"commit {number} of {root} exists already: another writer is at work")
    stay = {version, *(v for _, v in done[-1:])}
    for status in files.listStatus(fs.Path(root)):
        name = status.getPath().getName()
        if (name.startswith("version-") or name.startswith(MANIFEST)) and not any(name.endswith(v) for v in stay):
            files.delete(status.getPath(), True)
    return version


def write_params(spark: SparkSession, params: dict, path: str) -> None:
    """SNK2/SNK3: a fitted parameter set as a one-row JSON table (round-trips
    through :func:`read_params`)."""
    spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "params string") \
        .coalesce(1).write.mode("overwrite").text(path)


def read_params(spark: SparkSession, path: str) -> dict:
    row = spark.read.text(path).first()
    return json.loads(row[0])


def write_report(spark: SparkSession, rows: list[tuple], path: str) -> DataFrame:
    """SNK4 re-aimed: the text digest becomes a table (section, ord, key, value)."""
    df = spark.createDataFrame([(str(s), int(o), str(k), str(v)) for s, o, k, v in rows],
                               "section string, ord int, key string, value string")
    df.coalesce(1).write.mode("overwrite").parquet(path)
    return df
