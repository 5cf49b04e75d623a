"""Session construction and cluster-shared scratch locations."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "riskspark") -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster, ``master`` and sizing come from spark-submit; locally we
    default to ``local[*]`` with a shuffle width that matches the cores.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    elif not os.environ.get("SPARK_MASTER") and "spark.master" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        builder = builder.master("local[*]")
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # independent fits of a grid share the cores, each in a pool of its own
        "spark.scheduler.mode": "FAIR",
        # checkpoint files of DataFrames that are garbage collected are removed
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": os.environ.get("RISKSPARK_DRIVER_MEMORY", "16g"),
    }
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from
    ``spark.checkpoint.dir``. Only a local master (tests) may run without the
    setting, in a scratch folder; on a cluster its absence is an error, because
    files in a machine-local folder would be missed by others."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="riskspark-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers
    can import it wherever the driver was started from."""
    sc = spark.sparkContext
    if getattr(sc, "_riskspark_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(here)
    target = os.path.join(tempfile.mkdtemp(prefix="riskspark-"), "riskspark_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, top))
    sc.addPyFile(target)  # the driver serves the file; executors fetch it
    sc._riskspark_shipped = True


def materialize(df, how: str = "persist"):
    """Compute ``df`` once before several jobs read it.

    ``persist`` keeps blocks on executors (MEMORY_AND_DISK; a lost executor's
    blocks are recomputed from lineage). ``checkpoint`` writes to the shared
    ``spark.checkpoint.dir`` and cuts lineage, for long multi-stage chains.
    """
    from pyspark import StorageLevel
    if how == "checkpoint":
        checkpoint_dir(df.sparkSession)
        # a reliable checkpoint writes in a second job; without the cache that
        # job would recompute the whole plan
        cached = df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return cached.checkpoint(eager=True)
        finally:
            cached.unpersist()
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out
