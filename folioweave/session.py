"""Session defaults and stage tables.

Nothing in the operators depends on these settings; they are the values the
tests and the benchmark use.  On a cluster the submitter's session is used as is.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

#: Rows of a list that travel to every task; a longer list meets its rows by exchange.
CARRIED = 1 << 16

_FOLDERS: list[str] = []
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cores: int | str = "*", app: str = "folioweave") -> SparkSession:
    partitions = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def workers_find_package(spark: SparkSession) -> None:
    """Put this package's folder on the Python path of the workers.

    That is enough where all machines see the folder, whatever the current
    directory; elsewhere the submitter ships the package (``--py-files`` or a wheel).
    """
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder for checkpoints and stage tables.

    The cluster names it in ``spark.checkpoint.dir``.  Without that setting a
    folder below /tmp is chosen on a local master only; elsewhere it is an error,
    because executors could not see each other's files.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and context.getCheckpointDir() is None and not re.match(r"local(\[[^,]*\])?$", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return configured or context.getCheckpointDir()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder, removed when the Python process ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    if not _FOLDERS:
        atexit.register(remove_folders, spark)
    _FOLDERS.append(path)
    return path


def remove_folders(spark: SparkSession, *paths: str) -> None:
    """Delete the given stage folders, or all of this process that are left."""
    for path in paths or tuple(_FOLDERS):
        with contextlib.suppress(Py4JError, OSError):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        if path in _FOLDERS:
            _FOLDERS.remove(path)


def stage_table(df: DataFrame) -> DataFrame:
    """Write a stage result that several consumers read, as Parquet.

    Later reads prune columns and push filters; a lost executor re-reads the
    files instead of recomputing the stage.
    """
    path = new_folder(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def carried(rows: DataFrame, limit: int = CARRIED) -> DataFrame:
    """A stage table, marked for broadcast if it has at most ``limit`` rows."""
    staged = stage_table(rows)
    return broadcast(staged) if staged.limit(limit + 1).count() <= limit else staged


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition a small frame whose rows are about to multiply.

    Adaptive execution merges small shuffle outputs into few tasks, which is
    wrong just before an explode or a fan-out join.  A fixed partition count is
    left alone, and later grouping by supersets of ``keys`` needs no exchange.
    """
    spark = df.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(count, *keys)


def widen(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores on an input with fewer splits than cores.

    One small file is one task.  Such an input is hash-partitioned by its key,
    so that heavy row-wise work runs in parallel; an input with enough splits
    is returned as it is and never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
