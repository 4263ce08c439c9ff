"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_roots: dict[str, str] = {}


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here expects (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_runtime_settings(spark: SparkSession) -> None:
    """Settings the results depend on, for sessions somebody else built."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can see.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local-mode session,
    where driver and executors are one process, may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    already_set = context.getCheckpointDir()
    if already_set:
        return already_set
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="tidemark-")
    return _local_roots[app]


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_root(spark), f"{label}-{uuid.uuid4().hex}")


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder wherever Spark keeps it; a missing one is no error."""
    files, place = _place(spark, path)
    files.delete(place, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and continue from the written table.

    The table outlives the loss of executors, later steps read only the columns they
    need, and Spark knows its true size when it picks join strategies.
    """
    path = work_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows to tasks by a unique key, for CPU-heavy work on tables in few splits.

    The caller decides: it costs a shuffle, which tables in many files or row groups do
    not need.  The number of tasks follows ``spark.sql.shuffle.partitions`` and the size of
    the rows; nothing is computed before the plan runs.
    """
    return df.repartition(F.col(key))
