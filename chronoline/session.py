"""Session settings shared by tests, the bench and the driver entry."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "chronoline") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, gets a private folder
    when none is named; elsewhere a missing setting is an error, since executors could not
    see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session zone: recording clocks are zone-less and results depend on it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_FOLDERS: list[str] = []


def settled_folders() -> list[str]:
    """The folders settled so far and not yet released."""
    return list(_FOLDERS)


def release(folders: list[str]) -> None:
    """Remove settled folders early; nothing may read results that still depend on them."""
    spark = SparkSession.getActiveSession()
    for folder in folders:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _FOLDERS.remove(folder)


@contextmanager
def scratch():
    """Remove, at its end, what was settled inside: for results that are written or collected by then."""
    before = set(_FOLDERS)
    try:
        yield
    finally:
        release([f for f in _FOLDERS if f not in before])


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    folder = f"{checkpoint_dir(spark)}/settled-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(where)
    store.deleteOnExit(where)
    _FOLDERS.append(folder)
    return f"{folder}/data"


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Used where several branches need the same result: it is computed once, the plan
    stays short, a lost executor costs no recomputation, and the files carry the sizes
    that later joins choose their strategy by. The files go when the application ends.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
