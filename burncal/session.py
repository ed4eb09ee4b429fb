"""Session defaults for local use, and the one setting workers need to import this package."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session with UTC, ANSI and adaptive execution. Clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("burncal")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return ensure_importable(builder.getOrCreate())


def ensure_importable(spark: SparkSession) -> SparkSession:
    """Put the folder that holds this package on the Python path of the workers, where it is not there already."""
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's (spark.checkpoint.dir). A temporary folder of this machine, which is removed at the
    end, serves only where driver and executors are one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="burncal-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows from a Parquet table in the shared folder, each call in a folder of its own."""
    return table_of(df, name)[0]


def table_of(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows from a Parquet table in the shared folder, and where it lies, for `discard`."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that no later step reads, on whatever file system it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """Write a result to the checkpoint folder and go on from there: later stages do not run it again, and a lost
    executor costs a read."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
