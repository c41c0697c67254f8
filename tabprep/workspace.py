"""Shared-folder staging.

``pin`` writes a DataFrame once and reads it back, so that everything planned on
top of it starts from a table that outlives executors, and so that later passes
read only the columns they need.
"""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

_pinned: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session, or else its warehouse.

    A warehouse in the file system of the machine draws a warning where executors are other machines.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.conf.get("spark.sql.warehouse.dir")
        if configured.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            warnings.warn(f"set spark.checkpoint.dir: {configured} must be a folder that all executors share", stacklevel=2)
    return configured.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, remembered for ``release``."""
    path = f"{shared_dir(spark)}/tabprep/{name}-{uuid.uuid4().hex}"
    _pinned.append(path)
    return path


def pin(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as parquet to the shared folder and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.pinned_path = path
    return written


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``pin`` wrote, once nothing is read from them any more; other frames are left alone."""
    for frame in frames:
        path = getattr(frame, "pinned_path", None) if "pinned_path" in vars(frame) else None
        if path in _pinned:
            _pinned.remove(path)
            _delete(frame.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))


def release(spark: SparkSession) -> int:
    """Delete the tables pinned by this driver; returns how many were removed."""
    removed = 0
    while _pinned:
        removed += _delete(spark, _pinned.pop())
    return removed
