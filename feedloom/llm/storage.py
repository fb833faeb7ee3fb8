"""Shared files and tables: written by tasks, read by others, deleted when superseded.

Everything lies below the shared folder of ``feedloom.durable``. Tasks open files through
``pyarrow.fs``, so the folder may be a mounted path or an object store. A task attempt writes
under a name of its own and only what it returns is used, so lost attempts leave nothing that
is read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from feedloom.durable import scratch_path


def materialised(df: DataFrame, name: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """The rows written to a fresh shared table, and its path for ``forget``."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete shared tables or folders that nothing will read again."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def fresh_name(prefix: str, partition: int, suffix: str) -> str:
    """A file name no other attempt of the task uses."""
    return f"{prefix}-{partition:06d}-{uuid.uuid4().hex[:12]}{suffix}"


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
