"""Durable cuts of a plan: tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only on a local master."""
    sc = spark.sparkContext
    named = spark.conf.get(SETTING, None) or sc.getConf().get(SETTING)
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        named = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="feedloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table, below the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the rows to a table in the shared folder and read them from there on.

    The plan starts anew at the table, whose size the optimizer knows, and nothing is
    computed twice when an executor is lost.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
