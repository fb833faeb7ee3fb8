"""Stateless parsing of files as they land.

Splitting and endpoint parsing look at one row at a time, so the batch functions serve
streams unchanged. Ranking needs the whole table and stays a batch step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.sources.lines import scan_lines
from feedloom.sources.records import endpoint_records


def landing_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of endpoint records, refused lines included, one row per landed line."""
    bodies = spark.readStream.text(folder, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"), F.col("value").alias("body")
    )
    return endpoint_records(scan_lines(bodies, "body"))


def append_to(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append what has landed so far to a Parquet table, exactly once, and stop."""
    return (
        stream.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
