"""Line lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.payload import plain_body
from feedloom.functions.text import is_content, replace_token, split_lines


def scan_lines(
    df: DataFrame, body: str, separator: str = "\n", keep: Sequence[str] | None = None
) -> DataFrame:
    """One row per content line of each body: trimmed, without blanks and comments.

    ``line_no`` is the place among the pieces between separator runs. The step is narrow,
    so it also runs on a streaming table.
    """
    kept = [c for c in df.columns if c != body] if keep is None else list(keep)
    pieces = F.posexplode(split_lines(F.col(body), separator)).alias("line_no", "line")
    return (
        df.select(*kept, pieces)
        .withColumn("line_no", F.col("line_no").cast("bigint"))
        .filter(is_content(F.col("line")))
    )


def scan_payloads(
    df: DataFrame, body: str, replacements: Sequence[tuple[str, str]] = ()
) -> DataFrame:
    """Lines of bodies that may be base64; tokens are replaced literally after decoding.

    Lines are split at each newline and kept as they are, but for empty ones.
    """
    text = plain_body(F.col(body))
    for token, by in replacements:
        text = replace_token(text, token, by)
    kept = [c for c in df.columns if c != body]
    return (
        df.select(*kept, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
        .withColumn("line_no", F.col("line_no").cast("bigint"))
        .filter(F.col("line") != "")
    )


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Raw lines of text files as ``source, line_no, line``; big files are read in splits.

    ``line_no`` is the start of the split in bytes plus the place inside the split. A line
    takes at least one byte, so the numbers are unique and grow along the file, and no task
    ever sees more of a file than one split. Lines end at each newline only; a carriage
    return before it is taken off.
    """
    raw = spark.read.text(list(paths), lineSep="\n").select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        F.regexp_replace("value", r"\r\z", "").alias("line"),
    )
    first = raw.groupBy(F.col("source").alias("_of"), F.col("_start").alias("_at")).agg(F.min("_id").alias("_first"))
    numbered = raw.join(first, (F.col("source") == F.col("_of")) & (F.col("_start") == F.col("_at")))
    return numbered.select("source", (F.col("_start") + F.col("_id") - F.col("_first")).alias("line_no"), "line")


def read_bodies(spark: SparkSession, *paths: str) -> DataFrame:
    """Whole small files as ``source, body``, for payloads that must be decoded as one."""
    return spark.read.text(list(paths), wholetext=True).select(
        F.col("_metadata.file_path").alias("source"), F.col("value").alias("body")
    )
