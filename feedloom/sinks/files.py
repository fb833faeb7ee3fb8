"""Text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(
    df: DataFrame, path: str, seq: str, line: str, by: Sequence[str] = (), mode: str = "error"
) -> None:
    """Write the lines in order: the files of a folder, in name order, are the payload.

    The sort is range-partitioned over ``by`` and ``seq``, so a hot group spans many files.
    """
    ordered = df.sort(*by, seq).select(*by, F.col(line).alias("value"))
    writer = ordered.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).text(path)
