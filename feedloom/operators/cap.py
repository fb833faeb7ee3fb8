"""At most so many rows per source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.running import BLOCK_BITS, HotKeys, running

# Up to this rank the optimizer limits each task before the shuffle
# (spark.sql.optimizer.windowGroupLimitThreshold).
LIMITED_BEFORE_SHUFFLE = 1000


def cap_per_source(
    df: DataFrame,
    by: Sequence[str],
    seq: str,
    cap: int,
    hot: HotKeys | None = None,
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Keep the first ``cap`` rows of each source in ``seq`` order; 0 keeps all of them."""
    if cap == 0:
        return df
    if cap < 0:
        return df.limit(0)
    if cap <= LIMITED_BEFORE_SHUFFLE:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(seq))
        return df.withColumn("_place", place).filter(F.col("_place") <= cap).drop("_place")
    counted = running(df, by, seq, {"_before": ("count", None)}, hot=hot, block_bits=block_bits)
    return counted.filter(F.col("_before") < cap).drop("_before")
