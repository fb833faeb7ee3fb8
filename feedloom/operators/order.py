"""Explicit row order: tables have none, and every tie and number depends on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.durable import checkpointed

#: Bits of the source number in a packed order, unless more are asked for.
SOURCE_BITS = 21


def packed_seq(
    source_rank: Column, source_ord: Column, line_no: Column, source_bits: int = SOURCE_BITS
) -> Column:
    """Source rank, source number and line number as one bigint, with no shuffle.

    Two bits hold the rank, ``source_bits`` the source and the rest the line (40 bits by
    default); a value that does not fit raises an error instead of breaking the order.
    """
    line_bits = 61 - source_bits
    fits = (
        source_rank.between(0, 3)
        & (source_ord >= 0)
        & (source_ord < F.lit(1 << source_bits))
        & (line_no >= 0)
        & (line_no < F.lit(1 << line_bits))
    )
    packed = F.shiftleft(source_rank.cast("bigint"), 61).bitwiseOR(
        F.shiftleft(source_ord.cast("bigint"), line_bits)
    ).bitwiseOR(line_no.cast("bigint"))
    return F.when(fits, packed).otherwise(
        F.raise_error(F.lit("source or line number does not fit the packed order")).cast("bigint")
    )


def number_rows(df: DataFrame, *order: str, name: str = "seq") -> DataFrame:
    """Number rows along a total order that no bigint expresses, such as include paths.

    One range-partitioned sort; the numbers grow along the order but have gaps. They are
    written once, because they depend on where the sort cuts the table.
    """
    return checkpointed(df.sort(*order).withColumn(name, F.monotonically_increasing_id()))
