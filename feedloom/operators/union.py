"""Sources put one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom import constants as K
from feedloom.operators.order import SOURCE_BITS, packed_seq
from feedloom.sources.records import RECORD


def union_sources(
    text: DataFrame | None = None,
    csv: DataFrame | None = None,
    links: DataFrame | None = None,
    source_bits: int | None = None,
) -> DataFrame:
    """All records in the fixed order text, CSV, links, as a bag with an explicit ``seq``.

    Each table has ``source_ord``, ``line_no`` and the record columns. A source that is
    left out is not part of the plan. Unless told, the order gives the source number as many
    bits as the largest one needs.
    """
    ranked = [(K.TEXT_RANK, text), (K.CSV_RANK, csv), (K.LINK_RANK, links)]
    parts = [
        df.select(F.lit(rank).alias("source_rank"), "source_ord", "line_no", *RECORD)
        for rank, df in ranked
        if df is not None
    ]
    if not parts:
        raise ValueError("name at least one source")
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    if source_bits is None:
        largest = union.agg(F.max("source_ord").alias("n")).first()["n"] or 0
        source_bits = max(SOURCE_BITS, int(largest).bit_length())
    seq = packed_seq(F.col("source_rank"), F.col("source_ord"), F.col("line_no"), source_bits)
    return union.select(seq.alias("seq"), "source_rank", *RECORD)
