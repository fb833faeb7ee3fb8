"""Which of several settings holds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.constants import INCLUDE
from feedloom.functions.text import first_non_empty, is_content, split_lines


def _asked(pairs: Mapping[str, tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(request).isNotNull() for request, _ in pairs.values()])


def request_or_stored(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add each setting from ``(request, stored)`` columns, all from the same side.

    One request value that is present, even empty, makes every setting come from the
    request; the stored ones are then ignored.
    """
    any_present = _asked(pairs)
    return df.withColumns(
        {
            name: F.when(any_present, F.col(request)).otherwise(F.col(stored))
            for name, (request, stored) in pairs.items()
        }
    )


def setting_roots(
    df: DataFrame,
    root: str,
    pairs: Mapping[str, tuple[str, str]],
    named_lists: Sequence[str] = (),
) -> DataFrame:
    """Content lines of the settings that hold: ``kind, root, line_no, line``.

    Request values are split at commas, and those in ``named_lists`` name a list each, so
    their first line becomes an include of it; stored values are split at newlines and kept
    as they are. Which side holds is as in ``request_or_stored``.
    """
    kinds = []
    for name, (request, stored) in pairs.items():
        asked = F.nullif(F.col(request), F.lit(""))
        asked = F.concat(F.lit(INCLUDE), asked) if name in named_lists else asked
        pieces = F.when(_asked(pairs), split_lines(asked, ",")).otherwise(split_lines(F.col(stored), "\n"))
        kinds.append(F.struct(F.lit(name).alias("kind"), pieces.alias("lines")))
    listed = df.select(F.col(root).alias("root"), F.explode(F.array(*kinds)).alias("_k"))
    lines = listed.select(F.col("_k.kind").alias("kind"), "root", F.posexplode("_k.lines").alias("line_no", "line"))
    return lines.withColumn("line_no", F.col("line_no").cast("bigint")).filter(is_content(F.col("line")))


def tls_only_flag(stored: Column, request_off: Column) -> Column:
    """Are only TLS rows wanted: the stored flag, true if unset; a request value turns it off."""
    return F.when(request_off.isNotNull(), F.lit(False)).otherwise(F.coalesce(stored, F.lit(True)))


def first_setting(*values: Column, default: str) -> Column:
    """The first value that is not empty, else the default."""
    return F.coalesce(first_non_empty(*values), F.lit(default))
