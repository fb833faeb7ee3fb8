"""The lines of one feed's sources, named in settings and found among what has landed.

``roots`` holds the content lines of the setting, ``lists`` those of the landed lists (see
``feedloom.sources.includes``). Results have ``source_ord, line_no, line``, in the order in
which a reader of the setting would have met the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators.order import number_rows
from feedloom.operators.running import running
from feedloom.sources.includes import expand_includes, expand_one_level
from feedloom.sources.lines import scan_payloads

# Row numbers of a sort: the partition, then 33 bits for the row inside it.
ROW_BITS = 33


def text_lines(roots: DataFrame, lists: DataFrame) -> DataFrame:
    """Endpoint lines of a setting and of all lists it includes."""
    numbered = number_rows(expand_includes(lists, roots, ordered=True), "path")
    return numbered.select(
        F.shiftright("seq", ROW_BITS).alias("source_ord"),
        F.col("seq").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("line_no"),
        "line",
    )


def csv_lines(roots: DataFrame, lists: DataFrame, landed: DataFrame) -> DataFrame:
    """Lines of the CSV files that a setting names, directly or one list away.

    ``landed`` is ``source, line_no, line``. A file named twice is read twice.
    """
    named = _in_order(expand_one_level(lists, roots))
    return landed.join(named, "source").select("source_ord", "line_no", "line")


def link_lines(
    roots: DataFrame,
    lists: DataFrame,
    bodies: DataFrame,
    replacements: tuple[tuple[str, str], ...] = (),
) -> DataFrame:
    """Link lines of the providers that a setting and its lists name.

    ``bodies`` is ``source, body``; a body may be base64, and tokens in it are replaced.
    """
    named = _in_order(expand_includes(lists, roots, ordered=True))
    found = bodies.join(named, "source").select("source_ord", "body")
    return scan_payloads(found, "body", replacements)


def _in_order(lines: DataFrame) -> DataFrame:
    """``source, source_ord``: the named sources, numbered from 0 without gaps."""
    numbered = number_rows(lines.select("root", F.col("line").alias("source"), "path"), "path")
    counted = running(numbered, ["root"], "seq", {"source_ord": ("count", None)})
    return counted.select("source", "source_ord")
