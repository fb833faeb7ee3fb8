"""Numbers and units in cells and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom import constants as K
from feedloom.functions.text import non_empty


def leading_number(cell: Column) -> Column:
    """The number at the start of a trimmed cell; null when there is none."""
    return F.regexp_extract(cell, K.NUMBER, 0).try_cast("double")


def unit_of(text: Column) -> Column:
    """``KB``, ``MB`` or null; KB is looked for first."""
    low = F.lower(text)
    return F.when(F.contains(low, F.lit("kb")), "KB").when(F.contains(low, F.lit("mb")), "MB")


def to_mega(number: Column, unit: Column) -> Column:
    """KB become MB: divided by 1000, rounded half up to two decimals."""
    return F.when(unit == "KB", F.floor(number / 10 + 0.5) / 100).otherwise(number)


def tag_measure(tag: Column, unit_aware: bool = False) -> Column:
    """The first measured speed in a tag, or null.

    The unit is not looked at unless ``unit_aware``: 900 KB/s then beats 5 MB/s.
    """
    value = non_empty(F.regexp_extract(tag, K.MEASURE, 0)).try_cast("double")
    if not unit_aware:
        return value
    kilo = F.upper(F.regexp_extract(tag, K.KILO_MEASURE, 1)) == "K"
    return F.when(kilo, value / 1000).otherwise(value)


def default_port(port: Column, tls: Column) -> Column:
    """A missing port is the TLS port when the flag says so, else the plain one."""
    flagged = F.coalesce(F.lower(tls) == "true", F.lit(False))
    return F.coalesce(non_empty(port), F.when(flagged, K.TLS_PORT).otherwise(K.PLAIN_PORT))


def compose_tag(address: Column, *parts: Column) -> Column:
    """The non-empty parts joined by a dash, or the address when there are none."""
    joined = F.concat_ws("-", *[non_empty(p) for p in parts])
    return F.coalesce(non_empty(joined), address)
