"""Picking one entry of a pool."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.constants import COMMENT
from feedloom.functions.text import words


def pool_entries(text: Column, skip_comments: bool = True) -> Column:
    entries = words(text)
    return F.filter(entries, lambda e: ~e.startswith(COMMENT)) if skip_comments else entries


def pick(entries: Column, key: Column) -> Column:
    """A uniform pick that depends on the key only, so reruns agree; empty gives null."""
    draw = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.when(F.size(entries) > 0, F.get(entries, (draw % F.size(entries)).cast("int")))
