"""Identifier lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom import constants as K
from feedloom.functions.text import words


def split_ids(text: Column) -> Column:
    return words(text)


def is_uuid(text: Column) -> Column:
    return text.rlike(K.UUID)


def valid_ids(text: Column) -> Column:
    """The ids of a list and whether all are well formed; one bad id fails the list."""
    ids = split_ids(F.coalesce(text, F.lit("")))
    return F.struct(ids.alias("ids"), F.forall(ids, is_uuid).alias("valid"))


def uuid_text(raw: Column) -> Column:
    """Sixteen bytes as lower-case UUID text."""
    return F.regexp_replace(
        F.lower(F.hex(raw)), r"^(.{8})(.{4})(.{4})(.{4})(.{12}).*", "$1-$2-$3-$4-$5"
    )


def first_listed(text: Column, ids: Column) -> Column:
    """First id of an array, in array order, that is a substring of the text."""
    return F.get(F.filter(ids, lambda i: (i != "") & F.contains(text, i)), F.lit(0))
