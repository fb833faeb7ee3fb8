"""Text: trimming, literal replacement, first of the non-empty values."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.constants import COMMENT, SPACE, SPACE_CLASS


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    Filters on a plain computed column are pushed below it and compute it again, and a
    chain of parsing steps multiplies that. Rows of a generator stay where they are.
    """
    named = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(named)))


def groups(text: Column, pattern: str, count: int) -> Column:
    """All groups of a pattern that covers the whole text, with one match per row.

    The groups come as an array, null for those left out; the result is null when the
    pattern does not match. No group may hold a line feed, and the text may not start with one.
    """
    marks = "".join(f"\n${i}" for i in range(1, count + 1))

    def pieces(marked: Column) -> Column:
        found = F.transform(F.slice(F.split(marked, "\n"), 2, count), non_empty)
        return F.when(marked.startswith("\n") & ~text.startswith("\n"), found)

    return let(F.regexp_replace(text, pattern, marks), pieces)


def trim(text: Column) -> Column:
    """Strip the whole Unicode white-space set; the built-in default strips blanks only."""
    return F.btrim(text, F.lit(SPACE))


def non_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_non_empty(*texts: Column) -> Column:
    return F.coalesce(*[non_empty(t) for t in texts])


def replace_token(text: Column, token: Column | str, by: Column | str) -> Column:
    """Replace every literal occurrence; the token is never read as a pattern."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.replace(text, as_col(token), as_col(by))


def split_lines(text: Column, separator: str = "\n") -> Column:
    """Pieces between runs of the separator, each trimmed; blanks and comments stay in."""
    return F.transform(F.split(trim(text), f"[{separator}]+"), trim)


def is_content(line: Column) -> Column:
    return (line != "") & ~line.startswith(COMMENT)


def words(text: Column, extra: str = ",") -> Column:
    """Non-blank pieces between white space or ``extra`` characters."""
    pieces = F.split(text, f"[{extra}{SPACE_CLASS}]+")
    return F.filter(pieces, lambda p: p != "")


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def starts_with_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.startswith(p) for p in prefixes])
