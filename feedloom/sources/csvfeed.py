"""CSV feeds whose header comes late, comes again and changes.

Input lines are ``source, line_no, line`` with ``line_no`` unique per source. A header
holds for the lines below it up to the next one; so does the unit of its speed column,
which the first fitting row that names one sets when the header does not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import constants as K
from feedloom.functions.measure import (
    compose_tag,
    default_port,
    leading_number,
    to_mega,
    unit_of,
)
from feedloom.functions.text import contains_any, let, starts_with_any, trim
from feedloom.operators.cap import cap_per_source
from feedloom.operators.running import BLOCK_BITS, HotKeys, hot_keys, running


@dataclass(frozen=True)
class CsvOptions:
    """``limit`` 0 switches the speed filter off, ``cap`` 0 the cap."""

    only_tls: bool = True
    limit: float = K.SPEED_LIMIT
    cap: int = K.ROW_CAP

    @staticmethod
    def from_setting(text: str | None, only_tls: bool = True) -> CsvOptions:
        """``"5:8"`` is limit 5 and cap 8; a missing part is the default, an empty one 0."""
        if not text:
            return CsvOptions(only_tls)
        parts = text.split(":")
        limit = float(parts[0].strip() or 0)
        cap = float(parts[1].strip() or 0) if len(parts) > 1 else K.ROW_CAP
        if cap != int(cap):
            raise ValueError(f"the row cap must be a whole number: {text!r}")
        return CsvOptions(only_tls, limit, int(cap))


def is_header(line: Column) -> Column:
    low = F.lower(line)
    address = low.startswith(K.IP_PREFIX) | F.contains(line, F.lit(K.IP_WORD))
    return address & contains_any(low, K.PORT_WORDS)


def cells(line: Column) -> Column:
    """Cells between plain commas; there is no quoting."""
    return F.transform(F.split(line, ","), trim)


def _roles(names: Column, at: Column) -> Column:
    def first(test) -> Column:
        place = F.array_position(F.transform(names, test), True)
        return F.nullif(place, F.lit(0)).cast("int") - 1

    def last(test) -> Column:
        place = F.array_position(F.transform(F.reverse(names), test), True)
        return F.size(names) - F.nullif(place, F.lit(0)).cast("int")

    speed = last(lambda c: contains_any(c, K.SPEED_WORDS))
    return F.struct(
        F.size(names).alias("cells"),
        first(lambda c: c.startswith(K.IP_PREFIX) | F.contains(c, F.lit(K.IP_WORD))).alias("ip"),
        first(lambda c: starts_with_any(c, K.PORT_WORDS)).alias("port"),
        first(lambda c: c == K.TLS_CELL).alias("tls"),
        speed.alias("speed"),
        first(lambda c: contains_any(c, K.CITY_WORDS)).alias("city"),
        first(lambda c: contains_any(c, K.COUNTRY_WORDS)).alias("country"),
        last(lambda c: contains_any(c, K.IDC_WORDS)).alias("idc"),
        unit_of(F.get(names, speed)).alias("unit"),
        at.alias("at"),
    )


def parse_header(line: Column, at: Column) -> Column:
    """Cell count, the index of each role (null when missing), the speed unit and ``at``."""
    return let(cells(F.lower(line)), lambda names: _roles(names, at))


def fill_headers(
    lines: DataFrame, hot: HotKeys | None = None, block_bits: int = BLOCK_BITS
) -> DataFrame:
    """Data lines with ``header``, the parsed header above them (null before the first).

    ``header.at`` is the header's line number and names the segment it opens.
    """
    clean = lines.withColumn("line", trim(F.col("line"))).filter(F.col("line") != "")
    marked = clean.withColumn("_is_header", is_header(F.col("line")))
    parsed = F.when(F.col("_is_header"), parse_header(F.col("line"), F.col("line_no")))
    filled = running(
        marked,
        ["source"],
        "line_no",
        {"header": ("last", parsed)},
        inclusive=True,
        hot=hot,
        block_bits=block_bits,
    )
    return filled.filter(~F.col("_is_header")).drop("_is_header")


def _cell(role: str) -> Column:
    """The cell of a role, cut out of the line without building an array."""
    upto = F.call_function(
        "substring_index", F.col("line"), F.lit(","), F.col("header")[role] + 1
    )
    return trim(F.substring_index(upto, ",", -1))


def fits_header(df: DataFrame) -> DataFrame:
    """Adds ``reason`` where the cells of a line do not fit the header."""
    commas = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(","), F.lit("")))
    return df.withColumn(
        "reason",
        F.when(F.col("header").isNull(), "no header").when(
            commas + 1 != F.col("header")["cells"], "cell count"
        ),
    )


def tls_only(df: DataFrame) -> DataFrame:
    flagged = F.coalesce(F.lower(_cell("tls")) == "true", F.lit(False))
    return df.withColumn(
        "reason", F.coalesce(F.col("reason"), F.when(~flagged, "not tls"))
    )


def with_speed(
    df: DataFrame, hot: HotKeys | None = None, block_bits: int = BLOCK_BITS
) -> DataFrame:
    """Adds ``speed`` in MB (null when the cell holds no number) and ``unit``.

    Only rows without a ``reason`` can set the unit of their segment. The greatest
    (segment, -line) so far is the first such row of the latest segment that has one; it
    needs no other sort than the header fill.
    """
    at = F.col("header")["at"]
    # One column per step: what is used twice is then computed once.
    named = (
        df.withColumn("_cell", F.when(F.col("reason").isNull(), _cell("speed")))
        .withColumn("number", leading_number(F.col("_cell")))
        .withColumn("_named", F.when(F.col("number").isNotNull(), unit_of(F.col("_cell"))))
        .drop("_cell")
    )
    said = F.struct(
        at.alias("at"), (-F.col("line_no")).alias("back"), F.col("_named").alias("unit")
    )
    sticky = running(
        named,
        ["source"],
        "line_no",
        {"_said": ("max", F.when(F.col("_named").isNotNull(), said))},
        inclusive=True,
        hot=hot,
        block_bits=block_bits,
    )
    held = F.when(F.col("_said")["at"] == at, F.col("_said")["unit"])
    unit = F.coalesce(F.col("header")["unit"], held)
    return sticky.withColumns({"unit": unit, "speed": to_mega(F.col("number"), unit)}).drop(
        "_said", "_named", "number"
    )


def fast_enough(df: DataFrame, limit: float) -> DataFrame:
    """Rows below the limit get a reason; rows without a number pass."""
    slow = F.col("reason").isNull() & (F.col("speed") < limit)
    return df.withColumn("reason", F.when(slow, "slow").otherwise(F.col("reason")))


def csv_records(
    lines: DataFrame,
    options: CsvOptions = CsvOptions(),
    *,
    keep_rejects: bool = False,
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Records of CSV lines: ``source, line_no`` and the record columns.

    With ``keep_rejects`` the cap is not applied and refused lines stay, with a reason.
    """
    hot = hot_keys(lines, ["source"], block_bits)
    rows = fits_header(fill_headers(lines, hot, block_bits))
    if options.only_tls:
        rows = tls_only(rows)
    if not keep_rejects:
        rows = rows.filter(F.col("reason").isNull())
    if options.limit > 0:
        rows = fast_enough(with_speed(rows, hot, block_bits), options.limit)
    records = rows.select(
        "source",
        "line_no",
        F.lit(K.PLAIN_SCHEME).alias("scheme"),
        _cell("ip").alias("host"),
        default_port(_cell("port"), _cell("tls")).alias("port"),
        compose_tag(_cell("ip"), _cell("city"), _cell("country"), _cell("idc")).alias("tag"),
        F.lit(None).cast("string").alias("link"),
        "reason",
    )
    if keep_rejects:
        return records
    kept = records.filter(F.col("reason").isNull()).drop("reason")
    return cap_per_source(kept, ["source"], "line_no", options.cap, hot, block_bits)
