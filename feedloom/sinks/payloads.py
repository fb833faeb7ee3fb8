"""Lines joined to payloads, plain or base64, in parts of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.payload import encode_base64
from feedloom.operators.running import BLOCK_BITS, running

#: Bytes of lines that make a part.
PART_BYTES = 1 << 26


def payload_parts(
    df: DataFrame,
    by: Sequence[str],
    seq: str,
    line: str,
    part_bytes: int = PART_BYTES,
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Lines of each group joined by newlines in ``seq`` order: ``by..., part, text``.

    A group comes in as many parts as its bytes ask for (one, for most): the lines that begin
    in the same ``part_bytes`` of the payload. The texts joined by newlines in ``part`` order
    are the whole, so no task and no value holds more than a part and its last line. Part
    numbers grow; after a line longer than a part they leave gaps.
    """
    size = F.octet_length(line).cast("bigint") + 1
    placed = running(df, by, seq, {"_before": ("sum", size)}, block_bits=block_bits)
    part = F.expr(f"_before div {part_bytes}")
    joined = F.expr(f"listagg(`{line}`, '\n') WITHIN GROUP (ORDER BY `{seq}`)")
    return placed.groupBy(*by, part.alias("part")).agg(joined.alias("text"))


def base64_parts(parts: DataFrame, by: Sequence[str], block_bits: int = BLOCK_BITS) -> DataFrame:
    """Base64 of each group's whole payload, cut at the same parts: ``by..., part, text``.

    The texts put together are the base64 of the whole UTF-8 payload: each part starts at
    the next multiple of three bytes and borrows up to two bytes from what follows it.
    """
    body = F.col("text").cast("binary")
    # The newline between two parts belongs to the second of them here. Only sizes and first
    # bytes take part in the folds; null groups are groups like any other.
    heads = parts.select(
        *by,
        "part",
        (-F.col("part")).alias("_back"),
        F.octet_length("text").cast("bigint").alias("_size"),
        F.concat(F.lit("\n").cast("binary"), F.substring(body, 1, 1)).alias("_head"),
    )
    placed = running(heads, by, "part", {"_start": ("sum", F.col("_size") + 1)}, block_bits=block_bits)
    # Two bytes of what follows a part, though the next part may be a lone newline.
    nothing = F.lit("").cast("binary")
    after = running(placed, by, "_back", {"_after": ("last", F.col("_head"))}, block_bits=block_bits)
    two = F.substring(F.concat("_head", F.coalesce("_after", nothing)), 1, 2)
    followed = running(after, by, "_back", {"_next": ("last", two)}, block_bits=block_bits)
    followed = followed.withColumnsRenamed({name: f"_of_{name}" for name in (*by, "part")})
    met = F.col("part") == F.col("_of_part")
    for name in by:
        met = met & F.col(name).eqNullSafe(F.col(f"_of_{name}"))
    whole = parts.join(followed, met)
    lead = F.when(F.col("_start") > 0, F.lit("\n").cast("binary")).otherwise(nothing)
    whole = whole.withColumns(
        {
            "_body": F.concat(lead, body),
            # Where the body starts and ends in the payload.
            "_from": F.greatest(F.col("_start") - 1, F.lit(0)),
            "_to": F.greatest(F.col("_start") - 1, F.lit(0)) + F.octet_length(F.concat(lead, body)),
        }
    )
    skip, borrow = F.pmod(-F.col("_from"), F.lit(3)), F.pmod(-F.col("_to"), F.lit(3))
    # A part shorter than what it skips leaves some of what it would borrow to the part before.
    over = F.greatest(F.lit(0), skip - (F.col("_to") - F.col("_from")))
    borrowed = F.coalesce(
        F.substring(F.col("_next"), (over + 1).cast("int"), (borrow - over).cast("int")), nothing
    )
    data = F.concat(
        F.substring(F.col("_body"), skip.cast("int") + 1, F.lit(2**31 - 1)), borrowed
    )
    return whole.select(*by, "part", encode_base64(data).alias("text"))
