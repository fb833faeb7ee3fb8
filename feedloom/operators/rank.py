"""Best record per key, and numbering of repeated tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.durable import checkpointed
from feedloom.functions.measure import tag_measure
from feedloom.operators.running import BLOCK_BITS, HotKeys, hot_keys, hot_keys_of, running

KEY = ("scheme", "host", "port")
UNMEASURED = -1.0


def _measured(df: DataFrame, tag: str, measure: Column | None, unit_aware: bool) -> DataFrame:
    value = tag_measure(F.col(tag), unit_aware) if measure is None else measure
    # Measures are never negative, so any measure beats none.
    return df.withColumn("_measure", F.coalesce(value.cast("double"), F.lit(UNMEASURED)))


def keep_best(
    df: DataFrame,
    key: Sequence[str] = KEY,
    tag: str = "tag",
    seq: str = "seq",
    measure: Column | None = None,
    unit_aware: bool = False,
) -> DataFrame:
    """One record per key: the largest measure, then the earliest row.

    ``first_seq`` is where the key first appeared, which is its place in the output. The
    aggregate combines before the shuffle, so a hot key costs one row per task.
    """
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(F.col("_measure"), -F.col(seq)))
    return (
        _measured(df, tag, measure, unit_aware)
        .groupBy(*key)
        .agg(best.alias("_best"), F.min(seq).alias("first_seq"))
        .select(*key, "_best.*", "first_seq")
    )


def accepted_records(
    df: DataFrame,
    key: Sequence[str] = KEY,
    tag: str = "tag",
    seq: str = "seq",
    measure: Column | None = None,
    unit_aware: bool = False,
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Every record that was the best of its key so far when it arrived, with ``tag_no``.

    ``tag_no`` counts accepted records of the same tag in arrival order, including those
    that a later record of their key replaces; it may therefore have gaps in the result.
    """
    # Written once: whatever parses the records would else run again for every pass below.
    rows = checkpointed(_measured(df, tag, measure, unit_aware))
    hot_key, hot_tag = hot_keys_of(rows, [key, [tag]], block_bits)
    if hot_key:
        rows = _first_copies(rows, hot_key, [*key, "_measure"], seq)
        hot_key = hot_keys(rows, key, block_bits)
    best = {"_best": ("max", F.col("_measure"))}
    records = running(rows, key, seq, best, hot=hot_key, block_bits=block_bits).filter(
        F.col("_best").isNull() | (F.col("_measure") > F.col("_best"))
    )
    numbered = running(
        records, [tag], seq, {"_n": ("count", None)}, hot=hot_tag, block_bits=block_bits
    )
    return numbered.select(*df.columns, (F.col("_n") + 1).alias("tag_no"))


def _first_copies(rows: DataFrame, hot: HotKeys, same: Sequence[str], seq: str) -> DataFrame:
    """Of hot keys, only the earliest row of each measure: no later one is ever accepted.

    Copies are dropped before the shuffle, and a key that is hot through copies is no
    longer hot.
    """
    rest = [c for c in rows.columns if c not in same]
    marked = hot.mark(rows, "_is_hot")
    firsts = (
        marked.filter("_is_hot")
        .groupBy(*same)
        .agg(F.min_by(F.struct(*rest), F.col(seq)).alias("_first"))
        .select(*same, "_first.*")
    )
    return marked.filter("not _is_hot").drop("_is_hot").unionByName(firsts)


def survivors(accepted: DataFrame, key: Sequence[str] = KEY, seq: str = "seq") -> DataFrame:
    """The last accepted record per key, and where the key first appeared."""
    rest = [c for c in accepted.columns if c not in key]
    return (
        accepted.groupBy(*key)
        .agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_last"), F.min(seq).alias("first_seq"))
        .select(*key, "_last.*", "first_seq")
    )


def numbered_link(link: Column, tag_no: Column) -> Column:
    """The second and later links of a tag end in an escaped blank and their number."""
    return F.when(tag_no > 1, F.concat(link, F.lit("%20"), tag_no.cast("string"))).otherwise(link)
