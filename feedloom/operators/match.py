"""Matching rows against lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.durable import checkpointed
from feedloom.functions.text import bind, trim

# A list within both bounds travels with the plan as one array value.
INLINE_ENTRIES, INLINE_CHARS = 256, 1 << 20

# Runs of characters through which longer lists are matched: those that follow white space,
# for entries that hold one, else all runs of the longest size the entry holds.
WORD_RUN = r"(?s)\s(?=(\S.{15}))"
RUN_SIZES = (48, 16, 4, 1)
RUNS = {"word": WORD_RUN, **{str(n): f"(?s)(?=(.{{{n}}}))" for n in RUN_SIZES}}


def first_contained(
    texts: DataFrame,
    text: str,
    key: str,
    entries: DataFrame,
    entry: str,
    place: str,
    inline_entries: int = INLINE_ENTRIES,
) -> DataFrame:
    """For each row of ``texts``, the first list entry, by ``place``, that its text contains.

    Adds ``place`` to the rows that contain an entry; ``key`` is carried along and may be null
    or repeat. A short list is looked through per row with no join at all. For a longer one,
    rows are numbered and meet entries in an equi-join on one rare run of characters of each
    entry; what a row met joins it by number, and its text is searched where it is. Whole
    texts are searched in both cases, and the result is the same.
    """
    unique = (
        entries.filter(F.col(entry) != "")
        .groupBy(F.col(entry).alias("_entry"))
        .agg(F.min(place).alias("_place"))
    )
    size = unique.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("_entry")), F.lit(0)).alias("chars")
    ).first()
    if size["n"] <= inline_entries and size["chars"] <= INLINE_CHARS:
        listed = unique.agg(F.array_sort(F.collect_list(F.struct("_place", "_entry"))))
        found = bind(texts.withColumn("_listed", listed.scalar()), **{place: _first_hit(F.col(text))})
        return found.filter(F.col(place).isNotNull()).drop("_listed")
    anchors = checkpointed(_anchors(unique))
    # Written once, so that a row has the same number wherever it is read.
    numbered = checkpointed(texts.withColumn("_row", F.monotonically_increasing_id()))
    met = None
    for kind in sorted(r["_kind"] for r in anchors.select("_kind").distinct().collect()):
        runs = F.array_distinct(_runs(F.col(text), kind))
        spots = numbered.select("_row", F.explode(runs).alias("_run"))
        pairs = spots.join(anchors.filter(F.col("_kind") == kind), "_run").select("_row", "_place", "_entry")
        met = pairs if met is None else met.unionByName(pairs)
    # At most the entries whose runs the text holds, each once: an entry has one anchor.
    candidates = met.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_place", "_entry"))).alias("_listed"))
    found = bind(numbered.join(candidates, "_row"), **{place: _first_hit(F.col(text))})
    return found.filter(F.col(place).isNotNull()).select(*texts.columns, place)


def _first_hit(text: Column) -> Column:
    """The place of the first listed entry in the text; later ones are not searched for."""
    none = F.lit(None).cast("bigint")
    seek = lambda at, e: F.when(at.isNotNull(), at).when(F.contains(text, e["_entry"]), e["_place"].cast("bigint"))
    return F.aggregate("_listed", none, seek)


def _runs(text: Column, kind: str) -> Column:
    return F.regexp_extract_all(text, F.lit(RUNS[kind]), F.lit(1))


def _anchors(unique: DataFrame) -> DataFrame:
    """One run per entry, the one that the fewest entries share, and its kind."""
    kind = F.when(F.size(_runs(F.col("_entry"), "word")) > 0, "word")
    runs = F.when(kind == "word", _runs(F.col("_entry"), "word"))
    for n in RUN_SIZES:
        fits = F.length("_entry") >= n
        kind = kind.when(fits, str(n))
        runs = runs.when(fits, _runs(F.col("_entry"), str(n)))
    spread = unique.select("_entry", "_place", kind.alias("_kind"), F.explode(F.array_distinct(runs)).alias("_run"))
    shared = spread.groupBy("_kind", "_run").agg(F.count(F.lit(1)).alias("_shared"))
    return (
        spread.join(shared, ["_kind", "_run"])
        .groupBy("_entry", "_place", "_kind")
        .agg(F.min_by("_run", F.struct("_shared", "_run")).alias("_run"))
    )


def allowed(df: DataFrame, column: str, allow: DataFrame, allow_column: str) -> DataFrame:
    """Rows whose id is on the list, by trimmed equality."""
    return df.join(_ids(allow, allow_column), F.col(column) == F.col("_id"), "left_semi")


def refused(df: DataFrame, column: str, allow: DataFrame, allow_column: str) -> DataFrame:
    """The other rows, null ids included."""
    return df.join(_ids(allow, allow_column), F.col(column) == F.col("_id"), "left_anti")


def _ids(allow: DataFrame, column: str) -> DataFrame:
    textual = allow.schema[column].dataType.typeName() == "string"
    value = trim(F.col(column)) if textual else F.col(column)
    return allow.select(value.alias("_id")).distinct()
