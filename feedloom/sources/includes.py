"""Lists that include other lists.

Both tables hold content lines: ``roots(root, line_no, line)`` and
``lists(list_id, line_no, line)``. A line ``api://X`` stands for the lines of list X.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from decimal import Decimal
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.constants import INCLUDE
from feedloom.durable import checkpointed
from feedloom.functions.text import trim

# Written pieces of the visited table after which they are merged into one.
MERGE_EVERY = 8
# Found lists up to which the visited table is searched for them before it is shuffled.
FEW = 1 << 16
# Codes of paths below these bounds are numbers of the type.
CODES = {"bigint": 2**63, "decimal(38,0)": 10**38}

KEYS = ["root", "list_id"]


def is_include(line: Column) -> Column:
    return line.startswith(INCLUDE)


def included(line: Column) -> Column:
    return trim(F.substring(line, len(INCLUDE) + 1, 2**31 - 1))


@contextmanager
def _edges(lists: DataFrame) -> Iterator[DataFrame]:
    """Include lines as ``parent, place, child``; a repeated child keeps its first place.

    They are dealt and sorted by parent once and kept on the executors' disks meanwhile, so
    the rounds neither shuffle nor sort them.
    """
    spark = lists.sparkSession
    edges = (
        lists.filter(is_include(F.col("line")))
        .select(F.col("list_id").alias("parent"), included(F.col("line")).alias("child"), "line_no")
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "parent")
        .groupBy("parent", "child")
        .agg(F.min("line_no").alias("place"))
        .sortWithinPartitions("parent")
        .persist(StorageLevel.DISK_ONLY)
    )
    try:
        yield edges
    finally:
        edges.unpersist()


def _starts(roots: DataFrame) -> DataFrame:
    return (
        roots.filter(is_include(F.col("line")))
        .groupBy("root", included(F.col("line")).alias("list_id"))
        .agg(F.min("line_no").alias("place"))
    )


def _all(pieces: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, pieces)


def _among(visited: DataFrame, offered: DataFrame) -> DataFrame:
    """``visited``, less lists that were not offered if few were."""
    if offered.count() > FEW:
        return visited
    return visited.join(offered.select(KEYS), KEYS, "left_semi")


def reachable(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, list_id``: the lists that each root reaches, each once, cycles included.

    Breadth-first rounds: only lists found in the round before are joined with the
    include lines, and lists known already are taken out. Each round is written, so the
    plan stays short and a lost executor costs one read.
    """
    frontier = checkpointed(_starts(roots).drop("place"))
    pieces = [frontier]
    with _edges(lists) as edges:
        while not frontier.isEmpty():
            if len(pieces) > MERGE_EVERY:
                pieces = [checkpointed(_all(pieces))]
            step = checkpointed(
                frontier.join(edges, F.col("list_id") == F.col("parent"))
                .select("root", F.col("child").alias("list_id"))
                .distinct()
            )
            frontier = checkpointed(step.join(_among(_all(pieces), step), KEYS, "left_anti"))
            pieces.append(frontier)
    return _all(pieces)


class _Codes:
    """Paths of equal length as numbers in the same order, with a digit for each place."""

    def __init__(self, least: int | None, most: int | None):
        self.least = 0 if least is None else least
        self.base = 2 if most is None else most - self.least + 2

    def kind(self, length: int) -> str | None:
        """The type of the codes of paths; none if they are too long for any."""
        if self.base > 2**62:
            return None
        return next((k for k, bound in CODES.items() if self.base**length <= bound), None)

    def weight(self, power: int, kind: str) -> Column:
        value = self.base**power
        return F.lit(value if kind == "bigint" else Decimal(value))

    def digit(self, place: Column, kind: str) -> Column:
        # Null comes before all numbers.
        wide = "bigint" if kind == "bigint" else "decimal(20,0)"
        least = self.least if kind == "bigint" else Decimal(self.least)
        return F.coalesce((place.cast(wide) - F.lit(least) + 1).cast(wide), F.lit(0).cast(wide))

    def code(self, path: Column, length: int, kind: str, more: int = 0) -> Column:
        """The code of a path, with so many digits 0 after it."""
        digits = [
            (self.digit(path[i], kind) * self.weight(length - 1 - i + more, kind)).cast(kind)
            for i in range(length)
        ]
        return reduce(lambda a, b: (a + b).cast(kind), digits)

    def path(self, code: Column, length: int, kind: str) -> Column:
        def place(i: int) -> Column:
            rest = code if i == 0 else code % self.weight(length - i, kind)
            digit = F.call_function("div", rest, self.weight(length - 1 - i, kind)).cast("bigint")
            return F.when(digit > 0, digit - 1 + F.lit(self.least))

        return F.array(*map(place, range(length)))


def _offers(frontier: DataFrame, edges: DataFrame, codes: _Codes, length: int) -> DataFrame:
    """The smallest path, a place longer, on which a root comes from its frontier to a list."""
    kind, longer = codes.kind(length + 1), length + 1
    groups = ["root", F.col("child").alias("list_id")]
    met = F.col("list_id") == F.col("parent")
    if kind is None:
        offer = F.min(F.concat("path", F.array("place"))).alias("offer")
        return frontier.join(edges, met).groupBy(*groups).agg(offer)
    # Numbers are combined by hashing before the shuffle; arrays would be sorted.
    coded = frontier.select(*KEYS, codes.code(F.col("path"), length, kind, more=1).alias("code"))
    code = F.min((F.col("code") + codes.digit(F.col("place"), kind)).cast(kind)).alias("code")
    found = coded.join(edges, met).groupBy(*groups).agg(code)
    return found.select(*KEYS, codes.path(F.col("code"), longer, kind).alias("offer"))


def _settled(pieces: list[DataFrame]) -> DataFrame:
    """``root, list_id, path``: rows for which no later round found a smaller path."""
    rows = _all(pieces)
    better = rows.filter("again").select(F.col("root").alias("_root"), F.col("list_id").alias("_list"), F.col("round").alias("_round"))
    same = (F.col("root") == F.col("_root")) & (F.col("list_id") == F.col("_list"))
    return rows.join(better, same & (F.col("_round") > F.col("round")), "left_anti")


def arrival_paths(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, list_id, path``: reached lists with their place in depth-first order.

    A depth-first walk with a visited set enters each list along its smallest path, read
    as the sequence of line numbers. Rounds improve the paths until none gets smaller; the
    paths that a round finds have a place for each round.
    """
    starts = checkpointed(_starts(roots))
    frontier = starts.select(
        *KEYS, F.array("place").alias("path"), F.lit(False).alias("again"), F.lit(1).alias("round")
    )
    pieces, length = [frontier], 1
    with _edges(lists) as edges:
        places = edges.select(F.col("place").cast("bigint")).union(starts.select(F.col("place").cast("bigint")))
        codes = _Codes(*places.agg(F.min("place"), F.max("place")).first())
        while not frontier.isEmpty():
            if len(pieces) > MERGE_EVERY:
                pieces = [checkpointed(_settled(pieces))]
            offered = checkpointed(_offers(frontier, edges, codes, length))
            known = _among(_all(pieces), offered).groupBy(KEYS).agg(F.min("path").alias("path"))
            length += 1
            frontier = checkpointed(
                offered.join(known, KEYS, "left")
                .filter(F.col("path").isNull() | (F.col("offer") < F.col("path")))
                .select(
                    *KEYS,
                    F.col("offer").alias("path"),
                    F.col("path").isNotNull().alias("again"),
                    F.lit(length).alias("round"),
                )
            )
            pieces.append(frontier)
    return _settled(pieces).select(*KEYS, "path")


def expand_includes(lists: DataFrame, roots: DataFrame, ordered: bool = False) -> DataFrame:
    """Literal lines of each root and of every list it reaches, each list expanded once.

    Unordered, the result is a bag with ``list_id`` and ``line_no`` (``list_id`` is null
    for the root's own lines). Ordered, ``path`` sorts the lines as a depth-first walk
    would have met them.
    """
    own = roots.filter(~is_include(F.col("line")))
    literal = lists.filter(~is_include(F.col("line")))
    id_type = lists.schema["list_id"].dataType
    own = own.withColumn("list_id", F.lit(None).cast(id_type))
    columns = ["root", "list_id", "line_no", "line"]
    if not ordered:
        found = literal.join(reachable(lists, roots), "list_id")
        return own.select(columns).unionByName(found.select(columns))
    place = F.array(F.col("line_no")).alias("path")
    found = literal.join(arrival_paths(lists, roots), "list_id")
    return own.select(*columns, place).unionByName(
        found.select(*columns, F.concat("path", F.array("line_no")).alias("path"))
    )


def missing_lists(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, list_id``: lists that a root reaches but that did not land.

    They add no lines and stop nothing else.
    """
    landed = lists.select("list_id").distinct()
    return reachable(lists, roots).join(landed, "list_id", "left_anti").select("root", "list_id")


def expand_one_level(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """One level only: includes inside included lists are dropped, repeats come again."""
    columns = ["root", "list_id", "line_no", "line", "path"]
    line = F.col("line")
    id_type = lists.schema["list_id"].dataType
    own = (
        roots.filter(~is_include(line))
        .withColumn("list_id", F.lit(None).cast(id_type))
        .withColumn("path", F.array("line_no"))
    )
    calls = roots.filter(is_include(line)).select(
        "root", included(line).alias("list_id"), F.col("line_no").alias("_at")
    )
    found = (
        lists.filter(~is_include(line))
        .join(calls, "list_id")
        .withColumn("path", F.array("_at", "line_no"))
    )
    return own.select(columns).unionByName(found.select(columns))
