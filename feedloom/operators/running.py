"""Running folds over ordered rows, per key, without ever putting a hot key in one task.

A window over a key sorts all rows of that key in one task. That is right for ordinary
keys and fatal for one that holds a third of the table. ``running`` measures first:

* no key is hot: one plain window;
* otherwise the rows of hot keys are cut into blocks of consecutive ``seq`` values. The
  window runs inside a block, each block is also reduced to one summary row, the running
  fold of the summaries says what every block starts from, and a join adds that in.

The fold over the summaries is ``running`` again, so a key with very many blocks is
cut once more; as ``seq`` is unique per key, no window ever sees more than
``2 ** block_bits`` rows of a hot key, whatever the gaps in ``seq``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.durable import checkpointed

BLOCK_BITS = 20


@dataclass(frozen=True)
class HotKeys:
    """A written table of the hashes of all keys with more rows than a block, if there are any.

    It has at most one row per block of the input, whatever the number of keys.
    """

    columns: tuple[str, ...]
    hashes: DataFrame | None = None

    def __bool__(self) -> bool:
        return self.hashes is not None

    def mark(self, df: DataFrame, name: str) -> DataFrame:
        """Add whether a row's key is hot; null keys can be, like any other.

        A colliding hash only cuts one more key, which does no harm.
        """
        if self.hashes is None:
            return df.withColumn(name, F.lit(False))
        hashed = df.withColumn("_hash", F.xxhash64(*self.columns))
        met = hashed.join(self.hashes, F.col("_hash") == F.col("_hot"), "left")
        return met.withColumn(name, F.col("_hot").isNotNull()).drop("_hash", "_hot")


def hot_keys(df: DataFrame, keys: Sequence[str], block_bits: int = BLOCK_BITS) -> HotKeys:
    """Find the keys that need cutting, with one count that combines before the shuffle."""
    return hot_keys_of(df, [keys], block_bits)[0]


def hot_keys_of(
    df: DataFrame, key_sets: Sequence[Sequence[str]], block_bits: int = BLOCK_BITS
) -> list[HotKeys]:
    """Hot keys of several key sets in one pass over the rows."""
    hashed = F.posexplode(F.array(*[F.xxhash64(*keys) for keys in key_sets])).alias("which", "h")
    sizes = df.select(hashed).groupBy("which", "h").count()
    hot = checkpointed(sizes.filter(F.col("count") > (1 << block_bits)).select("which", "h"))
    found = {r["which"] for r in hot.select("which").distinct().collect()}
    return [
        HotKeys(
            tuple(keys),
            hot.filter(F.col("which") == i).select(F.col("h").alias("_hot")) if i in found else None,
        )
        for i, keys in enumerate(key_sets)
    ]


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast("bigint"))


# How a fold runs in a window and in a group, and how two results combine: (earlier, later).
_WINDOWED = {
    "count": lambda v: F.count(F.lit(1)),
    "sum": F.sum,
    "max": F.max,
    "first": lambda v: F.first(v, ignorenulls=True),
    "last": lambda v: F.last(v, ignorenulls=True),
}
_GROUPED = {
    "count": lambda v, seq: F.count(F.lit(1)),
    "sum": lambda v, seq: F.sum(v),
    "max": lambda v, seq: F.max(v),
    "first": lambda v, seq: F.min_by(v, F.when(v.isNotNull(), seq)),
    "last": lambda v, seq: F.max_by(v, F.when(v.isNotNull(), seq)),
}
_COMBINED = {
    "count": lambda a, b: _or_zero(a) + b,
    "sum": lambda a, b: _or_zero(a) + _or_zero(b),
    "max": lambda a, b: F.greatest(a, b),
    "first": lambda a, b: F.coalesce(a, b),
    "last": lambda a, b: F.coalesce(b, a),
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    folds: Mapping[str, tuple[str, Column | None]],
    *,
    inclusive: bool = False,
    hot: HotKeys | None = None,
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Add, per row, each fold over the earlier rows of its key (and itself, if inclusive).

    ``folds`` maps a new column to ``(kind, column)``; kinds are count, sum, max, first
    and last, the latter two skipping nulls. ``seq`` is a bigint, unique per key. ``hot``
    may be measured beforehand on a cheaper table with at least these rows.
    """
    if hot is None:
        hot = hot_keys(df, keys, block_bits)
    end = Window.currentRow if inclusive else -1

    def window_over(*partition: str):
        return (
            Window.partitionBy(*partition)
            .orderBy(seq)
            .rowsBetween(Window.unboundedPreceding, end)
        )

    def folded(rows: DataFrame, window) -> DataFrame:
        return rows.withColumns(
            {name: _WINDOWED[kind](v).over(window) for name, (kind, v) in folds.items()}
        )

    if not hot:
        plain = folded(df, window_over(*keys))
        sums = [name for name, (kind, _) in folds.items() if kind == "sum"]
        return plain.withColumns({name: _or_zero(F.col(name)) for name in sums})

    block = f"_{seq}_block"
    marked = hot.mark(df, "_is_hot")
    blocked = marked.withColumn(block, F.when(F.col("_is_hot"), F.shiftright(seq, block_bits)))
    summaries = checkpointed(
        blocked.filter("_is_hot")
        .groupBy(*keys, block)
        .agg(*[_GROUPED[kind](v, F.col(seq)).alias(name) for name, (kind, v) in folds.items()])
    )
    starts = running(
        summaries.withColumnsRenamed({name: f"_of_{name}" for name in folds}),
        keys,
        block,
        {
            f"_at_{name}": ("sum" if kind == "count" else kind, F.col(f"_of_{name}"))
            for name, (kind, _) in folds.items()
        },
        block_bits=block_bits,
    ).drop(*[f"_of_{name}" for name in folds])
    starts = starts.withColumnsRenamed({name: f"_with_{name}" for name in (*keys, block)})
    # Rows of other keys have no block and meet nothing; keys may be null.
    met = F.col(block) == F.col(f"_with_{block}")
    for name in keys:
        met = met & F.col(name).eqNullSafe(F.col(f"_with_{name}"))
    joined = folded(blocked, window_over(*keys, block)).join(starts, met, "left")
    return joined.withColumns(
        {
            name: _COMBINED[kind](F.col(f"_at_{name}"), F.col(name))
            for name, (kind, _) in folds.items()
        }
    ).select(*df.columns, *folds)
