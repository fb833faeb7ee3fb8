"""Connected components of an edge table, by alternating large and small stars.

Every round rewrites the edges so that nodes point to smaller ones and is written to the shared
folder. Neighbourhoods are never gathered: minima are combined before the shuffle and joined
back, so a node with a third of all edges is split like any skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.storage import forget, materialised


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
    return both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of them."""
    least = edges.groupBy("src").agg(F.min("dst").alias("low"))
    moved = edges.join(least, "src").where("dst > low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return least.select("src", F.col("low").alias("dst")).unionByName(moved).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Of edges (src, dst) in any order, each node that has one with the least node it reaches.

    Returns node, root. Repeated edges, self edges and nulls are allowed and add nothing.
    """
    spark = edges.sparkSession
    start = (
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct()
    )
    current, path = materialised(start, "stars")
    before = None
    while True:
        state = current.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("sum"),
        ).first()
        if state == before:
            break
        before = state
        following, next_path = materialised(_small_star(_large_star(current)), "stars")
        forget(spark, path)
        current, path = following, next_path
    roots = current.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
    return current.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(roots)
