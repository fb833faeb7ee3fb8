"""Screen a corpus: the stages in order, each on all that its predecessor kept.

Every stage but the last returns the columns of ``documents``. Decisions meet their rows by
doc_id (null-safe) and a hash of the text, so repeated and null ids do no harm.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import contamination, exact, packing, simhash, toxicity
from feedloom.llm.queries import teaching_labels
from feedloom.llm.shipping import ship
from feedloom.llm.storage import materialised, unused

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _without(docs: DataFrame, dropped: DataFrame, key: Column) -> DataFrame:
    """``docs`` less the rows whose doc_id and key are among ``dropped`` (doc_id, key)."""
    name = unused(docs, "row_key")
    gone = dropped.select(F.col("doc_id").alias(f"{name}_gone"), F.col("key").alias(f"{name}_of")).distinct()
    keyed = docs.withColumn(name, key)
    met = keyed["doc_id"].eqNullSafe(gone[f"{name}_gone"]) & (keyed[name] == gone[f"{name}_of"])
    return keyed.join(gone, met, "left_anti").drop(name)


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold."""
    ship(spark)
    name = unused(docs, "toxicity")
    scored = toxicity.score_documents(docs, teaching_labels(spark, sf_dir), name)
    return scored.where(F.col(name) < toxicity.SCORE_THRESHOLD).drop(name)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside."""
    ship(spark)
    found, _ = materialised(exact.deduplicate(docs), "exact-copies")
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    digest = F.sha2(text.cast("binary"), 256)
    found = found.withColumn("key", F.col("text_sha256"))
    dropped = found.where(~F.col("kept"))
    again = dropped.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    kept = _without(docs, dropped.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))), digest)
    if again.isEmpty():
        return kept
    # Rows that repeat the id of the one that stays: any of them is that document.
    name = unused(docs, "digest")
    return kept.withColumn(name, digest).dropDuplicates(["doc_id", name]).drop(name)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints, that with the smallest id."""
    ship(spark)
    found, _ = materialised(simhash.near_duplicates(docs), "near-copies")
    row = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "text_hash")
    first = found.groupBy("component").agg(F.min(row).alias("first"))
    dropped = found.join(first, "component").where(row != F.col("first"))
    return _without(docs, dropped.select("doc_id", F.col("text_hash").alias("key")), F.xxhash64(F.col("text").cast("string")))


def unseen_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    ship(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    row = F.xxhash64("doc_id", F.col("text").cast("string"))
    found = contamination.decontaminate(docs.select(row.alias("doc_id"), "text"), benchmark)
    dropped = found.where(F.col("n_hit") > 0).select("doc_id")
    name = unused(docs, "row_key")
    keyed = docs.withColumn(name, row)
    return keyed.join(dropped.toDF(f"{name}_hit").distinct(), F.col(name) == F.col(f"{name}_hit"), "left_anti").drop(name)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, packed into sequences."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("row", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean_language),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", unseen_tests),
    ("best-fit packing", packed),
]

#: Trained models and tokenizers are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = materialised(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
