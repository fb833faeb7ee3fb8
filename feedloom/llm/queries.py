"""One query per operator over its whole table, with production parameters; SQL where it can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import contamination, exact, idfiles, lm, neighbours, packing, pii, resampling, runs, simhash, substrings, toxicity, warc
from feedloom.llm.shipping import ship

#: Words among which the words of a proximity match lie.
NEAR_WORDS = 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back by its index row."""
    index, folder = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return warc.read(index, folder, payloads=False).drop("url", "payload")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token pieces of every document, packed into sequences of 1024."""
    docs = _table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("row", "ids")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the words and items that 10-word benchmark windows hit.

    n_near: items with a window whose words all lie within NEAR_WORDS words, in any order.
    """
    docs, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = contamination.decontaminate(docs, benchmark, near=NEAR_WORDS)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("bigint").alias("n_near"),
        F.sha2(F.array_join("near_items", ",").cast("binary"), 256).alias("near_sha256"),
    )


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's masked pseudo-log-likelihood under a model of the corpus."""
    return lm.score_documents(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document of its text that stays."""
    return exact.deduplicate(_table(spark, sf_dir, "documents")).drop("row_id")


def op6_idfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to id files and read back."""
    docs = _table(spark, sf_dir, "documents")
    return idfiles.round_trip(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-word windows that an earlier document holds."""
    return substrings.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the component its links reach."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash", "component")


def teaching_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that may be learnt from; the others are held out."""
    return _table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; documents of one crc32 remainder never teach."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    scored = toxicity.score_documents(docs.select("doc_id", "text"), teaching_labels(spark, sf_dir), text=False)
    return scored.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.SCORE_THRESHOLD).cast("int").alias("predicted"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts and digest of base spans, and all spans."""
    docs = _table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))

    def listed(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans")
    )


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's texts; a twentieth is drawn."""
    drawn = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs, a tenth of the documents made periodic first."""
    return runs.collapse_runs(_table(spark, sf_dir, "documents"), planted=True)


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every hundredth vector."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_warc": op1_warc,
    "op2_packing": op2_packing,
    "op3_decontamination": op3_decontamination,
    "op4_lm": op4_lm,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_idfiles": op6_idfiles,
    "op7_substrings": op7_substrings,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
    "op11_resampling": op11_resampling,
    "op12_runs": op12_runs,
    "op13_neighbours": op13_neighbours,
}

#: SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op5_exact_dedup": r"""
        SELECT doc_id,
               min(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept,
               text_sha256
        FROM (SELECT doc_id,
                     sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
              FROM documents)
        WINDOW same AS (PARTITION BY text_sha256)""",
    # CRC-32 byte by byte over each distinct feature, from a table made by the polynomial.
    "op11_resampling": r"""
        WITH RECURSIVE steps(b, k, r) AS (
            SELECT range, 0, range FROM range(256)
            UNION ALL
            SELECT b, k + 1, CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END FROM steps WHERE k < 8),
        crc_table AS (SELECT list(r ORDER BY b) AS t FROM steps WHERE k = 8),
        texts AS (
            SELECT 1 AS side, row_number() OVER () AS row, doc_id, text FROM documents
            UNION ALL SELECT 2, row_number() OVER (), NULL, text FROM benchmark),
        worded AS (
            SELECT side, row, doc_id,
                   regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM texts),
        features AS (
            SELECT side, row, unnest(list_concat(
                       w,
                       [w[i] || ' ' || w[i + 1] for i in range(1, len(w))],
                       [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])) AS f
            FROM worded),
        counted AS (SELECT side, row, f, count(*) AS c FROM features GROUP BY ALL),
        bucketed AS (
            SELECT f, xor(list_reduce(
                       list_concat([4294967295::BIGINT],
                                   [('0x' || hex(encode(f))[2 * i + 1 : 2 * i + 2])::BIGINT for i in range(octet_length(encode(f)))]),
                       lambda r, b: xor(t[1 + xor(r, b) % 256], r // 256)), 4294967295) % 10000 AS bucket
            FROM (SELECT DISTINCT f FROM counted), crc_table),
        held AS (SELECT side, row, bucket, sum(c) AS c FROM counted JOIN bucketed USING (f) GROUP BY ALL),
        shares AS (
            SELECT bucket, sum(c) FILTER (side = 1) AS s, sum(c) FILTER (side = 2) AS t FROM held GROUP BY bucket),
        totals AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM shares),
        gains AS (
            SELECT bucket, floor(1000 * ln(
                       (coalesce(shares.t, 0) + 1)::DOUBLE * (totals.s + 10000)::DOUBLE
                       / ((coalesce(shares.s, 0) + 1)::DOUBLE * (totals.t + 10000)::DOUBLE)))::BIGINT AS gain
            FROM shares, totals),
        weighed AS (
            SELECT row, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight
            FROM held JOIN gains USING (bucket) WHERE side = 1 GROUP BY row),
        scored AS (
            SELECT doc_id, row, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln(
                       (('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE)
                       / 4294967296::DOUBLE)))::BIGINT AS score
            FROM worded LEFT JOIN weighed USING (row) WHERE side = 1),
        ranked AS (
            SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, row) AS rank, count(*) OVER () AS n
            FROM scored WHERE n_words >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank
        FROM scored LEFT JOIN ranked USING (row)""",
}
