"""Corpus pipeline: quality classifier, line dedup, near-dedup, decontamination, packing, each over all that is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import decontaminate, line_dedup, near_copies, packing, quality
from tidegate.llm.common import checkpoint, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The sampler and the packer have no counterpart in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the resampler draws; null and empty texts weigh nothing and stay."""
    docs = docs.select(COLUMNS)
    drawn = quality.resample(docs, table(spark, sf_dir, "labels")).select("id").distinct()
    return docs.join(drawn, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select(COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines; no document goes, and ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs.select(COLUMNS), carry=("lang", "source"))
    return out.select(F.col("id").alias("doc_id"), F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a near copy (five-word shingles, SimHash links and min-hash bands, similarity 0.8) of a smaller id that stays; equal rows once. Rows without an id stay."""
    docs = docs.select(COLUMNS)
    first = near_copies.distinct_ids(docs).select("id").unionByName(spark.range(1).select(F.lit(None).cast("long").alias("id")))
    kept = docs.join(first, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select(COLUMNS)
    own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return kept.withColumn("own", own).withColumn("said", F.sha2("text", 256)).dropDuplicates(["doc_id", "said", "own"]).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontaminate.without_leaks(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start_word, n_words, text, bin) of every part of every document: the texts of a bin are a training sequence."""
    out = packing.pack(packing.document_sizes(docs.select(COLUMNS), words=True))
    return out.select(F.col("id").alias("doc_id"), "piece", F.col("start").alias("start_word"), F.col("length").alias("n_words"), "text", "bin")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("near-dedup", near_deduplication),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage leaves is kept in the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, checkpoint(docs) if k else docs, sf_dir)
    return docs
