"""A training corpus from raw documents in five stages: rules, near copies, repeated passages, secrets, packing.

Each stage is written as Parquet and read again, so a lost executor costs no more than the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edlens.llm import jaccard_join, packing, quality_rules, secret_scan, substring_dedup
from edlens.llm.queries import vocabulary
from edlens.llm.shared import free, importable, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines frequent in their host; n_chars follows."""
    kind = docs.schema["n_chars"].dataType
    (before,) = free(docs.columns, "before")
    kept = quality_rules.keep_good(docs.withColumn(before, F.length("text")))
    return kept.withColumn("n_chars", F.when(F.length("text") == F.col(before), F.col("n_chars")).otherwise(F.length("text")).cast(kind)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id."""
    importable(spark)
    return jaccard_join.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand earlier; n_chars follows, and documents of which nothing is left go."""
    importable(spark)
    cut = substring_dedup.remove_repeats(docs, carry=docs.columns)
    cut = cut.where("n_removed = 0 or n_removed < n_words")
    text = F.coalesce("kept_text", "row.text")
    changed = {"text": text, "n_chars": F.when(F.col("kept_text").isNull(), F.col("row.n_chars")).otherwise(F.length("kept_text")).cast(docs.schema["n_chars"].dataType)}
    return cut.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets masked; n_chars follows."""
    kind = docs.schema["n_chars"].dataType
    (before,) = free(docs.columns, "before")
    masked = secret_scan.mask_secrets(docs.withColumn(before, F.length("text")))
    return masked.withColumn("n_chars", F.when(F.length("text") == F.col(before), F.col("n_chars")).otherwise(F.length("text")).cast(kind)).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and place."""
    importable(spark)
    packed = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [("quality rules", rules), ("n-gram Jaccard join", near_copies), ("substring dedup", passages), ("secret scans", secrets), ("best-fit packing", sequences)]

#: Tokens and the packing have no SQL form; the tests hold every stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
