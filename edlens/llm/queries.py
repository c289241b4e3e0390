"""The registered queries of the corpus operators, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edlens.llm import byte_bpe, conversation_repair, filter_audit, fingerprints, jaccard_join, language_id, packing, quality_rules, secret_scan, sql, substring_dedup, token_counts, top_k, url_filters
from edlens.llm.shared import importable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, table: str, sql: str | None = None, *also: str):
    def keep(build: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return build(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in (table, *also)))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return build

    return keep


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_secret_scan", "documents")
def _(docs):
    found = secret_scan.find_secrets(docs.select("doc_id", "text", "source", "lang"))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added", "n_owned", "n_shared", "owners", "repositories")


@query("op2_substring_dedup", "documents", sql.SUBSTRING_DEDUP)
def _(docs):
    return substring_dedup.remove_repeats(docs.select("doc_id", "text")).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


@query("op3_quality_rules", "documents", sql.QUALITY_RULES)
def _(docs):
    return quality_rules.judge(docs.select("doc_id", "text", "source")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_best_fit_packing", "documents")
def _(docs):
    packed = packing.pack_documents(docs.select("doc_id", "text"), vocabulary("word_bpe_49k.json"))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


@query("op5_token_counts", "documents")
def _(docs):
    return token_counts.token_counts(docs.select("doc_id", "text"), vocabulary("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


@query("op6_byte_bpe", "documents")
def _(docs):
    import public_tokenizers

    return byte_bpe.encode_texts(docs.select("doc_id", "text"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


@query("op7_jaccard_join", "documents", sql.JACCARD_JOIN)
def _(docs):
    return jaccard_join.near_duplicates(docs.select("doc_id", "text")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query("op8_language_id", "documents")
def _(docs):
    return language_id.identify(docs.select("doc_id", "text", "lang")).select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")


@query("op9_fingerprints", "documents")
def _(docs):
    return fingerprints.fingerprint_edits(docs.select("doc_id", "text")).withColumnRenamed("id", "doc_id")


@query("op10_url_filters", "pages", sql.URL_FILTERS)
def _(pages):
    return url_filters.judge(pages.select("page_id", "url")).withColumnRenamed("id", "page_id")


@query("op11_filter_audit", "documents", sql.FILTER_AUDIT, "labels")
def _(docs, labels):
    return filter_audit.audit(docs.select("doc_id", "text", "source"), labels)


@query("op12_conversation_repair", "conversations", sql.CONVERSATION_REPAIR)
def _(conversations):
    rows = conversation_repair.damage(conversations)
    return conversation_repair.repair(rows, conversations, tie=("tie_role", "tie_text", "tie_copy"))


@query("op13_exact_top_k", "embeddings", sql.EXACT_TOP_K)
def _(embeddings):
    return top_k.top_k(embeddings.select("vec_id", "embedding"), "id % 50 = 0")
