"""The queries of this subpackage by name, and their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from strandloom.llm import filter_audit, fingerprints, language_id, license_scan, lm_scoring, mixing, near_dedup, packing, substring_dedup, token_counts, token_files, topk, whitening
from strandloom.llm.common import crc32_text, table
from strandloom.session import shipped


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op3_identify_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    predicted = language_id.predict(docs, language_id.fit(docs))
    return predicted.select("doc_id", (crc32_text(F.col("doc_id")) % 5 == 0).alias("held_out"), "lang_pred", "score")


def op4_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op7_score_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
    return found.select("query_id", "rank", "vec_id", "score")


def op9_fingerprint_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_token_files(table(spark, sf_dir, "documents"))
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.long_form(whitening.whiten(table(spark, sf_dir, "embeddings")))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = (
        op1_mix_sources, op2_near_duplicates, op3_identify_languages, op4_scan_licenses, op5_pack_documents, op6_count_tokens, op7_score_lm,
        op8_top_k, op9_fingerprint_documents, op10_token_files, op11_substring_dedup, op12_filter_audit, op13_whiten_embeddings,
    )
    found = {f.__name__: shipped(f) for f in numbered}
    return found | {"pipeline": shipped(corpus_pipeline.run)}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_scan_licenses": license_scan.scan_sql(), "op8_top_k": topk.top_k_sql(),
        "op11_substring_dedup": substring_dedup.remove_repeats_sql(), "op12_filter_audit": filter_audit.audit_sql(),
    }
