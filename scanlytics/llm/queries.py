"""One registered query per text operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scanlytics.llm import bpe, decontamination, fingerprints, html, jaccard_join, masked_lm, merkle, oracles, quality, relative_parse
from scanlytics.llm import resampling, secrets_scan, sharding, suffix_dedup
from scanlytics.llm.common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score_documents(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract_text(pages).select("page_id", "url", "text", "n_chars")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.scan(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeats(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative_parse.factor_documents(table(spark, sf_dir, "documents")).drop("factors")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, WORD_BPE)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_decontamination": op2_decontamination,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_html_extraction": op4_html_extraction,
        "op5_quality": op5_quality,
        "op6_secret_scan": op6_secret_scan,
        "op7_suffix_array_dedup": op7_suffix_array_dedup,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_bpe": op10_bpe,
        "op11_sharding": op11_sharding,
        "op12_resampling": op12_resampling,
        "op13_manifest": op13_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
