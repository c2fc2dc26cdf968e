"""The stages of the corpus pipeline. Each works on all documents of the one before and, but for the last, returns their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scanlytics.llm import bpe, decontamination, jaccard_join, quality, secrets_scan
from scanlytics.llm.common import table
from scanlytics.llm.queries import WORD_BPE


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id stays of each group; rows with a null id all stay, and so do rows that repeat the id
    that stays: they are the same document."""
    classes = jaccard_join.near_duplicates(docs).where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(classes, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a passage with the benchmark go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in it are replaced."""
    return secrets_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, for every document."""
    kept = docs.select("doc_id", "lang", "source", "text")
    return bpe.encode_documents(kept, WORD_BPE)
