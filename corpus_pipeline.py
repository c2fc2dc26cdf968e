"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns the next stage's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scanlytics.llm import stages
from scanlytics.llm.common import stored, table

STAGES = [
    ("quality", stages.quality_filter),
    ("near_duplicates", stages.near_duplicates),
    ("decontamination", stages.decontaminate),
    ("secrets", stages.redact_secrets),
    ("bpe", stages.encode),
]

#: No SQL: the classifier and the tokenizer cannot be written in it; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
