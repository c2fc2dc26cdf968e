"""Exported project groups: one row per child link."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TREE_SCHEMA = "id string, pid string, name string, isProject boolean"


def read_group_tree(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """``id, pid, name, isProject`` from Parquet, JSON lines or CSV with a header."""
    reader = spark.read.schema(TREE_SCHEMA)
    if format == "csv":
        reader = reader.option("header", True)
    return reader.format(format).load(path)
