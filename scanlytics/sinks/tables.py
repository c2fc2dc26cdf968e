"""Result tables as Parquet, CSV or JSON documents."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlytics.functions.columns import NOT_IN_NAMES

_KEYS = ["grain", "source_file", "year", "projectName"]


def report_name(at: datetime, group: str | None = None, project_scans: bool = False) -> str:
    parts = ["report", f"{at:%Y%m%d_%H%M%S}"]
    if group:
        parts.append(re.sub(NOT_IN_NAMES, "_", group))
    if project_scans:
        parts.append("project_scans")
    return "_".join(parts)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_series(df: DataFrame, path: str) -> None:
    """Chart series, one folder per grain and metric; rebalanced, so that a folder has few files."""
    df.hint("rebalance", "grain", "metric").write.mode("overwrite").partitionBy("grain", "metric").parquet(path)


def write_csv(df: DataFrame, path: str, compress: bool = False) -> None:
    """CSV with header; a breakdown array becomes text such as ``SIGNATURE: 12; SNIPPET: 3``."""
    if "breakdown" in df.columns:
        entry = lambda e: F.concat(e["scanType"], F.lit(": "), e["scans"].cast("string"))
        df = df.withColumn("breakdown", F.array_join(F.transform("breakdown", entry), "; "))
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    if compress:
        writer = writer.option("compression", "gzip")
    writer.csv(path)


def write_json(df: DataFrame, path: str, compress: bool = False) -> None:
    writer = df.write.mode("overwrite")
    if compress:
        writer = writer.option("compression", "gzip")
    writer.json(path)


def _sorted_map(name, value):
    """A map in key order; compared by key alone, as the values may be maps themselves."""

    def by_key(a, b):
        return F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)

    entries = F.collect_list(F.struct(name.alias("key"), value.alias("value")))
    return F.map_from_entries(F.array_sort(entries, by_key))


def _by_status(long: DataFrame, body) -> DataFrame:
    inner = long.groupBy(*_KEYS, "status").agg(body.alias("_part"))
    return inner.groupBy(*_KEYS).agg(F.to_json(_sorted_map(F.col("status"), F.col("_part"))).alias("body"))


def documents(tables: dict[str, DataFrame]) -> DataFrame:
    """``section, grain, source_file, year, projectName, body``: one JSON document per section and grain key.

    A document covers one file, year or project, never the whole analysis, so no task builds more than
    that. Sections are the tables present among totals, scan_types, top_projects and time_blocks.
    """
    bodies = {
        "totals": lambda t: t.select(*_KEYS, F.to_json(F.struct(*[c for c in t.columns if c not in _KEYS])).alias("body")),
        "scan_types": lambda t: _by_status(t, _sorted_map(F.col("scanType"), F.col("scans"))),
        "top_projects": lambda t: _by_status(
            t.withColumnRenamed("projectName", "project").withColumn("projectName", F.lit(None).cast("string")),
            F.array_sort(F.collect_list(F.struct("rank", "project", "scans"))),
        ),
        "time_blocks": lambda t: _by_status(
            t, F.array_sort(F.collect_list(F.struct("block_order", "time_block", "count", "percentage")))
        ),
    }
    out = None
    for section, build in bodies.items():
        if section in tables:
            part = build(tables[section]).select(F.lit(section).alias("section"), *_KEYS, "body")
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"none of the tables has a document form: {sorted(tables)}")
    return out


def write_documents(docs: DataFrame, path: str, compress: bool = False) -> None:
    writer = docs.write.mode("overwrite").partitionBy("section")
    if compress:
        writer = writer.option("compression", "gzip")
    writer.json(path)
