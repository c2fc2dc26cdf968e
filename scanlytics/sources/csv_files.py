"""Unpacked CSV logs: a file or a folder, each file with its own column order."""

from __future__ import annotations

import csv
import io
import posixpath
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanlytics.operators.ranking import row_positions
from scanlytics.schema import LOG_COLUMNS, NULL_TOKENS, RAW_SCHEMA
from scanlytics.sources.remote import open_file, ship_code


def _headers(paths: DataFrame) -> DataFrame:
    """The first line of each file, read in the tasks."""

    def first_lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lines = []
            for path in frame["path"]:
                with open_file(path) as raw:
                    lines.append(io.TextIOWrapper(raw, "utf-8-sig").readline().rstrip("\r\n"))
            yield pd.DataFrame({"path": frame["path"], "header": lines})

    ship_code()
    return paths.mapInPandas(first_lines, "path string, header string")


def _log_rows(spark: SparkSession, files: list[str], line: str, multi_line: bool, root: str) -> DataFrame:
    header = [c.strip() for c in next(csv.reader([line]))]
    # position keeps repeated or empty names apart
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(header))])
    reader = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", multi_line)
    rows = reader.csv(files)

    def log_column(name):
        if name not in header:
            return F.lit(None).cast("string").alias(name)
        text = F.col(f"_c{header.index(name)}")
        return F.when(~text.isin(NULL_TOKENS), text).alias(name)

    def decoded(name):
        # Spark gives file names percent-encoded; a plain + is no space
        return F.url_decode(F.replace(F.col(f"_metadata.{name}"), F.lit("+"), F.lit("%2B")))

    return rows.select(
        F.regexp_replace(decoded("file_path"), "/[^/]*$", "").alias("archive"),
        F.substr(decoded("file_path"), F.lit(len(root) + 1)).alias("source_file"),
        F.lit(None).cast("bigint").alias("row_no"),
        F.array(*[F.lit(c) for c in header]).alias("header"),
        *[log_column(c) for c in LOG_COLUMNS],
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_order"),
    )


def read_csv_files(
    spark: SparkSession, path: str, multi_line: bool = False, number_rows: bool = False
) -> DataFrame:
    """Raw rows of all CSV files under ``path``. Files with the same header are read together.

    ``source_file`` is the place below the folder that holds all of them.

    Large files are read in splits; ``multi_line`` (quoted line breaks) gives that up. ``number_rows``
    fills ``row_no``, which preview and column trends need, at the cost of one shuffle.
    """
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path")
    files = defaultdict(list)
    for row in _headers(paths).collect():
        if row.header:
            files[row.header].append(row.path)
    if not files:
        raise ValueError(f"no CSV files in {path}")
    folders = {p.rpartition("/")[0] for same in files.values() for p in same}
    root = posixpath.commonprefix([f"{f}/" for f in folders]).rpartition("/")[0] + "/"
    parts = [_log_rows(spark, sorted(same), line, multi_line, unquote(root)) for line, same in sorted(files.items())]
    rows = reduce(DataFrame.unionByName, parts)
    if number_rows:
        rows = row_positions(rows.drop("row_no"), ["archive", "source_file"], "_order", F.col("_block"))
    return rows.select(*[f.name for f in RAW_SCHEMA])
