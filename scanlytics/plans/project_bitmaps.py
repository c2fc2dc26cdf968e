"""Distinct projects of any slice, exact, from stored bitmaps.

Distinct counts do not add up, so a count by file and year says nothing of two files together. Sets do: every project
gets a number from a dense dictionary, and each (file, year) keeps the set of its projects as bitmaps of 32,768 numbers
each. A slice ors the bitmaps of its files and years and counts the bits; the rows are not read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlytics.operators.cube import not_null
from scanlytics.operators.ranking import row_positions

_BUCKETS = 1024
_BITMAPS = "source_file string, part bigint, bits binary, year int"


def project_dictionary(activity: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``projectName, project_no``: numbers from 0 on without a gap, one for each distinct name that is not null.

    With ``known``, an earlier dictionary, its numbers stay and new names follow on, so that bitmaps made with it can
    be or-ed with later ones. Numbers are dealt out by hash buckets; no task sees all names.
    """
    names = not_null(activity, "projectName").select("projectName").distinct()
    if known is not None:
        names = names.join(known, "projectName", "left_anti")
    bucket = F.pmod(F.xxhash64("projectName"), F.lit(_BUCKETS))
    numbered = row_positions(names, [], "projectName", bucket, "project_no").withColumn("project_no", F.col("project_no").cast("bigint"))
    if known is None:
        return numbered
    following = F.coalesce(known.agg(F.max("project_no") + 1).scalar(), F.lit(0))
    return known.select("projectName", "project_no").unionByName(numbered.withColumn("project_no", F.col("project_no") + following))


def project_bitmaps(activity: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``source_file, year, part, bits``: the projects of each file and year, ``part`` being 32,768 numbers.

    Rows are folded to (file, year, project) before they meet the dictionary, so a project that holds a third of all
    rows is one row of each file and year. Rows without a project are in no set; a null year is a year of its own.
    """
    reduced = not_null(activity, "projectName").select("source_file", "year", "projectName").distinct()
    numbered = reduced.join(dictionary, "projectName")
    part = F.bitmap_bucket_number(F.col("project_no") + 1)  # bucket n holds the numbers behind 32,768 * (n - 1)
    bit = F.bitmap_bit_position(F.col("project_no") + 1)
    return numbered.groupBy("source_file", "year", part.alias("part")).agg(F.bitmap_construct_agg(bit).alias("bits"))


def land_bitmaps(activity: DataFrame, path: str) -> None:
    """Write ``dictionary`` and ``bitmaps`` (by year) below ``path``."""
    spark = activity.sparkSession
    project_dictionary(activity).write.mode("overwrite").parquet(f"{path}/dictionary")
    dictionary = spark.read.schema("projectName string, project_no bigint").parquet(f"{path}/dictionary")
    project_bitmaps(activity, dictionary).write.mode("overwrite").partitionBy("year").parquet(f"{path}/bitmaps")


def read_bitmaps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BITMAPS).parquet(f"{path}/bitmaps")


def slice_bitmaps(
    bitmaps: DataFrame, files: Sequence[str] | None = None, start_year: int | None = None, end_year: int | None = None
) -> DataFrame:
    """The bitmaps of a set of files and an inclusive range of years; a null year is in no range."""
    if files is not None:
        bitmaps = bitmaps.where(F.col("source_file").isin(list(files)))
    if start_year is not None:
        bitmaps = bitmaps.where(F.col("year") >= start_year)
    if end_year is not None:
        bitmaps = bitmaps.where(F.col("year") <= end_year)
    return bitmaps


def unique_projects(bitmaps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct projects of all the bitmaps given, or of each ``by`` (``source_file``, ``year``). 0 for none."""
    merged = bitmaps.groupBy(*by, "part").agg(F.bitmap_or_agg("bits").alias("bits"))
    counted = F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("unique_projects")
    return merged.groupBy(*by).agg(counted) if by else merged.agg(counted)
