"""Landed snapshots: the logs as Parquet, partitioned by year and sorted by hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlytics.functions.enrich import enrich, full_hour, is_full_hour
from scanlytics.operators.cube import CUBE_KEYS, measures
from scanlytics.schema import LOG_COLUMNS

_ORIGIN = ["archive", "source_file", "row_no", "header", "year"]


def write_by_year(df: DataFrame, path: str, only_years: bool = False) -> None:
    # rebalance lets AQE split a big year over many files and merge small ones
    laid_out = df.hint("rebalance", F.col("year")).sortWithinPartitions("hour_ts")
    writer = laid_out.write.mode("overwrite").partitionBy("year")
    if only_years:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def land(activity: DataFrame, path: str, only_years: bool = False) -> None:
    """Replace the snapshot at ``path``; with ``only_years`` just the years found in ``activity``.

    Hours are cut to the full hour and marked as such in the files' schema, so that readers filter the stored column
    itself. Years can be replaced only in a snapshot that has the mark throughout.
    """
    if only_years and not is_full_hour(activity.sparkSession.read.parquet(path).schema["hour_ts"]):
        raise ValueError(f"the hours of {path} are not marked as full hours; land all of it again")
    write_by_year(landed_rows(activity), path, only_years)


def landed_rows(activity: DataFrame) -> DataFrame:
    """The columns of a snapshot; all others follow from them."""
    columns = [c for c in [*_ORIGIN, *LOG_COLUMNS] if c in activity.columns]
    return activity.select(*columns, full_hour(F.col("hour_ts")))


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Activity rows of a snapshot; filters on ``year`` and ``hour_ts`` read only the partitions and row groups they need."""
    return enrich(_with_year(spark.read.parquet(path)))


def _with_year(rows: DataFrame) -> DataFrame:
    """A snapshot without any hour has a single, null, partition, whose type Spark cannot tell."""
    return rows if dict(rows.dtypes)["year"] == "int" else rows.withColumn("year", F.col("year").cast("int"))


def land_cube(cube: DataFrame, path: str) -> None:
    write_by_year(cube.select(*CUBE_KEYS, *measures("rows", "scans", "size")), path)


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    return _with_year(spark.read.parquet(path))
