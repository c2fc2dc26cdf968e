"""Per-file profile: shape, preview, numeric statistics, frequent values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanlytics.functions import columns as C
from scanlytics.operators.quantiles import exact_quantiles
from scanlytics.operators.ranking import top_k
from scanlytics.schema import LOG_COLUMNS, PREVIEW_COLUMNS

PREVIEW_ROWS = 5
TOP_VALUES = 10
_QUARTILES = {0.25: "25%", 0.5: "50%", 0.75: "75%"}


def _log_view(rows: DataFrame) -> DataFrame:
    """The columns of the log as such; ``hour`` as ISO text."""
    hour = C.iso_hour(F.col("hour_ts")) if "hour" not in rows.columns else F.col("hour")
    return rows.withColumn("hour", hour)


def numeric_columns(rows: DataFrame) -> list[str]:
    return [c for c in LOG_COLUMNS if c in rows.columns and isinstance(rows.schema[c].dataType, T.NumericType)]


def categorical_columns(rows: DataFrame) -> list[str]:
    view = _log_view(rows)
    return [c for c in LOG_COLUMNS if c in view.columns and isinstance(view.schema[c].dataType, T.StringType)]


def file_profile(rows: DataFrame) -> DataFrame:
    """Rows, column names and types of each file."""
    view = _log_view(rows)
    present = [c for c in LOG_COLUMNS if c in view.columns]
    if "header" in rows.columns:
        columns = F.first("header", ignorenulls=True)
    else:
        columns = F.array(*[F.lit(c) for c in present])
    types = F.create_map(*[F.lit(t) for c in present for t in (c, view.schema[c].dataType.simpleString())])
    counted = view.groupBy("source_file").agg(F.sum("rows_all").alias("rows"), columns.alias("columns"))
    return counted.select(
        "source_file",
        "rows",
        "columns",
        F.size("columns").alias("column_count"),
        F.map_filter(types, lambda name, _: F.array_contains("columns", name)).alias("dtypes"),
    )


def log_types(raw: DataFrame) -> DataFrame:
    """``source_file, column, log_type``: what a reader of the single file would take each of its columns for.

    Of rows as read: ``int64`` if all values are whole numbers, ``float64`` if numbers, whole ones with gaps, or nothing
    at all, ``bool`` if all are true or false, else ``object``. Columns that the file has not are left out.
    """
    present = [c for c in LOG_COLUMNS if c in raw.columns]
    has = (lambda c: F.array_contains("header", c)) if "header" in raw.columns else (lambda c: F.lit(True))
    texts = raw.select("source_file", *[F.when(has(c), F.struct(F.col(c).cast("string").alias("text"))).alias(c) for c in present])
    long = texts.unpivot(["source_file"], present, "column", "cell").where(F.col("cell").isNotNull())
    text = F.trim(F.col("cell.text"))
    whole = text.rlike(r"^[+-]?[0-9]+$")
    counted = long.groupBy("source_file", "column").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(text).alias("values"),
        F.count_if(whole).alias("whole"),
        F.count_if(text.try_cast("double").isNotNull() & ~text.rlike("[dDfF]$")).alias("numbers"),
        F.count_if(F.lower(text).isin("true", "false")).alias("truths"),
    )
    filled = F.col("values") == F.col("rows")
    kind = (
        F.when(F.col("numbers") == F.col("values"), F.when(filled & (F.col("whole") == F.col("rows")), "int64").otherwise("float64"))
        .when(filled & (F.col("truths") == F.col("rows")), "bool")
        .otherwise("object")
    )
    return counted.select("source_file", "column", kind.alias("log_type"))


def preview(rows: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows of each file: the five usual columns, or the first five there are."""
    view = _log_view(rows)
    chosen = PREVIEW_COLUMNS
    if not set(PREVIEW_COLUMNS) <= set(view.columns):
        chosen = [c for c in LOG_COLUMNS if c in view.columns][:5]
    first = top_k(view.select("source_file", "row_no", *chosen), ["source_file"], [F.asc("row_no")], n)
    return first.drop("rank")


def numeric_stats(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``source_file, column, stat, value``: count, mean, std, min, quartiles and max."""
    columns = list(columns or numeric_columns(rows))
    long = rows.select("source_file", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ["source_file"], columns, "column", "value"
    )
    keys = ["source_file", "column"]
    basic = long.groupBy(*keys).agg(
        F.count("value").cast("double").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    stats = basic.unpivot(keys, ["count", "mean", "std", "min", "max"], "stat", "value")
    names = F.create_map(*[F.lit(v) for pair in _QUARTILES.items() for v in pair])
    quartiles = exact_quantiles(long, keys, "value", list(_QUARTILES)).select(
        *keys, F.element_at(names, F.col("fraction")).alias("stat"), F.col("quantile").alias("value")
    )
    return stats.unionByName(quartiles)


def top_values(rows: DataFrame, columns: Sequence[str] | None = None, k: int = TOP_VALUES) -> DataFrame:
    """The most frequent values of each text column of each file; equal counts by value."""
    view = _log_view(rows)
    columns = list(columns or categorical_columns(rows))
    long = view.select("source_file", *columns).unpivot(["source_file"], columns, "column", "value")
    keys = ["source_file", "column"]
    counted = long.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("rows"))
    return top_k(counted, keys, [F.desc("rows"), F.asc("value")], k).select(*keys, "rank", "value", "rows")


def run_summary(rows: DataFrame) -> DataFrame:
    """Files and rows of a run."""
    per_file = rows.groupBy("source_file").agg(F.sum("rows_all").alias("rows"))
    return per_file.agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"))
