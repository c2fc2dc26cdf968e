"""Hourly series and scan-type evolution: every hour of every series; ``ranking.stride_sample`` thins them for a chart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlytics.operators import cube as K
from scanlytics.schema import STATUSES, TREND_COLUMNS


def hourly_series(
    activity: DataFrame,
    by: Sequence[str] = (),
    statuses: Sequence[str] = STATUSES,
    measure: str = "scans",
    projects: DataFrame | None = None,
) -> DataFrame:
    """``by, status, hour_ts, count, size``: scans (or log rows) and total size per hour.

    ``projects`` limits the series to these projects. The filter runs on the hourly table, where a hot
    project is down to one row per hour.
    """
    keys = [*by, "hour_ts"]
    kinds = list(dict.fromkeys(["rows", measure, "size"]))
    hourly = K.roll_up(K.deal_out(K.not_null(activity, *keys), keys), keys, *kinds)
    if projects is not None:
        hourly = hourly.join(projects.select("projectName"), "projectName", "left_semi")
    return K.unpivot_status(hourly, keys, [measure, "size"], statuses).withColumnRenamed(measure, "count")


def scan_type_evolution(
    activity: DataFrame,
    by: Sequence[str] = (),
    statuses: Sequence[str] = STATUSES,
    measure: str = "scans",
    projects: DataFrame | None = None,
) -> DataFrame:
    """``by, scanType, status, hour_ts, count``: one series per scan type."""
    return hourly_series(activity, [*by, "scanType"], statuses, measure, projects).drop("size")


def daily_series(activity: DataFrame) -> DataFrame:
    """``hour_ts, count, size``: one row per day, at its first hour."""
    hours = activity.where(F.col("hour_ts").isNotNull())
    daily = hours.groupBy(F.to_date("hour_ts").alias("_day")).agg(
        F.min("hour_ts").alias("hour_ts"), F.sum("scans_all").alias("count"), F.sum("size_all").alias("size")
    )
    return daily.drop("_day")


def column_trends(rows: DataFrame) -> DataFrame:
    """``source_file, column, row_no, value``: the raw measures of each file in row order."""
    present = [c for c in TREND_COLUMNS if c in rows.columns]
    return rows.select("source_file", "row_no", *[F.col(c).cast("bigint").alias(c) for c in present]).unpivot(
        ["source_file", "row_no"], present, "column", "value"
    )
