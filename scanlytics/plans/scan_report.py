"""The project-scan report: daily counts per project and scan type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from scanlytics.operators import cube as K
from scanlytics.operators import filters as P
from scanlytics.schema import UNKNOWN


def daily_counts(activity: DataFrame) -> DataFrame:
    """``projectName, scanType, scan_date, scans``; rows with a null in any of the keys drop out.

    The date is ISO text, or ``Unknown`` for logs that have no hour column at all.
    """
    keys = ["projectName", "scanType", "scan_date"]
    date = F.coalesce(F.col("scan_date").cast("string"), F.when(~F.col("has_hour_column"), F.lit(UNKNOWN)))
    dated = K.not_null(activity.withColumn("scan_date", date), *keys)
    return K.deal_out(dated, keys).groupBy(*keys).agg(F.sum("scans_all").alias("scans"))


def type_breakdown(activity: DataFrame) -> DataFrame:
    """Per project the scan types with their scans, largest first; rows without a date count too."""
    keys = ["projectName", "scanType"]
    totals = K.not_null(activity, *keys).groupBy(*keys).agg(F.sum("scans_all").alias("scans"))
    by_size = F.sort_array(
        F.collect_list(F.struct((-F.col("scans")).alias("order"), F.col("scanType"), F.col("scans")))
    )
    entry = lambda e: F.struct(e["scanType"].alias("scanType"), e["scans"].alias("scans"))
    return totals.groupBy("projectName").agg(F.transform(by_size, entry).alias("breakdown"))


def report_records(activity: DataFrame) -> DataFrame:
    """Daily counts, each with the breakdown of its project (empty array if there is none)."""
    none = F.array().cast("array<struct<scanType:string,scans:bigint>>")
    joined = daily_counts(activity).join(type_breakdown(activity), "projectName", "left")
    return joined.withColumn("breakdown", F.coalesce("breakdown", none))


def date_range(activity: DataFrame) -> DataFrame:
    """First and last date of the report's records."""
    dated = K.not_null(activity, "projectName", "scanType", "scan_date")  # unknown dates are in no range
    return dated.agg(F.min("scan_date").alias("min_date"), F.max("scan_date").alias("max_date"))


def filtered(
    daily: DataFrame,
    search: str | None = None,
    scan_type: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    return P.filter_dates(P.filter_scan_type(P.search_projects(daily, search), scan_type), start, end)


def project_totals(daily: DataFrame, **choice) -> DataFrame:
    """The aggregated view: one row per project over the chosen types and dates."""
    return filtered(daily, **choice).groupBy("projectName").agg(F.sum("scans").alias("scans"))


def per_type_view(daily: DataFrame, scan_type: str, **choice) -> DataFrame:
    """One row per project and day of one scan type."""
    return filtered(daily, scan_type=scan_type, **choice)


# The columns a user may sort by, with the keys that make the order total.
_SORTS = {
    "project": ["projectName", "scanType", "scan_date"],
    "type": ["scanType", "projectName", "scan_date"],
    "count": ["scans", "projectName", "scanType", "scan_date"],
}


def sort_columns(df: DataFrame, by: str = "count", descending: bool = True) -> list[Column]:
    first, *rest = [c for c in _SORTS[by] if c in df.columns]
    return [F.desc(first) if descending else F.asc(first), *[F.asc(c) for c in rest]]


def sort_and_page(
    df: DataFrame, by: str = "count", descending: bool = True, number: int = 0, size: int = 10
) -> DataFrame:
    """One page of the sorted view (usual sizes: 10, 20, 30, 50, 100)."""
    return P.page(df, sort_columns(df, by, descending), number, size)


def sort_and_seek(
    df: DataFrame, by: str = "count", descending: bool = True, after: Row | None = None, size: int = 10
) -> DataFrame:
    """The page behind the row ``after`` of the sorted view, the last one of the page before; costs the same for any page."""
    first, *rest = [c for c in _SORTS[by] if c in df.columns]
    order = [(first, descending), *[(c, False) for c in rest]]
    return P.page_after(df, order, None if after is None else [after[c] for c, _ in order], size)


def project_scan_report(activity: DataFrame) -> dict[str, DataFrame]:
    daily = daily_counts(activity)
    return {
        "records": report_records(activity),
        "project_totals": project_totals(daily),
        "date_range": date_range(activity),
    }
