"""Counts, totals and distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlytics.functions import columns as C
from scanlytics.operators import cube as K

_TOTALS = {
    "total_rows": "rows_all",
    "total_scans": "scans_all",
    "successful_scans": "scans_success",
    "failed_scans": "scans_failed",
}


def _totals() -> list[Column]:
    """0 rather than null when there are no rows at all."""
    return [F.coalesce(F.sum(measure), F.lit(0)).alias(name) for name, measure in _TOTALS.items()]


def _with_rate(df: DataFrame) -> DataFrame:
    return df.withColumn("success_rate", C.percent(F.col("successful_scans"), F.col("total_scans")))


def summary_totals(activity: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row: files, rows, distinct projects, scans by outcome and the success rate.

    Rows are first folded to (file, project), so the two distinct counts see a small table. ``files``
    lists the files read (``source_file``), for counting those without rows too; pass the files of all years when
    ``activity`` covers some only.
    """
    reduced = K.roll_up(activity, ["source_file", "projectName"], "rows", "scans")
    totals = reduced.agg(
        F.count_distinct("source_file").alias("total_files"),
        F.count_distinct("projectName").alias("unique_projects"),
        *_totals(),
    )
    if files is not None:
        totals = totals.withColumn("total_files", files.agg(F.count_distinct("source_file")).scalar())
    return _with_rate(totals)


def totals_by_grain(activity: DataFrame, grains: Sequence[str] = tuple(K.GRAINS)) -> DataFrame:
    """Totals at every combination of file, year and project in one pass; ``total_files`` is 1 for a grain with a file."""
    keys = list(dict.fromkeys([*K.finest_keys(grains), "projectName"]))
    reduced = K.roll_up(K.deal_out(activity, keys), keys, "rows", "scans").withColumn("_project", F.col("projectName"))
    unique = F.count_distinct("_project").alias("unique_projects")
    return _with_rate(K.by_grains(reduced, grains, [*_totals(), unique])).withColumn(
        "total_files", F.when(F.col("source_file").isNotNull(), F.lit(1).cast("bigint"))
    )


def scan_types(activity: DataFrame) -> DataFrame:
    """Scans per type and status, by name regardless of case."""
    totals = K.roll_up(K.not_null(activity, "scanType"), ["scanType"], "rows", "scans")
    long = K.unpivot_status(totals, ["scanType"], ["scans"])
    return long.orderBy("status", F.upper("scanType"), "scanType")


def scan_types_by_grain(activity: DataFrame, grains: Sequence[str] = tuple(K.GRAINS)) -> DataFrame:
    keys = [*K.finest_keys(grains), "scanType"]
    reduced = K.roll_up(K.deal_out(K.not_null(activity, "scanType"), keys), keys, "rows", "scans")
    wide = K.by_grains(reduced, grains, K.sums("rows", "scans"), also_by=["scanType"])
    return K.unpivot_status(wide, ["grain", "source_file", "year", "projectName", "scanType"], ["scans"])


def scan_type_rows(activity: DataFrame) -> DataFrame:
    """Log rows (not scans) per type."""
    counted = K.not_null(activity, "scanType").groupBy("scanType").agg(F.sum("rows_all").alias("rows"))
    return counted.orderBy(F.upper("scanType"), "scanType")


def state_distribution(rows: DataFrame) -> DataFrame:
    """Log rows per state as written. Needs rows, not a cube."""
    return K.not_null(rows, "state").groupBy("state").agg(F.sum("rows_all").alias("rows"))


def project_summary(rows: DataFrame) -> DataFrame:
    """Scans, total size and named code locations per project. Needs rows, not a cube."""
    return K.not_null(rows, "projectName").groupBy("projectName").agg(
        F.sum("scans_all").alias("scanCount"),
        F.sum("size_all").alias("totalScanSize"),
        F.count("codeLocationName").alias("codeLocationName"),
    )


def _list_entry(name: str, value: Column, owner: Column | None = None) -> Column:
    owner = F.lit("") if owner is None else owner
    return F.struct(F.lit(name).alias("list"), owner.alias("owner"), value.alias("value"))


def distinct_lists(activity: DataFrame, everything: DataFrame | None = None) -> DataFrame:
    """The values a report offers for selection: years, dates, projects and files, and per file the
    years and projects. ``owner`` is the file a list belongs to, empty for the overall lists.

    Files and their lists come from ``everything`` if that is given: a year range does not shorten them.
    """
    if everything is not None:
        of_files = F.col("list").isin("files", "file_years", "file_projects")
        return distinct_lists(activity).where(~of_files).unionByName(distinct_lists(everything).where(of_files))
    reduced = activity.groupBy("source_file", "year", "scan_date", "projectName").agg(F.first(F.lit(1)).alias("_one"))
    year = F.col("year").cast("string")
    entries = F.array(
        _list_entry("years", year),
        _list_entry("dates", F.col("scan_date").cast("string")),
        _list_entry("projects", F.col("projectName")),
        _list_entry("files", F.col("source_file")),
        _list_entry("file_years", year, F.col("source_file")),
        _list_entry("file_projects", F.col("projectName"), F.col("source_file")),
    )
    return reduced.select(F.inline(entries)).where(F.col("value").isNotNull()).distinct()


def available_dates(activity: DataFrame) -> DataFrame:
    return K.not_null(activity, "scan_date").select("scan_date").distinct().orderBy(F.desc("scan_date"))
