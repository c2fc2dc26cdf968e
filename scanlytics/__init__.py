"""Scan-activity analytics on Spark DataFrames.

Typical use::

    from scanlytics import read_archives, enrich, analyse

    activity = enrich(read_archives(spark, "s3://bucket/exports/*.zip"))
    tables = analyse(activity)          # dict of lazy DataFrames
    tables["top_projects"].show()
"""

from scanlytics.functions.enrich import enrich, quality_counts
from scanlytics.operators.cube import activity_cube
from scanlytics.operators.filters import filter_projects, filter_years, project_retention, retention, slice_metrics
from scanlytics.operators.groups import projects_in_group
from scanlytics.plans.report import ReportOptions, analyse, chart_series, write_report
from scanlytics.plans.scan_report import project_scan_report
from scanlytics.sources.archives import read_archives
from scanlytics.sources.csv_files import read_csv_files
from scanlytics.sources.group_tree import read_group_tree
from scanlytics.sources.landing import land, read_landed

__version__ = "0.1.0"

__all__ = [
    "ReportOptions",
    "activity_cube",
    "analyse",
    "chart_series",
    "enrich",
    "filter_projects",
    "filter_years",
    "land",
    "project_retention",
    "project_scan_report",
    "projects_in_group",
    "quality_counts",
    "read_archives",
    "read_csv_files",
    "read_group_tree",
    "read_landed",
    "retention",
    "slice_metrics",
    "write_report",
]
