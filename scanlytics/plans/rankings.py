"""Top projects by scans, overall and within years, files, dates, blocks and scan types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlytics.functions import columns as C
from scanlytics.operators import cube as K
from scanlytics.operators.ranking import top_k

TOP = 15
TOP_PER_BLOCK = 10


def top_projects(activity: DataFrame, by: Sequence[str] = (), k: int = TOP) -> DataFrame:
    """``by, status, rank, projectName, scans``; equal scans rank by name.

    Any of source_file, year, scan_date, scanType and time_block may be in ``by``.
    """
    if "time_block" in by:
        activity = K.not_null(activity, "hour_ts")
        activity = activity.withColumn("time_block", C.block_name(C.block_start(F.col("hour_ts"))))
    keys = [*by, "projectName"]
    totals = K.roll_up(K.not_null(activity, *keys), keys, "rows", "scans")
    long = K.unpivot_status(totals, keys, ["scans"])
    ranked = top_k(long, [*by, "status"], [F.desc("scans"), F.asc("projectName")], k)
    return ranked.select(*by, "status", "rank", "projectName", "scans")


def eligible_projects(activity: DataFrame, min_scans: int = 0, max_projects: int | None = None) -> DataFrame:
    """Projects with at least ``min_scans`` scans, the ``max_projects`` largest of them if that is given, equal
    scans by name. Without arguments all projects."""
    totals = K.not_null(activity, "projectName").groupBy("projectName").agg(F.sum("scans_all").alias("scans"))
    chosen = totals.where(F.col("scans") >= min_scans)
    if max_projects is not None:
        chosen = chosen.orderBy(F.desc("scans"), "projectName").limit(max_projects)
    return chosen
