"""Scans per hour (SPH) against a licensed capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanlytics.functions import columns as C
from scanlytics.operators.ranking import stride_sample, top_k

# Fixed values.
CONTRIBUTORS = 10
HEADLINE = 3
WARNING_PCT = 80


def thresholds(capacity: int | None, warning_pct: int = WARNING_PCT) -> tuple[int | None, int | None]:
    """(warning threshold, lowest flagged SPH). There is no warning zone unless it lies below capacity."""
    if capacity is None:
        return None, None
    warning = int(capacity * warning_pct / 100)
    return (warning, warning) if warning < capacity else (None, capacity)


def hourly_sph(activity: DataFrame) -> DataFrame:
    hours = activity.where(F.col("hour_ts").isNotNull())
    return hours.groupBy("hour_ts").agg(F.sum("scans_all").alias("sph"))


def sph_summary(
    activity: DataFrame, capacity: int | None = None, warning_pct: int = WARNING_PCT, by_year: bool = False
) -> DataFrame:
    """Capacity, thresholds, peak and the number of breach and warning hours; one row, or one per year."""
    warning, _ = thresholds(capacity, warning_pct)
    sph = F.col("sph")
    zero = F.lit(0).cast("bigint")
    breach = zero if capacity is None else F.count_if(sph >= capacity)
    warned = zero if warning is None else F.count_if((sph >= warning) & (sph < capacity))
    hourly = hourly_sph(activity)
    grouped = hourly.groupBy(F.year("hour_ts").alias("year")) if by_year else hourly.groupBy()
    out = grouped.agg(
        F.coalesce(F.max("sph"), zero).alias("peak_sph"),
        breach.alias("breach_count"),
        warned.alias("warning_count"),
    )
    limit = F.lit(capacity).cast("bigint")
    return out.withColumns(
        {
            "capacity_sph": limit,
            "warning_pct": F.lit(warning_pct).cast("bigint"),
            "warning_threshold": F.lit(warning).cast("bigint"),
            "peak_pct": C.percent(F.col("peak_sph"), limit),
        }
    )


def flagged_hours(activity: DataFrame, capacity: int | None, warning_pct: int = WARNING_PCT) -> DataFrame:
    """Hours at or over the threshold, worst first, with their share of snippet scans.

    The share is null in an hour without any snippet row.
    """
    hours = activity.where(F.col("hour_ts").isNotNull())
    snippet = C.is_snippet(F.col("scanType"))
    per_hour = hours.groupBy("hour_ts").agg(
        F.sum("scans_all").alias("sph"),
        F.sum(F.when(snippet, F.col("scans_all"))).alias("_snippet"),
    )
    flagged = _flag(per_hour, capacity, warning_pct)
    share = C.percent(F.col("_snippet"), F.col("sph"))
    return (
        flagged.withColumn("snippet_pct", share)
        .withColumn("snippet_severity", C.snippet_severity(F.col("snippet_pct")))
        .select("hour_ts", "sph", "pct", "status", "snippet_pct", "snippet_severity")
        .orderBy(F.desc("sph"), "hour_ts")
    )


def _flag(per_hour: DataFrame, capacity: int | None, warning_pct: int) -> DataFrame:
    if capacity is None:
        nothing = per_hour.where(F.lit(False))
        return nothing.withColumns({"pct": F.lit(None).cast("double"), "status": F.lit(None).cast("string")})
    _, lowest = thresholds(capacity, warning_pct)
    return per_hour.where(F.col("sph") >= lowest).withColumns(
        {
            "pct": C.percent(F.col("sph"), F.lit(capacity).cast("bigint")),
            "status": C.hour_class(F.col("sph"), capacity, lowest),
        }
    )


def contributors(
    activity: DataFrame, capacity: int | None, warning_pct: int = WARNING_PCT, k: int = CONTRIBUTORS
) -> DataFrame:
    """The largest contributors of each flagged hour, the number of all of them, and what the first three
    cover. Rows without a project count under their version, else as unknown.

    Ranking comes before the join with the flagged hours: the group limit cuts each hour to k rows per
    task ahead of the shuffle, so an hour that holds most of the data stays small.
    """
    label = (
        F.col("project_label")
        if "project_label" in activity.columns
        else C.project_label(F.col("projectName"), F.col("versionName"))
    )
    hours = activity.where(F.col("hour_ts").isNotNull())
    parts = hours.groupBy("hour_ts", label.alias("project")).agg(F.sum("scans_all").alias("scans"))
    per_hour = parts.groupBy("hour_ts").agg(
        F.sum("scans").alias("sph"), F.count(F.lit(1)).alias("total_project_count")
    )
    ranked = top_k(parts, ["hour_ts"], [F.desc("scans"), F.asc("project")], k)
    head = F.sum(F.when(F.col("rank") <= HEADLINE, F.col("scans"))).over(W.partitionBy("hour_ts"))
    return (
        ranked.withColumn("_head", head)
        .join(_flag(per_hour, capacity, warning_pct), "hour_ts")
        .withColumn("top3_pct", C.percent(F.col("_head"), F.col("sph")))
        .select("hour_ts", "rank", "project", "scans", "sph", "status", "total_project_count", "top3_pct")
    )


def display_series(
    activity: DataFrame, capacity: int | None = None, warning_pct: int = WARNING_PCT, points: int | None = None
) -> DataFrame:
    """Every hour with its class; with ``points``, about so many of them plus every flagged hour."""
    hourly = hourly_sph(activity)
    if capacity is None:
        shown = hourly if points is None else stride_sample(hourly, [], points)
        return shown.withColumn("class", F.lit("normal"))
    _, lowest = thresholds(capacity, warning_pct)
    shown = hourly if points is None else stride_sample(hourly, [], points, keep=F.col("sph") >= lowest)
    named = C.hour_class(F.col("sph"), capacity, lowest, normal="NORMAL")
    return shown.withColumn("class", F.lower(named))


def flagged_report(activity: DataFrame, capacity: int | None, warning_pct: int = WARNING_PCT) -> DataFrame:
    """One row per flagged hour with its largest contributors as an array and the scans of all others."""
    who = contributors(activity, capacity, warning_pct)
    entry = F.struct("rank", "project", "scans")
    listed = who.groupBy("hour_ts").agg(
        F.array_sort(F.collect_list(entry)).alias("projects"),
        (F.first("sph") - F.sum("scans")).alias("rest_scans"),
        F.first("total_project_count").alias("total_project_count"),
        F.first("top3_pct").alias("top3_pct"),
    )
    return flagged_hours(activity, capacity, warning_pct).join(listed, "hour_ts", "left")
