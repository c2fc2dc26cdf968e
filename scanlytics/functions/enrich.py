"""From rows as read to activity rows: types, defaults, classification and additive measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanlytics.functions import columns as C
from scanlytics.schema import UNKNOWN

_TEXT = ["codeLocationName", "versionName", "projectName", "state", "transitionReason"]
_SIZES = ["totalScanSize", "maxScanSize"]
#: Mark in a column's metadata: typed, and cut to the full hour.
_FULL_HOUR = {"scanlytics.full_hour": True}
#: Key in the metadata of ``rows_all``: how many rows there are, at most.
_ROWS = "scanlytics.rows"


def full_hour(hour: Column) -> Column:
    """``hour_ts``, cut to the full hour and marked so, for storing."""
    return C.floor_hour(hour).alias("hour_ts", metadata=_FULL_HOUR)


def is_full_hour(field: T.StructField) -> bool:
    return field.metadata.items() >= _FULL_HOUR.items() and isinstance(field.dataType, T.TimestampNTZType)


def sized(activity: DataFrame, rows: int) -> DataFrame:
    """Activity rows marked as ``rows`` rows at most, so that steps which spread them over tasks know how many they need."""
    return activity.withColumn("rows_all", F.col("rows_all").alias("rows_all", metadata={_ROWS: rows}))


def size_of(activity: DataFrame) -> int | None:
    """The mark of ``sized``; None without one. A roll-up has none."""
    return activity.schema["rows_all"].metadata.get(_ROWS)


def enrich(df: DataFrame, hour_formats: Sequence[str] = ()) -> DataFrame:
    """Add the columns every plan works on.

    Accepts reader output (text columns, ``header``), typed rows that carry ``hour_ts``, or a landed
    snapshot (``year`` present, left alone so that partition pruning still works).

    Hours are cut to the full hour, parsed and typed ones alike. A log row is one hour bucket by contract, so this
    changes nothing for conforming logs; it bounds every series to 24 points a day. Hours marked as cut (a landed
    snapshot's) are taken as they are, so that filters on them reach the scan.
    """
    names = set(df.columns)
    has_header = "header" in names

    def in_file(column: str):
        """Whether the row's own file has the column."""
        if column not in names:
            return F.lit(False)
        return F.array_contains("header", column) if has_header else F.lit(True)

    typed = {}
    if "hour_ts" in names:
        hour = F.col("hour_ts").cast("timestamp_ntz")
    elif "hour" in names:
        hour = C.parse_hour(F.col("hour"), hour_formats)
    else:
        hour = F.lit(None).cast("timestamp_ntz")
    if "hour_ts" not in names or not is_full_hour(df.schema["hour_ts"]):
        typed["hour_ts"] = C.floor_hour(hour)
    for name in _TEXT:
        if name not in names:
            typed[name] = F.lit(None).cast("string")
    for name in _SIZES:
        if name not in names:
            typed[name] = F.lit(None).cast("bigint")
        elif df.schema[name].dataType.simpleString() == "string":
            typed[name] = C.whole_number(F.col(name))
    scans = F.lit(1).cast("bigint")
    if "scanCount" in names:
        given = F.col("scanCount")
        if df.schema["scanCount"].dataType.simpleString() == "string":
            given = C.whole_number(given)
        scans = F.when(in_file("scanCount"), given).otherwise(scans) if has_header else given
    typed["scanCount"] = scans
    kind = F.lit(UNKNOWN)
    if "scanType" in names:
        kind = F.when(in_file("scanType"), F.col("scanType")).otherwise(kind) if has_header else F.col("scanType")
    typed["scanType"] = kind
    df = df.withColumns(typed)

    derived = {
        "is_success": C.is_success(F.col("state")),
        "is_failure": C.is_failure(F.col("state")),
        "scan_date": F.to_date("hour_ts"),
        "has_project_column": in_file("projectName"),
        "has_hour_column": F.col("hour_ts").isNotNull() | (in_file("hour") if has_header or "hour_ts" not in names else F.lit(True)),
    }
    if "year" not in names:
        derived["year"] = F.year("hour_ts")
    return with_measures(df.withColumns(derived))


def with_measures(df: DataFrame) -> DataFrame:
    """rows, scans and size for all / success / failed as plain columns.

    Activity rows and any roll-up of them then look alike, and every metric is a sum of these.
    """
    won, lost = F.col("is_success"), F.col("is_failure")
    scans = F.coalesce("scanCount", F.lit(0)).cast("bigint")
    size = F.coalesce("totalScanSize", F.lit(0)).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return df.withColumns(
        {
            "rows_all": F.lit(1).cast("bigint"),
            "rows_success": won.cast("bigint"),
            "rows_failed": lost.cast("bigint"),
            "scans_all": scans,
            "scans_success": F.when(won, scans).otherwise(zero),
            "scans_failed": F.when(lost, scans).otherwise(zero),
            "size_all": size,
            "size_success": F.when(won, size).otherwise(zero),
            "size_failed": F.when(lost, size).otherwise(zero),
        }
    )


def quality_counts(raw: DataFrame, hour_formats: Sequence[str] = ()) -> DataFrame:
    """Per file: rows, and rows whose hour or numbers are present but unreadable; a fraction is no whole number."""
    names = set(raw.columns)

    def bad(column, readable):
        if column not in names:
            return F.lit(0).cast("bigint")
        return F.count_if(F.col(column).isNotNull() & ~readable)

    return raw.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("total_rows"),
        bad("hour", C.parse_hour(F.col("hour"), hour_formats).isNotNull()).alias("bad_hour_rows"),
        bad("scanCount", C.is_whole(F.col("scanCount"))).alias("bad_scan_count_rows"),
        bad("totalScanSize", C.is_whole(F.col("totalScanSize"))).alias("bad_total_size_rows"),
        bad("maxScanSize", C.is_whole(F.col("maxScanSize"))).alias("bad_max_size_rows"),
    )
