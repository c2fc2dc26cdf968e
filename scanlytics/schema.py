"""Row schema and fixed values of the scan-log format."""

from __future__ import annotations

from pyspark.sql import types as T

# States that count as a success or a failure, compared in upper case.
SUCCESS_STATES = ["COMPLETED", "SUCCESS", "COMPLETE"]
FAILURE_STATES = ["ERROR", "FAILED", "FAILURE", "CANCELLED"]

# The columns of a scan log.
LOG_COLUMNS = [
    "hour",
    "codeLocationId",
    "codeLocationName",
    "versionName",
    "projectName",
    "scanCount",
    "scanType",
    "totalScanSize",
    "maxScanSize",
    "state",
    "transitionReason",
]

# Field texts that pandas.read_csv takes for null by default.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Texts used where a log has no scan type, no date or no project.
UNKNOWN = "Unknown"
UNKNOWN_PROJECT = "(Unknown project)"

# Preview columns of a file profile.
PREVIEW_COLUMNS = ["projectName", "scanType", "state", "hour", "scanCount"]

# Measures whose raw values are charted per file, and numeric profile columns.
TREND_COLUMNS = ["scanCount", "totalScanSize", "maxScanSize"]
NUMERIC_COLUMNS = ["codeLocationId", *TREND_COLUMNS]

# A day has eight three-hour blocks; reports list them from 06:00 on.
BLOCK_HOURS = 3
BLOCK_STARTS = [(6 + BLOCK_HOURS * i) % 24 for i in range(24 // BLOCK_HOURS)]

STATUSES = ["all", "success", "failed"]


def block_end(start: int) -> int:
    return (start + BLOCK_HOURS) % 24


def block_label(start: int) -> str:
    return f"{start:02d}-{block_end(start):02d}"


# What a reader returns: every log column as text, plus where the row came from.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("row_no", T.LongType()),
        T.StructField("header", T.ArrayType(T.StringType())),
        *[T.StructField(c, T.StringType()) for c in LOG_COLUMNS],
    ]
)
