"""Small literal logs."""

from datetime import datetime

from scanlytics.functions.enrich import enrich

SCHEMA = (
    "source_file string, hour_ts timestamp_ntz, codeLocationName string, versionName string, projectName string, "
    "scanCount bigint, scanType string, totalScanSize bigint, state string"
)


def row(file="a.csv", hour="2024-01-01 00", project="p", scans=1, kind="SIGNATURE", state="COMPLETED",
        size=10, version="v1", location="loc"):
    ts = datetime.strptime(hour, "%Y-%m-%d %H") if hour else None
    return (file, ts, location, version, project, scans, kind, size, state)


def activity(spark, rows):
    return enrich(spark.createDataFrame(rows, SCHEMA))


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
