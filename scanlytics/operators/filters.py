"""Row filters and slices of the long result tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlytics.functions import columns as C

# With a number from 0 to 63 behind it stands for the project of a row whose file has no project column; no name
# contains a line break.
_PARTS = 64
_NO_COLUMN = "\n(no project column)"


def filter_years(df: DataFrame, start_year: int | None = None, end_year: int | None = None) -> DataFrame:
    """Inclusive year range; rows without an hour go only when a bound is given.

    Stated on ``hour_ts`` so that a Parquet scan can skip row groups, and on ``year`` so that a landed
    snapshot reads the wanted partitions only.
    """
    if start_year is not None:
        first = F.make_timestamp_ntz(F.lit(start_year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        df = df.where((F.col("hour_ts") >= first) & (F.col("year") >= start_year))
    if end_year is not None:
        after = F.make_timestamp_ntz(F.lit(end_year + 1), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        df = df.where((F.col("hour_ts") < after) & (F.col("year") <= end_year))
    return df


def _keyed(df: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows and the wanted projects under a common ``_key``, with files lacking a project column in.

    Those rows have no project to join on; they are dealt out over many keys, so that none is hot.
    """
    wanted = projects.select(F.col("projectName").alias("_key")).where(F.col("_key").isNotNull())
    key = F.col("projectName")
    if "has_project_column" in df.columns:
        spread = [c for c in ("source_file", "hour_ts", "scanType", "codeLocationId") if c in df.columns]
        part = F.pmod(F.xxhash64(F.lit(0), *spread), F.lit(_PARTS)).cast("string")
        key = F.when(F.col("has_project_column"), key).otherwise(F.concat(F.lit(_NO_COLUMN), part))
        parts = F.array(*[F.lit(f"{_NO_COLUMN}{i}") for i in range(_PARTS)])
        wanted = wanted.unionByName(wanted.limit(1).select(F.explode(parts).alias("_key")))
    return df.withColumn("_key", key), wanted


def filter_projects(df: DataFrame, projects: DataFrame) -> DataFrame:
    """Keep rows whose projectName is in ``projects`` (column ``projectName``).

    Rows of a file that has no project column stay, unless the project set is empty. Works on rows and on
    a cube alike; on large data filter the cube: Spark moves the semi join below the aggregate while it
    can broadcast the set, and otherwise joins the aggregated rows by shuffle.
    """
    keyed, wanted = _keyed(df, projects)
    return keyed.join(wanted, "_key", "left_semi").drop("_key")


def project_retention(activity: DataFrame, projects: DataFrame) -> DataFrame:
    """Log rows before and after ``filter_projects``, and the share kept; one pass over the rows."""
    keyed, wanted = _keyed(activity, projects)
    per_key = keyed.groupBy("_key").agg(F.sum("rows_all").alias("_rows"))
    marked = per_key.join(wanted.distinct().withColumn("_kept", F.lit(True)), "_key", "left")
    counted = marked.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum(F.when(F.col("_kept"), F.col("_rows"))), F.lit(0)).alias("rows_after"),
    )
    return counted.withColumn("kept_pct", C.percent(F.col("rows_after"), F.col("rows_before")))


def retention(df: DataFrame, kept: Column, by: str | None = None) -> DataFrame:
    """Rows before and after a filter, and the share kept."""
    counts = [F.count(F.lit(1)).alias("rows_before"), F.count_if(kept).alias("rows_after")]
    counted = df.groupBy(by).agg(*counts) if by else df.agg(*counts)
    return counted.withColumn("kept_pct", C.percent(F.col("rows_after"), F.col("rows_before")))


def slice_metrics(
    table: DataFrame, file: str | None = None, year: int | None = None, project: str | None = None
) -> DataFrame:
    """The dashboard view of a table by grain: exactly the rows of the chosen file / year / project."""
    chosen = [n for n, v in (("file", file), ("year", year), ("project", project)) if v is not None]
    table = table.where(F.col("grain") == ("_".join(chosen) or "global"))
    if file is not None:
        table = table.where(F.col("source_file") == file)
    if year is not None:
        table = table.where(F.col("year") == year)
    if project is not None:
        table = table.where(F.col("projectName") == project)
    return table


def slice_of(
    metric: Callable[..., DataFrame],
    activity: DataFrame,
    file: str | None = None,
    year: int | None = None,
    project: str | None = None,
) -> DataFrame:
    """What ``slice_metrics`` gives for a ``metric`` that takes rows and grains (``totals_by_grain`` and the like), from
    the slice alone: the choice filters the rows, and the one grain is computed."""
    chosen = {"file": ("source_file", file), "year": ("year", year), "project": ("projectName", project)}
    given = {name: pair for name, pair in chosen.items() if pair[1] is not None}
    for column, value in given.values():
        activity = activity.where(F.col(column) == value)
    return metric(activity, ["_".join(given) or "global"])


def search_projects(df: DataFrame, text: str | None) -> DataFrame:
    """Case-insensitive substring match on the project name."""
    return df if not text else df.where(F.contains(F.lower("projectName"), F.lit(text.lower())))


def filter_scan_type(df: DataFrame, scan_type: str | None) -> DataFrame:
    """One scan type; None means all."""
    return df if scan_type is None else df.where(F.col("scanType") == scan_type)


def filter_dates(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive ISO dates on scan_date; a date that is unknown is in no range."""
    date = F.col("scan_date").try_cast("date")
    if start is not None:
        df = df.where(date >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(date <= F.lit(end).cast("date"))
    return df


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows; plans as a top-k, not as a full sort."""
    return df.orderBy(*order).offset(number * size).limit(size)


def page_after(df: DataFrame, order: Sequence[tuple[str, bool]], after: Sequence | None, size: int) -> DataFrame:
    """The ``size`` rows that follow ``after``, the order columns' values in the last row of the page before (None: the
    first page). ``order`` has names and whether they fall; together they must tell rows apart.

    A filter takes the place of an offset: each task keeps ``size`` rows however far the page is, and on a table sorted
    that way the scan skips what lies before. Nulls come first rising and last falling, as Spark sorts them.
    """
    if after is not None:
        behind, equal = F.lit(False), F.lit(True)
        for (name, falling), value in zip(order, after, strict=True):
            column = F.col(name)
            if value is None:
                beyond = F.lit(False) if falling else column.isNotNull()
            else:
                beyond = (column < value) | column.isNull() if falling else column > value
            behind, equal = behind | (equal & beyond), equal & column.eqNullSafe(value)
        df = df.where(behind)
    return df.orderBy(*[F.desc(n) if falling else F.asc(n) for n, falling in order]).limit(size)
