"""One query per metric, over the mapped views of ``sources.views``."""

from __future__ import annotations

import functools
import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlytics.functions import columns as C
from scanlytics.functions.enrich import enrich, quality_counts
from scanlytics.operators import cube as K
from scanlytics.operators.filters import (
    filter_projects,
    filter_years,
    project_retention,
    retention,
    slice_metrics,
    slice_of,
)
from scanlytics.operators.groups import projects_in_group
from scanlytics.operators.name_index import build_name_index, search_names
from scanlytics.operators.ranking import stride_sample
from scanlytics.plans import blocks, capacity, profile, project_bitmaps, rankings, scan_report, series, totals
from scanlytics.session import scratch_path
from scanlytics.sinks import document
from scanlytics.sinks import tables as S
from scanlytics.sources import views as V
from scanlytics.sources.archives import entry_files, read_archives, unpack_archives
from scanlytics.sources.csv_files import read_csv_files
from scanlytics.sources.group_tree import read_group_tree
from scanlytics.sources.incremental import read_snapshot, read_snapshot_cube, refresh
from scanlytics.sources.landing import land, read_landed
from scanlytics.sources.remote import create_file, create_folder, ship_code

CAPACITY, EVENT_CAPACITY = 60, 10
MIN_SCANS, MAX_PROJECTS = 10, 1000
POINTS, SPH_POINTS = 100, 500
GROUP = "AMERICA"
YEARS = (1997, 1998)
PATTERNS = ["7", "#0", "ER#", "omer#00000001", "customer#000000010 is not forty letters long"]
_BLOCK_GRAINS = ["global", "year", "file", "file_year", "file_project", "file_year_project"]
_ROWS_PER_ARCHIVE = 20_000
_ROWS_PER_STORED_ARCHIVE = 400

Query = Callable[[SparkSession, str], DataFrame]


def flat(df: DataFrame) -> DataFrame:
    """Plain output columns: hours as ISO text, dates and years as text, whole numbers as bigint."""
    out = []
    for field in df.schema:
        col = F.col(field.name)
        kind = field.dataType.simpleString()
        if kind == "timestamp_ntz":
            col = C.iso_hour(col)
        elif kind == "date" or field.name == "year":
            col = col.cast("string")
        elif kind in ("tinyint", "smallint", "int"):
            col = col.cast("bigint")
        out.append(col.alias(field.name))
    return df.select(*out)


def _events(metric: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: flat(metric(V.event_activity(spark, folder)))


def _numbered_events(metric: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: flat(metric(V.numbered_event_activity(spark, folder)))


def _orders(metric: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: flat(metric(V.order_activity(spark, folder)))


def _top(*by: str, k: int = rankings.TOP) -> Callable[[DataFrame], DataFrame]:
    return lambda a: rankings.top_projects(a, by, k)


def _projects_series(metric, by, statuses) -> Callable[[DataFrame], DataFrame]:
    def run(a: DataFrame) -> DataFrame:
        return metric(a, by, statuses).drop("size")

    return run


def _eligible_series(a: DataFrame) -> DataFrame:
    chosen = rankings.eligible_projects(a, MIN_SCANS, MAX_PROJECTS)
    return series.hourly_series(a, ["projectName"], projects=chosen).drop("size")


def _year_retention(a: DataFrame) -> DataFrame:
    return retention(a, F.col("year").between(*YEARS), by="source_file")


def _filtered_years(a: DataFrame) -> DataFrame:
    return totals.totals_by_grain(filter_years(a, *YEARS), ["global", "year", "file"])


def group_closure(spark: SparkSession, folder: str) -> DataFrame:
    return projects_in_group(V.group_tree(spark, folder), GROUP)


def group_filtered_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of one project group. The rows are folded to (file, year, project) before the semi join."""
    projects = projects_in_group(V.group_tree(spark, folder), GROUP)
    reduced = K.roll_up(V.order_activity(spark, folder), ["source_file", "year", "projectName"], "rows", "scans")
    return flat(totals.totals_by_grain(filter_projects(reduced, projects), ["global", "year"]))


def group_retention(spark: SparkSession, folder: str) -> DataFrame:
    projects = projects_in_group(V.group_tree(spark, folder), GROUP)
    return project_retention(V.order_activity(spark, folder), projects)


def safe_group_names(spark: SparkSession, folder: str) -> DataFrame:
    tree = V.group_tree(spark, folder)
    return tree.select("name", C.safe_name(F.col("name")).alias("safe_name")).distinct()


def _breakdown(a: DataFrame) -> DataFrame:
    exploded = scan_report.type_breakdown(a).select("projectName", F.posexplode("breakdown").alias("position", "entry"))
    return exploded.select("projectName", "position", "entry.scanType", "entry.scans")


def _searched_totals(a: DataFrame) -> DataFrame:
    daily = scan_report.daily_counts(a)
    return scan_report.project_totals(daily, search="er#00000001", start="1996-06-01", end="1999-12-31")


def _page(a: DataFrame) -> DataFrame:
    view = scan_report.project_totals(scan_report.daily_counts(a), scan_type="SNIPPET")
    return scan_report.sort_and_page(view, "count", True, number=2, size=20)


def _type_view(a: DataFrame) -> DataFrame:
    daily = scan_report.daily_counts(a)
    return scan_report.per_type_view(daily, "SIGNATURE", start="1997-01-01", end="1997-12-31")


def _profile_files(rows: DataFrame) -> DataFrame:
    return profile.file_profile(rows).withColumn("columns", F.concat_ws(",", "columns")).drop("dtypes")


def _numeric(rows: DataFrame) -> DataFrame:
    # engines sum squares in different orders, so only the deviation is rounded
    value = F.when(F.col("stat") == "std", F.round("value", 4)).otherwise(F.col("value"))
    return profile.numeric_stats(rows).withColumn("value", value)


def _flagged_report(a: DataFrame) -> DataFrame:
    entry = lambda e: F.concat_ws("=", e["project"], e["scans"].cast("string"))
    listed = F.array_join(F.transform("projects", entry), ";")
    return capacity.flagged_report(a, CAPACITY).withColumn("projects", listed)


def _archives(rows: DataFrame, size: int = _ROWS_PER_ARCHIVE, to: str | None = None) -> DataFrame:
    """The rows as ZIP archives of at most ``size`` rows, one CSV per source file, headers padded; in the folder
    ``to``, if that is given."""
    names = ["hour", *[c for c in V.VIEW_COLUMNS if c not in ("hour_ts", "source_file")]]

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            frame = frame.sort_values("codeLocationId")
            log = frame[names].set_axis([f" {c} " for c in names], axis=1)
            for entry, at in sorted(frame.groupby("source_file").indices.items()):
                archive.writestr(f"logs/{entry}", log.take(at).to_csv(index=False))
        name, content = f"archive-{key[0]}.zip", buffer.getvalue()
        if to is not None:
            with create_file(f"{to}/{name}") as file:
                file.write(content)
            content = b""
        return pd.DataFrame({"path": [name], "content": [content]})

    ship_code()
    number = C.integer_div(F.col("codeLocationId"), F.lit(size))
    numbered = rows.withColumns({"hour": C.iso_hour(F.col("hour_ts")), "_archive": number}).drop("hour_ts")
    return numbered.groupBy("_archive").applyInPandas(pack, "path string, content binary")


def _store_archives(rows: DataFrame, path: str) -> None:
    create_folder(path)
    _archives(rows, _ROWS_PER_STORED_ARCHIVE, path).select("path").write.format("noop").mode("overwrite").save()


def zip_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    raw = unpack_archives(_archives(V.event_rows(spark, folder)))
    columns = [c for c in V.VIEW_COLUMNS if c not in ("source_file", "codeLocationId")]
    return flat(
        enrich(raw).select(
            F.regexp_replace("source_file", "^logs/", "").alias("source_file"),
            C.whole_number(F.col("codeLocationId")).alias("codeLocationId"),
            *columns,
        )
    )


def zip_storage_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The events as many archives with equal entry names in the shared folder, read by the archive reader: totals by
    file, and the first row of each file."""
    path = scratch_path(spark, "archives")
    _store_archives(V.event_rows(spark, folder), path)
    a = enrich(read_archives(spark, path)).withColumn("codeLocationId", C.whole_number(F.col("codeLocationId")))
    return flat(
        a.groupBy("source_file").agg(
            F.sum("rows_all").alias("total_rows"),
            F.sum("scans_all").alias("total_scans"),
            F.max("row_no").alias("last_row"),
            F.min_by("codeLocationId", "row_no").alias("first_location"),
        )
    )


def csv_storage_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The events as CSV files without scan types in the shared folder, read by the CSV reader."""
    path = scratch_path(spark, "csv")
    rows = V.event_rows(spark, folder).withColumn("hour", C.iso_hour(F.col("hour_ts")))
    rows.select("hour", "projectName", "codeLocationId", "state", "scanCount").write.option("header", True).csv(path)
    a = enrich(read_csv_files(spark, path))
    return flat(a.groupBy("scanType", "projectName").agg(F.sum("rows_success").alias("won"), F.sum("scans_all").alias("scans")))


def bare_log_report(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts of a log that has projects only: unknown dates and types, one scan per row."""
    path = scratch_path(spark, "bare")
    V.event_rows(spark, folder).select("projectName", "codeLocationName").write.option("header", True).csv(path)
    return flat(scan_report.daily_counts(enrich(read_csv_files(spark, path))))


def stored_group_closure(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "tree")
    V.group_tree(spark, folder).write.json(path)
    return projects_in_group(read_group_tree(spark, path, "json"), GROUP)


def zip_incremental_landing(spark: SparkSession, folder: str) -> DataFrame:
    """Three in four archives land; then one of them is replaced by half its rows, the others arrive, and the snapshot
    is brought up to date: totals by file from its rows, and the same from its cube of deltas."""
    archives, snapshot = scratch_path(spark, "archives"), scratch_path(spark, "snapshot")
    rows = V.event_rows(spark, folder)
    number = C.integer_div(F.col("codeLocationId"), F.lit(_ROWS_PER_STORED_ARCHIVE))
    _store_archives(rows.where(number % 4 != 3), archives)
    refresh(spark, archives, snapshot)
    _store_archives(rows.where((number % 4 == 3) | ((number == 0) & (F.col("codeLocationId") % 2 == 0))), archives)
    refresh(spark, archives, snapshot)

    def sums(activity, prefix):
        kinds = {"rows": "rows_all", "scans": "scans_all", "size": "size_failed"}
        return activity.groupBy("source_file").agg(*[F.sum(m).alias(f"{prefix}_{k}") for k, m in kinds.items()])

    landed, cube = read_snapshot(spark, snapshot), read_snapshot_cube(spark, snapshot)
    return flat(sums(landed, "landed").join(sums(cube, "cube"), "source_file", "full"))


def unique_projects_slice(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct projects of two files in a year range, whole and by year, from stored bitmaps alone."""
    path = scratch_path(spark, "bitmaps")
    project_bitmaps.land_bitmaps(V.order_activity(spark, folder), path)
    stored = project_bitmaps.read_bitmaps(spark, path)
    sliced = project_bitmaps.slice_bitmaps(stored, files=["america.csv", "asia.csv"], start_year=1994, end_year=1996)
    whole = project_bitmaps.unique_projects(sliced).withColumn("year", F.lit(None).cast("int"))
    return flat(whole.unionByName(project_bitmaps.unique_projects(sliced, ["year"])))


def unique_projects_by_grain(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct projects of every file, of every file and year and overall, from stored bitmaps."""
    path = scratch_path(spark, "bitmaps")
    project_bitmaps.land_bitmaps(V.event_activity(spark, folder), path)
    stored = project_bitmaps.read_bitmaps(spark, path)
    missing = {"source_file": F.lit(None).cast("string"), "year": F.lit(None).cast("int")}
    parts = [project_bitmaps.unique_projects(stored, by).withColumns({k: v for k, v in missing.items() if k not in by}) for by in ([], ["source_file"], ["source_file", "year"])]
    return flat(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def zip_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_counts(unpack_archives(_archives(V.event_rows(spark, folder))))


def landed_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "landed")
    land(V.order_activity(spark, folder), path)
    return flat(totals.totals_by_grain(filter_years(read_landed(spark, path), *YEARS), ["year", "file_year"]))


def series_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "series")
    yearly = series.hourly_series(V.order_activity(spark, folder), ["year"])
    named = yearly.withColumns({"grain": F.lit("year"), "metric": F.lit("series")})
    S.write_series(named, path)
    return flat(spark.read.parquet(path).where("grain = 'year' and metric = 'series'"))


def export_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "export")
    S.write_csv(scan_report.report_records(V.order_activity(spark, folder)), path, compress=True)
    schema = "projectName string, scanType string, scan_date string, scans bigint, breakdown string"
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def _slice(a: DataFrame) -> DataFrame:
    return slice_of(totals.scan_types_by_grain, a, file="america.csv", year=1997)


def stored_slice(spark: SparkSession, folder: str) -> DataFrame:
    """One slice of a table of all grains that is stored by grain."""
    path = scratch_path(spark, "totals")
    S.write_table(totals.totals_by_grain(V.order_activity(spark, folder)), path, ("grain",))
    return flat(slice_metrics(spark.read.parquet(path), file="america.csv", year=1997))


def _seek(a: DataFrame) -> DataFrame:
    """The third page of a view, reached from row to row."""
    view = scan_report.project_totals(scan_report.daily_counts(a), scan_type="SNIPPET")
    after = None
    for _ in range(2):
        rows = scan_report.sort_and_seek(view, "count", True, after, size=20).collect()
        after = rows[-1] if rows else after
    return scan_report.sort_and_seek(view, "count", True, after, size=20)


def searched_names(spark: SparkSession, folder: str) -> DataFrame:
    """Projects that contain a pattern of one, two, three, many and too many characters, from the stored index."""
    path = scratch_path(spark, "names")
    build_name_index(V.order_activity(spark, folder), path)
    found = [search_names(spark, path, p).select(F.lit(p).alias("pattern"), "projectName") for p in PATTERNS]
    return functools.reduce(DataFrame.unionByName, found)


def zip_empty_files(spark: SparkSession, folder: str) -> DataFrame:
    """Totals over many archives, one of which has a file without rows."""
    path = scratch_path(spark, "archives")
    _store_archives(V.event_rows(spark, folder), path)
    with create_file(f"{path}/empty.zip") as file, zipfile.ZipFile(file, "w") as archive:
        archive.writestr("nothing.csv", "hour,scanCount\n")
    return flat(totals.summary_totals(enrich(read_archives(spark, path)), entry_files(spark, path)))


def zip_log_types(spark: SparkSession, folder: str) -> DataFrame:
    return profile.log_types(unpack_archives(_archives(V.event_rows(spark, folder))))


def _documents(a: DataFrame) -> DataFrame:
    parts = {
        "totals": totals.totals_by_grain(a, ["global", "file", "project"]).drop("success_rate", "total_files"),
        "scan_types": totals.scan_types_by_grain(a, ["global", "file", "project"]),
    }
    return S.documents(parts)


def _section(name: str, metric: Callable[[DataFrame], DataFrame]) -> Query:
    def run(a: DataFrame) -> DataFrame:
        return document.entries(metric(a), name).withColumn("path", F.array_join("path", "/"))

    return _events(run)


def _flagged(a: DataFrame) -> DataFrame:
    return capacity.flagged_hours(a, EVENT_CAPACITY)


_SECTIONS = {
    "summary": totals.summary_totals,
    "top_projects_by_block": _top("time_block", k=rankings.TOP_PER_BLOCK),
    "top_projects_by_date": _top("scan_date"),
    "top_projects_by_type": _top("scanType"),
    "top_projects_by_type_date": _top("scanType", "scan_date"),
    "top_projects_by_year_block": _top("year", "time_block", k=rankings.TOP_PER_BLOCK),
    "scan_type_rows": totals.scan_type_rows,
    "states": totals.state_distribution,
    "project_summary": totals.project_summary,
    "lists": totals.distinct_lists,
    "file_lists": totals.distinct_lists,
    "file_profile": profile.file_profile,
    "file_top_values": profile.top_values,
    "sph_flagged_hours": _flagged,
}


def whole_document(spark: SparkSession, folder: str) -> DataFrame:
    """Two sections written as one document, read back as JSON."""
    path = scratch_path(spark, "document")
    a = V.event_activity(spark, folder)
    document.write_whole({"states": totals.state_distribution(a), "summary": totals.summary_totals(a)}, path)
    # a document of two small sections fits in a row
    files = spark.read.text(path, wholetext=True).select(F.struct("_metadata.file_name", "value").alias("file"))
    lines = files.agg(F.array_join(F.transform(F.array_sort(F.collect_list("file")), lambda f: f["value"]), "").alias("text"))
    schema = "summary struct<total_rows:bigint,total_scans:bigint>, states map<string,bigint>"
    back = lines.select(F.from_json("text", schema).alias("d")).select("d.*")
    return back.select("summary.total_rows", "summary.total_scans", F.explode_outer("states").alias("state", "rows"))


def _cube(a: DataFrame) -> DataFrame:
    return K.activity_cube(a)


def queries() -> dict[str, Query]:
    files = dict(by=["source_file"], statuses=["all"], measure="rows")
    return {
        # totals and distributions
        "summary_totals": _events(totals.summary_totals),
        "run_summary": _events(profile.run_summary),
        "totals_by_grain": _orders(totals.totals_by_grain),
        "scan_types_by_status": _events(totals.scan_types),
        "scan_types_by_grain": _orders(totals.scan_types_by_grain),
        "scan_type_rows": _events(totals.scan_type_rows),
        "state_distribution": _events(totals.state_distribution),
        "unique_projects_slice": unique_projects_slice,
        "unique_projects_by_grain": unique_projects_by_grain,
        "project_summary": _orders(totals.project_summary),
        "distinct_lists": _orders(totals.distinct_lists),
        "available_dates": _events(totals.available_dates),
        "activity_cube": _events(_cube),
        # time of day
        "time_blocks": _events(blocks.time_blocks),
        "time_blocks_scans": _events(lambda a: blocks.time_blocks(a, measure="scans")),
        "time_blocks_by_grain": _orders(lambda a: blocks.time_blocks(a, _BLOCK_GRAINS)),
        "busiest_quietest": _events(blocks.busiest_quietest),
        "busiest_quietest_by_grain": _orders(lambda a: blocks.busiest_quietest(a, _BLOCK_GRAINS)),
        # rankings
        "top_projects": _orders(_top()),
        "top_projects_by_year": _orders(_top("year")),
        "top_projects_by_file": _orders(_top("source_file")),
        "top_projects_by_file_year": _orders(_top("source_file", "year")),
        "top_projects_by_block": _events(_top("time_block", k=rankings.TOP_PER_BLOCK)),
        "top_projects_by_year_block": _orders(_top("year", "time_block", k=rankings.TOP_PER_BLOCK)),
        "top_projects_by_date": _events(_top("scan_date")),
        "top_projects_by_type": _orders(_top("scanType")),
        "top_projects_by_type_date": _events(_top("scanType", "scan_date")),
        "eligible_projects": _orders(lambda a: rankings.eligible_projects(a, MIN_SCANS, MAX_PROJECTS)),
        # series
        "series_hourly": _events(series.hourly_series),
        "series_by_year": _orders(lambda a: series.hourly_series(a, ["year"])),
        "series_by_project": _orders(_projects_series(series.hourly_series, ["projectName"], K.STATUSES)),
        "series_by_year_project": _orders(_projects_series(series.hourly_series, ["year", "projectName"], ["all"])),
        "series_by_file": _events(lambda a: series.hourly_series(a, **files)),
        "evolution_global": _orders(series.scan_type_evolution),
        "evolution_by_year": _orders(lambda a: series.scan_type_evolution(a, ["year"])),
        "evolution_by_project": _orders(_projects_series(series.scan_type_evolution, ["projectName"], K.STATUSES)),
        "evolution_by_year_project": _orders(
            _projects_series(series.scan_type_evolution, ["year", "projectName"], ["all"])
        ),
        "evolution_by_file": _events(lambda a: series.scan_type_evolution(a, **files)),
        "series_sampled": _orders(lambda a: stride_sample(series.hourly_series(a, ["year"]), ["year", "status"], POINTS)),
        "series_eligible_projects": _orders(_eligible_series),
        "daily_series": _orders(series.daily_series),
        "column_trends": _numbered_events(series.column_trends),
        # capacity
        "sph_hourly": _events(capacity.hourly_sph),
        "sph_summary": _events(lambda a: capacity.sph_summary(a, CAPACITY)),
        "sph_by_year": _orders(lambda a: capacity.sph_summary(a, CAPACITY, by_year=True)),
        "sph_flagged_hours": _orders(lambda a: capacity.flagged_hours(a, CAPACITY)),
        "sph_contributors": _events(lambda a: capacity.contributors(a, CAPACITY)),
        "sph_flagged_report": _events(_flagged_report),
        "sph_classified_hours": _orders(lambda a: capacity.display_series(a, CAPACITY)),
        "sph_display_series": _orders(lambda a: capacity.display_series(a, CAPACITY, points=SPH_POINTS)),
        # project-scan report
        "project_scans_daily": _orders(scan_report.daily_counts),
        "project_scans_breakdown": _orders(_breakdown),
        "project_scans_totals": _orders(_searched_totals),
        "project_scans_page": _orders(_page),
        "project_scans_seek": _orders(_seek),
        "project_scans_per_type": _orders(_type_view),
        "project_scans_date_range": _orders(scan_report.date_range),
        # file profile
        "profile_files": _events(_profile_files),
        "profile_preview": _numbered_events(profile.preview),
        "profile_numeric": _events(_numeric),
        "profile_top_values": _events(profile.top_values),
        # filters and groups
        "year_range": _orders(_filtered_years),
        "year_retention": _orders(_year_retention),
        "year_bounded_summary": _orders(lambda a: totals.summary_totals(filter_years(a, *YEARS), a)),
        "year_bounded_lists": _orders(lambda a: totals.distinct_lists(filter_years(a, *YEARS), a)),
        "group_closure": group_closure,
        "group_filtered_totals": group_filtered_totals,
        "group_retention": group_retention,
        "safe_group_names": safe_group_names,
        "slice_dashboard": _orders(_slice),
        "stored_slice": stored_slice,
        "searched_names": searched_names,
        # sources and sinks
        "zip_roundtrip": zip_roundtrip,
        "zip_quality": zip_quality,
        "zip_storage_roundtrip": zip_storage_roundtrip,
        "zip_empty_files": zip_empty_files,
        "zip_log_types": zip_log_types,
        "zip_incremental_landing": zip_incremental_landing,
        "csv_storage_roundtrip": csv_storage_roundtrip,
        "bare_log_report": bare_log_report,
        "stored_group_closure": stored_group_closure,
        "landed_roundtrip": landed_roundtrip,
        "series_sink": series_sink,
        "export_sink": export_sink,
        "analysis_documents": _events(_documents),
        **{f"document_{name}": _section(name, metric) for name, metric in _SECTIONS.items()},
        "whole_document": whole_document,
    }
