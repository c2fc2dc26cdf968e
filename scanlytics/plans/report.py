"""Whole runs: all analysis tables, all chart series, and a written report."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlytics.functions.columns import integer_div
from scanlytics.operators import cube as K
from scanlytics.operators.filters import filter_projects, filter_years
from scanlytics.operators.groups import projects_in_group
from scanlytics.operators.ranking import row_positions
from scanlytics.plans import blocks, capacity, profile, rankings, scan_report, series, totals
from scanlytics.sinks import tables as S
from scanlytics.sinks.document import write_whole
from scanlytics.sources.landing import land, land_cube, read_cube, read_landed

_FILE_GRAINS = [g for g in K.GRAINS if g.startswith("file")]
_OTHER_GRAINS = [g for g in K.GRAINS if not g.startswith("file")]
_BLOCK_GRAINS = ["global", "year"]
_KEYS = ["grain", "source_file", "year", "projectName"]
_ROWS_PER_BUCKET = 1 << 20
_CONCURRENT_JOBS = 6


@dataclass(frozen=True)
class ReportOptions:
    """What a run includes. ``simple`` leaves out everything that only serves slicing by file, year or
    project; ``skip_detailed`` leaves out the year-by-project series."""

    start_year: int | None = None
    end_year: int | None = None
    min_scans: int = 0
    max_projects: int | None = None
    skip_detailed: bool = False
    simple: bool = False
    capacity_sph: int | None = 120
    sph_warning_pct: int = capacity.WARNING_PCT
    compress: bool = False
    whole_document: bool = False


def _graded(df: DataFrame, grain: str) -> DataFrame:
    """Give a table the grain columns it lacks."""
    types = {"source_file": "string", "year": "int", "projectName": "string"}
    missing = {k: F.lit(None).cast(t) for k, t in types.items() if k not in df.columns}
    rest = [c for c in df.columns if c not in types]
    return df.withColumns({**missing, "grain": F.lit(grain)}).select(*_KEYS, *rest)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def analyse(
    rows: DataFrame,
    options: ReportOptions = ReportOptions(),
    cube: DataFrame | None = None,
    files: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All analysis tables, lazily. ``cube`` is a landed activity cube of the same rows, if there is one;
    all but four tables then never touch the rows again. ``files`` lists the files read (``source_file``), those
    without rows too.

    The year range applies to everything but the per-file tables and the profiles.
    """
    everything = rows if cube is None else cube
    kept = filter_years(everything, options.start_year, options.end_year)
    kept_rows = filter_years(rows, options.start_year, options.end_year)
    per_file = not options.simple
    grains = ["global"] if options.simple else _OTHER_GRAINS
    block_grains = ["global"] if options.simple else _BLOCK_GRAINS

    def both(metric, own_grains):
        parts = [metric(kept, own_grains)]
        if per_file:
            parts.append(metric(everything, _FILE_GRAINS))
        return _union(parts)

    def top(by):
        return rankings.top_projects(kept, by)

    def ranked(grain, by, source):
        # here projectName is what is ranked, not a grain key
        table = rankings.top_projects(source, by)
        missing = {k: F.lit(None).cast(t) for k, t in (("source_file", "string"), ("year", "int")) if k not in by}
        return table.withColumns({**missing, "grain": F.lit(grain)})

    tops = [ranked("global", [], kept)]
    if not options.simple:
        tops.append(ranked("year", ["year"], kept))
    if per_file:
        tops.append(ranked("file", ["source_file"], everything))
        tops.append(ranked("file_year", ["source_file", "year"], everything))

    out = {
        "summary": totals.summary_totals(kept, everything if files is None else files),
        "totals": both(totals.totals_by_grain, grains),
        "scan_types": both(totals.scan_types_by_grain, grains),
        "time_blocks": both(blocks.time_blocks, block_grains),
        "busiest_quietest": both(blocks.busiest_quietest, block_grains),
        "top_projects": _union(tops),
        "top_projects_by_block": rankings.top_projects(kept, ["time_block"], rankings.TOP_PER_BLOCK),
        "top_projects_by_date": top(["scan_date"]),
        "top_projects_by_type": top(["scanType"]),
        "top_projects_by_type_date": top(["scanType", "scan_date"]),
        "scan_type_rows": totals.scan_type_rows(kept),
        "states": totals.state_distribution(kept_rows),
        "project_summary": totals.project_summary(kept_rows),
        "lists": totals.distinct_lists(kept, everything),
        "file_profile": profile.file_profile(rows),
        "file_numeric_stats": profile.numeric_stats(rows),
        "file_top_values": profile.top_values(rows),
    }
    if "row_no" in rows.columns:
        out["file_preview"] = profile.preview(rows)
    if not options.simple:
        out["top_projects_by_year_block"] = rankings.top_projects(
            kept, ["year", "time_block"], rankings.TOP_PER_BLOCK
        )
    return out


def chart_series(
    rows: DataFrame,
    options: ReportOptions = ReportOptions(),
    cube: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All chart tables, lazily. The year range applies first, also to the choice of projects."""
    kept = filter_years(rows if cube is None else cube, options.start_year, options.end_year)
    out = {}

    def add(name, metric, table, grain):
        out[name] = _graded(table, grain).withColumn("metric", F.lit(metric))

    add("series_global", "series", series.hourly_series(kept), "global")
    add("evolution_global", "evolution", series.scan_type_evolution(kept), "global")
    if not options.simple:
        add("series_year", "series", series.hourly_series(kept, ["year"]), "year")
        add("evolution_year", "evolution", series.scan_type_evolution(kept, ["year"]), "year")
        chosen = None
        if options.min_scans > 0 or options.max_projects is not None:
            chosen = rankings.eligible_projects(kept, options.min_scans, options.max_projects)
        by = ["projectName"]
        add("series_project", "series", series.hourly_series(kept, by, projects=chosen).drop("size"), "project")
        add("evolution_project", "evolution", series.scan_type_evolution(kept, by, projects=chosen), "project")
        if not options.skip_detailed:
            by, only = ["year", "projectName"], ["all"]
            detail = series.hourly_series(kept, by, only, projects=chosen).drop("size")
            add("series_year_project", "series", detail, "year_project")
            detail = series.scan_type_evolution(kept, by, only, projects=chosen)
            add("evolution_year_project", "evolution", detail, "year_project")
        by, only = ["source_file"], ["all"]
        add("series_file", "series", series.hourly_series(kept, by, only, "rows"), "file")
        add("evolution_file", "evolution", series.scan_type_evolution(kept, by, only, "rows"), "file")
    if "row_no" in rows.columns:
        kept_rows = filter_years(rows, options.start_year, options.end_year)
        if options.start_year is not None or options.end_year is not None:
            # positions count the rows that are left
            place = integer_div(F.col("row_no"), F.lit(_ROWS_PER_BUCKET))
            kept_rows = row_positions(kept_rows, ["source_file"], "row_no", place, "_place")
            kept_rows = kept_rows.drop("row_no").withColumnRenamed("_place", "row_no")
        out["trends"] = series.column_trends(kept_rows)
    limit, pct = options.capacity_sph, options.sph_warning_pct
    out["sph_summary"] = capacity.sph_summary(kept, limit, pct)
    out["sph_flagged_hours"] = capacity.flagged_hours(kept, limit, pct)
    out["sph_contributors"] = capacity.contributors(kept, limit, pct)
    out["sph_series"] = capacity.display_series(kept, limit, pct)
    if not options.simple:
        out["sph_by_year"] = capacity.sph_summary(kept, limit, pct, by_year=True)
    return out


def _run_all(writes: list[Callable[[], None]]) -> None:
    """Submit independent jobs together, so that one's last tasks do not leave the cluster idle."""
    with ThreadPoolExecutor(_CONCURRENT_JOBS) as pool:
        for done in [pool.submit(write) for write in writes]:
            done.result()


def write_report(
    rows: DataFrame,
    folder: str,
    options: ReportOptions = ReportOptions(),
    tree: DataFrame | None = None,
    group: str | None = None,
    project_scans: bool = False,
    files: DataFrame | None = None,
) -> str:
    """Write a run below ``folder``: its rows and the activity cube first, then every table from them.

    Both are written tables, so the source is read once, whatever it takes to read it, and a lost executor repeats no
    work before them. State counts, project summary, profiles and trends come from the rows, all else from the cube.
    ``tree`` and ``group`` keep only the projects below a project group. With ``project_scans`` only the project-scan
    report is written, straight from the source. ``files`` lists the files read (``source_file``), so that those without
    rows count too (``sources.archives.entry_files``). Tables by grain are partitioned by it: a reader of one slice
    (``slice_metrics``) opens that grain's files alone.
    """
    folder = folder.rstrip("/")
    if group is not None:
        rows = filter_projects(rows, projects_in_group(tree, group))
    if not project_scans:
        land(rows, f"{folder}/rows")
        rows = read_landed(rows.sparkSession, f"{folder}/rows")
    land_cube(K.activity_cube(rows), f"{folder}/cube")
    cube = read_cube(rows.sparkSession, f"{folder}/cube")
    if project_scans:
        kept = filter_years(cube, options.start_year, options.end_year)
        for name, table in scan_report.project_scan_report(kept).items():
            S.write_csv(table, f"{folder}/project_scans/{name}", options.compress)
        return folder
    analysis = analyse(rows, options, cube, files)
    charts = chart_series(rows, options, cube)
    graded = [t for t in charts.values() if "metric" in t.columns]
    plain = {f"charts/{name}": t for name, t in charts.items() if "metric" not in t.columns}
    plain |= {f"analysis/{name}": t for name, t in analysis.items()}

    def table(name):
        by = ("grain",) if "grain" in plain[name].columns else ()
        return lambda: S.write_table(plain[name], f"{folder}/{name}", by)

    _run_all([lambda: S.write_series(_union(graded), f"{folder}/series"), *[table(name) for name in plain]])
    spark = rows.sparkSession
    written = {name: spark.read.parquet(f"{folder}/analysis/{name}") for name in analysis}
    S.write_documents(S.documents(written), f"{folder}/documents", options.compress)
    if options.whole_document:
        flagged = {"sph_flagged_hours": spark.read.parquet(f"{folder}/charts/sph_flagged_hours")}
        write_whole(written | flagged, f"{folder}/document", options.compress)
    return folder
