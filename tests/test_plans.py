import pytest
from pyspark.sql import functions as F

from logs import activity, row, values
from scanlytics.functions.enrich import enrich, quality_counts
from scanlytics.operators import cube as K
from scanlytics.plans import blocks, capacity, profile, rankings, scan_report, series, totals


def test_summary(spark):
    a = activity(spark, [row(scans=2), row("b.csv", scans=3, state="FAILED"), row(project=None, scans=5, state=None)])
    got = totals.summary_totals(a).first().asDict()
    assert got == dict(total_files=2, unique_projects=1, total_rows=3, total_scans=10, successful_scans=2, failed_scans=3, success_rate=20.0)


def test_summary_of_nothing(spark):
    got = totals.summary_totals(activity(spark, [])).first()
    assert (got.total_files, got.total_rows, got.total_scans, got.success_rate) == (0, 0, 0, None)


def test_status_maps_hold_only_types_with_rows(spark):
    a = activity(spark, [row(kind="A", scans=0, state="FAILED"), row(kind="B", scans=2), row(kind=None, scans=9)])
    assert values(totals.scan_types(a), "scanType", "status", "scans") == [
        ("A", "all", 0), ("A", "failed", 0), ("B", "all", 2), ("B", "success", 2),
    ]


def test_scan_types_sort_without_case(spark):
    a = activity(spark, [row(kind=k) for k in ("b", "A", "C")])
    assert [r.scanType for r in totals.scan_types(a).where("status = 'all'").collect()] == ["A", "b", "C"]


def test_ties_on_the_cut_line(spark):
    a = activity(spark, [row(project="d", scans=5), row(project="b", scans=5), row(project="a", scans=9), row(project="c", scans=1)])
    got = rankings.top_projects(a, k=2).where("status = 'all'").orderBy("rank").collect()
    assert [r.projectName for r in got] == ["a", "b"]


def test_rankings_use_scans_everywhere(spark):
    a = activity(spark, [row(project="many", scans=1)] * 3 + [row(project="big", scans=9)])
    for by in ([], ["year"], ["time_block"], ["scan_date"], ["scanType"]):
        first = rankings.top_projects(a, by).where("status = 'all' and rank = 1").first()
        assert (first.projectName, first.scans) == ("big", 9)


def test_year_ranking_differs_from_global(spark):
    a = activity(spark, [row(hour="2023-01-01 00", project="x", scans=9), row(hour="2024-01-01 00", project="y", scans=5)])
    top = rankings.top_projects(a, ["year"]).where("status = 'all' and year = 2024").first()
    assert top.projectName == "y"


def test_blocks_and_ties(spark):
    hours = [0, 2, 3, 5, 6, 8, 9, 20, 21, 23, None]
    a = activity(spark, [row(hour=None if h is None else f"2024-01-01 {h:02d}") for h in hours])
    got = blocks.time_blocks(a).where("status = 'all'").orderBy("block_order").collect()
    assert [(r.time_block, r["count"]) for r in got] == [
        ("06-09", 2), ("09-12", 1), ("12-15", 0), ("15-18", 0), ("18-21", 1), ("21-00", 2), ("00-03", 2), ("03-06", 2),
    ]
    assert [r.percentage for r in got][:2] == [20.0, 10.0]
    peak = blocks.busiest_quietest(a).where("status = 'all'").first()
    assert (peak.busiest_hour, peak.busiest_hour_end, peak.busiest_count) == (0, 3, 2)
    assert (peak.quietest_hour, peak.quietest_hour_end, peak.quietest_count) == (9, 12, 1)
    assert blocks.time_blocks(a).where("status = 'failed'").count() == 0


def test_blocks_count_rows_or_scans(spark):
    a = activity(spark, [row(hour="2024-01-01 07", scans=9), row(hour="2024-01-01 10", scans=1), row(hour="2024-01-01 11", scans=1)])
    assert blocks.busiest_quietest(a).first().busiest_hour == 9
    assert blocks.busiest_quietest(a, measure="scans").first().busiest_hour == 6


def sph_log(spark):
    return activity(spark, [row(hour=f"2024-01-01 {i:02d}", scans=n) for i, n in enumerate([47, 48, 59, 60, 61])])


def test_capacity_classes(spark):
    a = sph_log(spark)
    got = capacity.sph_summary(a, 60).first()
    assert (got.peak_sph, got.warning_threshold, got.breach_count, got.warning_count, got.peak_pct) == (61, 48, 2, 2, 101.7)
    flagged = capacity.flagged_hours(a, 60).collect()
    assert [(r.sph, r.status) for r in flagged] == [(61, "BREACH"), (60, "BREACH"), (59, "WARNING"), (48, "WARNING")]
    assert flagged[1].pct == 100.0


def test_no_warning_zone_at_full_percent(spark):
    a = sph_log(spark)
    got = capacity.sph_summary(a, 60, 100).first()
    assert (got.warning_threshold, got.breach_count, got.warning_count) == (None, 2, 0)
    assert [r.sph for r in capacity.flagged_hours(a, 60, 100).collect()] == [61, 60]


def test_without_capacity_nothing_is_flagged(spark):
    a = sph_log(spark)
    got = capacity.sph_summary(a).first()
    assert (got.capacity_sph, got.peak_sph, got.breach_count, got.warning_count) == (None, 61, 0, 0)
    assert capacity.flagged_hours(a, None).count() == 0
    assert capacity.contributors(a, None).count() == 0
    assert capacity.display_series(a).count() == 5


def test_sph_sums_scans_not_rows(spark):
    a = activity(spark, [row(scans=7), row(scans=5)])
    assert capacity.hourly_sph(a).first().sph == 12


def test_contributors_account_for_every_scan(spark):
    a = activity(
        spark,
        [row(project=f"p{i:02d}", scans=i + 1) for i in range(12)]
        + [row(project=None, version="v9", scans=4), row(project=None, version=None, scans=3)],
    )
    everyone = capacity.contributors(a, 10, k=100)
    assert everyone.agg(F.sum("scans")).first()[0] == capacity.hourly_sph(a).first().sph
    assert {"v9", "(Unknown project)"} <= {r.project for r in everyone.collect()}
    top = capacity.contributors(a, 10).orderBy("rank").collect()
    assert len(top) == 10 and top[0].total_project_count == 14
    assert top[0].top3_pct == round(100 * (12 + 11 + 10) / 85, 1)


def test_snippet_share(spark):
    a = activity(
        spark,
        [
            row(hour="2024-01-01 00", scans=50, kind="SNIPPET"), row(hour="2024-01-01 00", scans=50, kind="snippet_scan"),
            row(hour="2024-01-01 00", scans=100), row(hour="2024-01-01 01", scans=70), row(hour="2024-01-01 01", scans=1, kind=None),
            row(hour="2024-01-01 02", scans=70), row(hour="2024-01-01 02", scans=0, kind="SNIPPET"),
        ],
    )
    got = {r.hour_ts.hour: (r.snippet_pct, r.snippet_severity) for r in capacity.flagged_hours(a, 60).collect()}
    assert got == {0: (50.0, "red"), 1: (None, "none"), 2: (0.0, "green")}


def test_display_series_has_every_flagged_hour(spark, folder):
    from scanlytics.sources.views import order_activity

    a = order_activity(spark, folder)
    flagged = capacity.flagged_hours(a, 60)
    shown = capacity.display_series(a, 60, points=500)
    assert flagged.count() > 0
    assert flagged.join(shown, "hour_ts", "left_anti").count() == 0


def test_flagged_report(spark):
    a = activity(spark, [row(project="x", scans=40), row(project="y", scans=30)])
    got = capacity.flagged_report(a, 60).first()
    assert [(e.project, e.scans) for e in got.projects] == [("x", 40), ("y", 30)]


def test_series_per_status(spark):
    a = activity(
        spark,
        [row(hour="2024-01-01 00", scans=2, size=7), row(hour="2024-01-01 00", scans=3, size=1, state="FAILED"), row(hour="2024-01-01 01", scans=4)],
    )
    got = values(series.hourly_series(a), "status", "count", "size")
    assert got == [("all", 4, 10), ("all", 5, 8), ("failed", 3, 1), ("success", 2, 7), ("success", 4, 10)]


def test_file_series_count_rows(spark):
    a = activity(spark, [row(scans=5), row(scans=6)])
    got = series.hourly_series(a, ["source_file"], ["all"], "rows")
    assert values(got, "count") == [(2,)]


def test_eligible_projects(spark):
    a = activity(spark, [row(project=p, scans=n) for p, n in [("a", 9), ("b", 10), ("d", 30), ("c", 30), ("e", 40)]])
    names = lambda **how: [r.projectName for r in rankings.eligible_projects(a, **how).collect()]
    assert sorted(names()) == ["a", "b", "c", "d", "e"]
    assert sorted(names(min_scans=10)) == ["b", "c", "d", "e"]
    assert names(max_projects=2) == ["e", "c"]
    assert names(min_scans=1000) == []


def test_daily_series(spark):
    a = activity(spark, [row(hour=h, scans=2) for h in ("2024-01-01 03", "2024-01-01 05", "2024-01-02 00", "2024-01-02 01")])
    got = series.daily_series(a).orderBy("hour_ts").collect()
    assert len(got) == 2 and got[0].hour_ts.hour == 3
    assert sum(r["count"] for r in got) == 8


def test_log_without_hours_has_an_unknown_date(spark):
    rows = spark.createDataFrame([("p", "3"), ("p", "4"), ("q", None)], "projectName string, scanCount string")
    a = enrich(rows.withColumn("source_file", F.lit("a.csv")))
    assert values(scan_report.daily_counts(a), "projectName", "scan_date", "scanType", "scans") == [("p", "Unknown", "Unknown", 7), ("q", "Unknown", "Unknown", 0)]
    assert scan_report.project_totals(scan_report.daily_counts(a), start="2024-01-01").count() == 0
    assert scan_report.daily_counts(K.activity_cube(a)).count() == 2


def test_typed_hours_are_floored(spark):
    minutes = spark.sql("SELECT 'a.csv' AS source_file, timestamp_ntz'2024-01-01 03:05:00' + make_dt_interval(0, 0, CAST(id AS INT)) AS hour_ts FROM range(5)")
    assert values(capacity.hourly_sph(enrich(minutes)), "sph") == [(5,)]


def test_run_tables_of_a_year_range(spark):
    a = activity(spark, [row("a.csv", "2023-01-01 00"), row("b.csv", "2024-01-01 00", project="q")])
    kept, files = a.where("year = 2024"), spark.createDataFrame([("a.csv",), ("b.csv",), ("empty.csv",)], "source_file string")
    assert totals.summary_totals(kept, files).first().total_files == 3
    lists = values(totals.distinct_lists(kept, a), "list", "owner", "value")
    assert ("file_years", "a.csv", "2023") in lists and ("years", "", "2023") not in lists and ("files", "", "a.csv") in lists
    assert values(totals.totals_by_grain(a, ["file", "year"]).where("grain = 'file'"), "total_files") == [(1,), (1,)]


def test_scan_report(spark):
    a = activity(
        spark,
        [
            row(project="Alpha", kind="A", scans=1, hour="2024-01-01 00"), row(project="Alpha", kind="B", scans=5, hour="2024-01-01 01"),
            row(project="Alpha", kind="C", scans=5, hour=None), row(project="beta", kind="A", scans=2, hour="2024-01-03 00"),
            row(project=None, scans=100), row(project="beta", kind=None, scans=50),
        ],
    )
    daily = scan_report.daily_counts(a)
    assert values(daily, "projectName", "scanType", "scans") == [("Alpha", "A", 1), ("Alpha", "B", 5), ("beta", "A", 2)]
    records = {(r.projectName, r.scanType): r.breakdown for r in scan_report.report_records(a).collect()}
    assert [tuple(e) for e in records["Alpha", "A"]] == [("B", 5), ("C", 5), ("A", 1)]
    assert [tuple(e) for e in records["beta", "A"]] == [("A", 2)]
    first, last = scan_report.date_range(a).first()
    assert (str(first), str(last)) == ("2024-01-01", "2024-01-03")
    assert values(scan_report.project_totals(daily), "projectName", "scans") == [("Alpha", 6), ("beta", 2)]
    assert values(scan_report.project_totals(daily, search="ALP"), "projectName") == [("Alpha",)]
    assert scan_report.filtered(daily, start="2024-01-02", end="2024-01-03").count() == 1
    assert scan_report.per_type_view(daily, "A").count() == 2
    ordered = scan_report.sort_and_page(daily, "project", False, 0, 2).collect()
    assert [(r.projectName, r.scanType) for r in ordered] == [("Alpha", "A"), ("Alpha", "B")]


def test_profile_types(spark):
    a = activity(spark, [row(), row(state=None)])
    got = profile.file_profile(a).first()
    assert got.rows == 2 and got.dtypes["scanCount"] == "bigint" and got.column_count == len(got["columns"])


def test_log_types(spark):
    rows = [("a", ["hour", "scanCount", "state", "scanType"], "1", " 3", "True", None), ("a", ["hour", "scanCount", "state", "scanType"], "x", "-4", "false", None)]
    rows += [("b", ["hour", "scanCount", "state"], "1.5", "3", "true", "gone"), ("b", ["hour", "scanCount", "state"], "2", None, None, "gone")]
    raw = spark.createDataFrame(rows, "source_file string, header array<string>, hour string, scanCount string, state string, scanType string")
    assert values(profile.log_types(raw), "source_file", "column", "log_type") == [
        ("a", "hour", "object"), ("a", "scanCount", "int64"), ("a", "scanType", "float64"), ("a", "state", "bool"),
        ("b", "hour", "float64"), ("b", "scanCount", "float64"), ("b", "state", "object"),
    ]


def test_top_values_ignore_null_and_break_ties(spark):
    a = activity(spark, [row(state=s) for s in ("b", "a", "c", "c", None)])
    got = profile.top_values(a, ["state"], 2).orderBy("rank").collect()
    assert [(r.value, r.rows) for r in got] == [("c", 2), ("a", 1)]


def test_preview_falls_back_to_first_columns(spark):
    df = spark.createDataFrame([("f", 0, "2024-01-01 00:00:00", "l", "p")], "source_file string, row_no bigint, hour string, codeLocationName string, projectName string")
    assert profile.preview(df).columns == ["source_file", "row_no", "hour", "codeLocationName", "projectName"]


def test_missing_columns_get_defaults(spark):
    raw = spark.createDataFrame(
        [(["hour", "projectName"], "2024-01-01 10:20:00", "p", None, None), (["hour", "scanCount", "scanType"], "bad", None, "3.0", None)],
        "header array<string>, hour string, projectName string, scanCount string, scanType string",
    )
    got = enrich(raw.withColumn("source_file", F.lit("f")))
    assert values(got.where("projectName = 'p'"), "scanCount", "scanType", "scans_all") == [(1, "Unknown", 1)]
    assert str(got.where("projectName = 'p'").first().hour_ts) == "2024-01-01 10:00:00"
    other = got.where("projectName is null").first()
    assert (other.scanCount, other.scanType, other.hour_ts, other.year) == (3, None, None, None)


def test_quality_counts(spark):
    raw = spark.createDataFrame([("f", "bad", "1"), ("f", "2024-01-01", "x"), ("f", None, None)], "source_file string, hour string, scanCount string")
    got = quality_counts(raw).first()
    assert (got.total_rows, got.bad_hour_rows, got.bad_scan_count_rows, got.bad_total_size_rows) == (3, 1, 1, 0)


@pytest.mark.parametrize(
    "metric",
    [
        totals.summary_totals, totals.totals_by_grain, totals.scan_types, totals.scan_types_by_grain, totals.scan_type_rows,
        totals.distinct_lists, blocks.time_blocks, blocks.busiest_quietest, rankings.top_projects, rankings.eligible_projects,
        series.hourly_series, series.scan_type_evolution, series.daily_series, scan_report.daily_counts,
        lambda a: rankings.top_projects(a, ["time_block"]),
        lambda a: capacity.sph_summary(a, 60), lambda a: capacity.flagged_hours(a, 60),
        lambda a: capacity.contributors(a, 60), lambda a: capacity.display_series(a, 60),
    ],
)
def test_cube_gives_what_rows_give(spark, folder, metric):
    from scanlytics.sources.views import event_activity

    a = event_activity(spark, folder)
    from_rows, from_cube = metric(a), metric(K.activity_cube(a))
    assert from_rows.columns == from_cube.columns
    assert from_rows.exceptAll(from_cube).isEmpty() and from_cube.exceptAll(from_rows).isEmpty()


def test_outcomes_add_up(spark, folder):
    from scanlytics.sources.views import event_activity

    a = event_activity(spark, folder)
    other = a.where(~F.col("is_success") & ~F.col("is_failure")).agg(F.sum("scanCount")).first()[0]
    got = totals.summary_totals(a).first()
    assert got.successful_scans + got.failed_scans + other == got.total_scans
    in_blocks = blocks.time_blocks(a).where("status = 'all'").agg(F.sum("count")).first()[0]
    assert in_blocks == got.total_rows


def test_project_bitmaps(spark):
    from scanlytics.plans import project_bitmaps as B

    a = activity(spark, [row(file=f, hour=f"{y}-01-01 00", project=f"p{i}") for f, y, n in (("a", 2021, 5), ("b", 2021, 8), ("b", 2022, 3)) for i in range(n)] + [row(file="c", project=None), row(file="c", hour=None, project="q")])
    dictionary = B.project_dictionary(a)
    assert sorted(r.project_no for r in dictionary.collect()) == list(range(9))
    maps = B.project_bitmaps(a, dictionary)
    count = lambda **where: B.unique_projects(B.slice_bitmaps(maps, **where)).first()[0]
    assert count() == 9 and count(files=["a", "b"]) == 8 and count(files=["a"]) == 5 and count(files=["c"]) == 1
    assert count(start_year=2022) == 3 and count(start_year=2021, end_year=2021) == 8 and count(files=["none"]) == 0
    assert values(B.unique_projects(maps, ["source_file"]), "source_file", "unique_projects") == [("a", 5), ("b", 8), ("c", 1)]
    more = activity(spark, [row(file="d", project=p) for p in ("p1", "z1", "z2")])
    grown = B.project_dictionary(more, dictionary)
    assert grown.count() == 11 and dictionary.exceptAll(grown).isEmpty() and grown.agg(F.max("project_no")).first()[0] == 10
    assert B.unique_projects(maps.unionByName(B.project_bitmaps(more, grown))).first()[0] == 11


def test_project_bitmaps_of_many_projects(spark, tmp_path):
    from scanlytics.plans import project_bitmaps as B

    rows = spark.range(100_000).selectExpr("concat('f', id % 3) AS source_file", "cast(2020 + id % 2 as int) AS year", "concat('p', id) AS projectName")
    B.land_bitmaps(rows.unionByName(rows), str(tmp_path))
    maps = B.read_bitmaps(spark, str(tmp_path))
    assert B.unique_projects(maps).first()[0] == 100_000
    assert maps.agg(F.count_distinct("part")).first()[0] == 4
    sliced = B.slice_bitmaps(maps, ["f0", "f1"], 2021, 2021)
    assert B.unique_projects(sliced).first()[0] == rows.where("source_file < 'f2' AND year = 2021").count()
    assert "PartitionFilters: [isnotnull(year" in sliced._jdf.queryExecution().executedPlan().toString()
