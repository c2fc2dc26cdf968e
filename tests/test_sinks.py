import glob
import gzip
import json
from datetime import datetime

from logs import activity, row, values
from scanlytics import ReportOptions, analyse, chart_series, write_report
from scanlytics.operators.filters import slice_metrics
from scanlytics.plans import scan_report, totals
from scanlytics.sinks import tables as S

LOG = [
    row("a.csv", "2023-01-01 00", "x", 4, "A", "COMPLETED"),
    row("a.csv", "2024-01-01 07", "x", 6, "B", "FAILED"),
    row("b.csv", "2024-02-01 07", "y/1", 90, "A", "success"),
]


def test_report_name():
    at = datetime(2024, 5, 6, 7, 8, 9)
    assert S.report_name(at) == "report_20240506_070809"
    assert S.report_name(at, "Team 1/ä") == "report_20240506_070809_Team_1_ä"
    assert S.report_name(at, "T", project_scans=True) == "report_20240506_070809_T_project_scans"


def test_csv_export(spark, tmp_path):
    a = activity(spark, [*LOG, row(project='q"uote', kind="C")])
    S.write_csv(scan_report.report_records(a), str(tmp_path / "out"), compress=True)
    files = glob.glob(str(tmp_path / "out" / "*.csv.gz"))
    text = "".join(gzip.open(f, "rt").read() for f in files)
    assert "projectName,scanType,scan_date,scans,breakdown" in text
    assert "x,A,2023-01-01,4,B: 6; A: 4" in text
    assert '"q""uote"' in text


def test_documents(spark, tmp_path):
    a = activity(spark, LOG)
    analysis = analyse(a)
    docs = S.documents(analysis)
    S.write_documents(docs, str(tmp_path / "docs"))
    back = spark.read.json(str(tmp_path / "docs"))
    body = {(r.section, r.grain, r.projectName): json.loads(r.body) for r in back.where("grain in ('global', 'project')").collect()}
    assert body["scan_types", "project", "x"] == {"all": {"A": 4, "B": 6}, "failed": {"B": 6}, "success": {"A": 4}}
    assert body["totals", "global", None]["total_scans"] == 100
    assert body["top_projects", "global", None]["all"][0] == {"rank": 1, "project": "y/1", "scans": 90}
    assert [b["count"] for b in body["time_blocks", "global", None]["all"]] == [2, 0, 0, 0, 0, 0, 1, 0]


def test_whole_document(spark, tmp_path):
    from scanlytics.sinks.document import SECTIONS, write_whole

    a = activity(spark, [*LOG, row("c,\"1\\2.csv", "2024-03-01 08", 'q"u\\o\tte ~', 5, "A B", "weird/state"), row("a.csv", None, None, 1, "B", None)])
    tables = analyse(a) | chart_series(a, ReportOptions(capacity_sph=60))
    tables["file_lists"] = tables["lists"]
    write_whole(tables, str(tmp_path / "d"))
    files = sorted(glob.glob(str(tmp_path / "d" / "part-*")))
    doc = json.loads("".join(open(f, encoding="utf-8").read() for f in files))
    assert set(doc) == set(SECTIONS)
    plain = {name: [r.asDict() for r in tables[name].collect()] for name in doc}
    for name, table in plain.items():
        section, want = SECTIONS[name], {}
        if section.prepare(tables[name]) is not tables[name]:
            table = [r.asDict() for r in section.prepare(tables[name]).collect()]
        show = lambda v: str(v)[:19] if isinstance(v, datetime) else v
        for r in sorted(table, key=lambda r: [r[c] if c == "rank" else str(r[c]).encode() for c in section.path]):
            if any(r[c] is None for c in section.path):
                continue
            value = show(r[section.fields[0]]) if section.bare else {f: show(r[f]) for f in section.fields}
            at = doc[name]
            for depth, (column, kind) in enumerate(zip(section.path, section.kinds)):
                if kind == "a":
                    want.setdefault(str([r[c] for c in section.path[:depth]]), (at, []))[1].append(value)
                    break
                at = at[str(r[column])]
            else:
                assert at == value
        for got, listed in want.values():
            assert got == listed
    assert doc["states"]["weird/state"] == 1 and 'q"u\\o\tte ~' in doc["lists"]["projects"]
    out = write_report(a, str(tmp_path / "r"), ReportOptions(capacity_sph=60, whole_document=True))
    again = json.loads("".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{out}/document/part-*"))))
    assert {k: v for k, v in again.items() if k != "file_profile"} == {k: v for k, v in doc.items() if k != "file_profile"}


def test_whole_report(spark, tmp_path):
    a = activity(spark, LOG)
    out = write_report(a, str(tmp_path / "r"), ReportOptions(capacity_sph=60, min_scans=1))
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    assert read("analysis/summary").first().total_files == 2
    assert values(read("charts/sph_flagged_hours"), "sph", "status") == [(90, "BREACH")]
    grains = {r.grain for r in read("series").select("grain").distinct().collect()}
    assert grains == {"global", "year", "project", "year_project", "file"}
    assert read("analysis/totals").where("grain = 'file_year_project'").count() == 3


def test_report_counts_files_without_rows_and_reads_one_grain(spark, tmp_path):
    files = spark.createDataFrame([("a.csv",), ("b.csv",), ("empty.csv",)], "source_file string")
    out = write_report(activity(spark, LOG), str(tmp_path / "r"), files=files)
    assert spark.read.parquet(f"{out}/analysis/summary").first().total_files == 3
    table = slice_metrics(spark.read.parquet(f"{out}/analysis/scan_types"), year=2024)
    assert "PartitionFilters: [isnotnull(grain" in table._jdf.queryExecution().executedPlan().toString()


def test_year_range_spares_per_file_tables(spark):
    a = activity(spark, LOG)
    tables = analyse(a, ReportOptions(start_year=2024))
    assert values(tables["totals"].where("grain = 'global'"), "total_scans") == [(96,)]
    assert values(tables["totals"].where("grain = 'file'"), "total_scans") == [(10,), (90,)]
    assert values(tables["totals"].where("grain = 'year'"), "year") == [(2024,)]


def test_year_range_comes_before_the_choice_of_projects(spark):
    a = activity(spark, LOG)
    charts = chart_series(a, ReportOptions(min_scans=10))
    assert charts["series_project"].where("projectName = 'x'").count() > 0
    charts = chart_series(a, ReportOptions(min_scans=10, start_year=2024))
    assert charts["series_project"].where("projectName = 'x'").count() == 0


def test_options_leave_tables_out(spark):
    a = activity(spark, LOG)
    assert "series_year_project" in chart_series(a)
    assert "series_year_project" not in chart_series(a, ReportOptions(skip_detailed=True))
    simple = chart_series(a, ReportOptions(simple=True))
    assert "series_year" not in simple and "series_global" in simple
    tables = analyse(a, ReportOptions(simple=True))
    assert values(tables["totals"], "grain") == [("global",)]


def test_one_file_has_per_file_tables_too(spark):
    a = activity(spark, LOG[:2])
    assert analyse(a)["totals"].where("grain like 'file%'").count() > 0
    assert chart_series(a)["series_file"].count() > 0


def test_trends_renumber_the_rows_left(spark):
    from pyspark.sql import functions as F

    a = activity(spark, LOG).withColumn("row_no", F.when(F.col("year") == 2023, 0).otherwise(F.when(F.col("source_file") == "a.csv", 1).otherwise(0)).cast("bigint"))
    trend = lambda **o: values(chart_series(a, ReportOptions(**o))["trends"].where("column = 'scanCount'"), "source_file", "row_no", "value")
    assert trend() == [("a.csv", 0, 4), ("a.csv", 1, 6), ("b.csv", 0, 90)]
    assert trend(start_year=2024) == [("a.csv", 0, 6), ("b.csv", 0, 90)]


def test_report_of_a_group(spark, tmp_path):
    a = activity(spark, LOG)
    tree = spark.createDataFrame(
        [("g", None, "Team", False), ("p", "g", "x", True)], "id string, pid string, name string, isProject boolean"
    )
    out = write_report(a, str(tmp_path / "r"), tree=tree, group="Team", project_scans=True)
    back = spark.read.option("header", True).csv(f"{out}/project_scans/project_totals")
    assert values(back, "projectName", "scans") == [("x", "10")]


def test_series_sink_is_partitioned(spark, tmp_path):
    a = activity(spark, LOG)
    series = chart_series(a)["series_year"]
    S.write_series(series, str(tmp_path / "s"))
    assert glob.glob(str(tmp_path / "s" / "grain=year" / "metric=series"))
    assert totals.summary_totals(a).count() == 1
