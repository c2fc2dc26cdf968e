import zipfile

import pytest
from pyspark.sql import functions as F

from logs import activity, row, values
from scanlytics import enrich, filter_years, land, read_archives, read_csv_files, read_landed
from scanlytics.plans import profile, totals
from scanlytics.sources.landing import land_cube, read_cube
from scanlytics.operators.cube import activity_cube

PROD = ' hour , projectName, scanCount ,scanType,state\n2024-01-01 00:00:00,"Web, shop",3,SNIPPET,COMPLETED\n2024-01-01 01:00:00,NA,2,SIGNATURE,null\n'
STAGE = "state,scanCount,hour,projectName\nFAILED,5,2023-12-31 23:00:00,api\n\nERROR,,bad,api\nERROR\n"


@pytest.fixture
def archive(tmp_path):
    path = tmp_path / "export.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("prod.csv", PROD)
        z.writestr("x/stg.csv", STAGE)
        z.writestr("readme.txt", "hour\n1\n")
        z.writestr("upper.CSV", "hour\n1\n")
    return path


def test_archives(spark, archive):
    raw = read_archives(spark, str(archive))
    got = values(raw, "source_file", "row_no", "hour", "projectName", "scanCount", "state")
    assert got[:2] == [
        ("prod.csv", 0, "2024-01-01 00:00:00", "Web, shop", "3", "COMPLETED"),
        ("prod.csv", 1, "2024-01-01 01:00:00", None, "2", None),
    ]
    assert [r[1:] for r in got[2:]] == [
        (0, "2023-12-31 23:00:00", "api", "5", "FAILED"), (1, "bad", "api", None, "ERROR"), (2, None, None, None, "ERROR"),
    ]
    a = enrich(raw)
    summary = totals.summary_totals(a).first()
    assert (summary.total_files, summary.total_rows, summary.total_scans, summary.failed_scans) == (2, 5, 10, 5)
    # the second file has no scanType column
    assert values(totals.scan_type_rows(a), "scanType", "rows") == [("SIGNATURE", 1), ("SNIPPET", 1), ("Unknown", 3)]
    columns = {r.source_file: r["columns"] for r in profile.file_profile(a).collect()}
    assert columns["prod.csv"] == ["hour", "projectName", "scanCount", "scanType", "state"]
    assert profile.preview(a).count() == 5


def test_folder_of_archives(spark, archive, tmp_path):
    with zipfile.ZipFile(tmp_path / "second.zip", "w") as z:
        z.writestr("prod.csv", PROD)
    raw = read_archives(spark, str(tmp_path))
    assert raw.count() == 7 and raw.select("archive").distinct().count() == 2
    # equal entries of two archives are two files
    assert values(raw.groupBy("source_file").count(), "source_file", "count") == [
        ("export.zip/prod.csv", 2), ("export.zip/x/stg.csv", 3), ("second.zip/prod.csv", 2),
    ]
    assert values(read_archives(spark, f"{tmp_path}/sec*.zip"), "source_file", "row_no") == [("prod.csv", 0), ("prod.csv", 1)]


def test_archive_without_csv_is_an_error(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "empty.zip", "w") as z:
        z.writestr("readme.txt", "x")
    with pytest.raises(Exception, match="no CSV files"):
        read_archives(spark, str(tmp_path / "empty.zip")).count()


def test_entry_larger_than_a_chunk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("scanlytics.sources.archives._CHUNK_ROWS", 10)
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as z:
        z.writestr("big.csv", "scanCount\n" + "\n".join(str(i) for i in range(95)))
    got = read_archives(spark, str(tmp_path / "big.zip")).select("row_no", "scanCount").collect()
    assert sorted((r.row_no, int(r.scanCount)) for r in got) == [(i, i) for i in range(95)]


def test_csv_files_with_different_headers(spark, tmp_path):
    (tmp_path / "prod.csv").write_text(PROD)
    (tmp_path / "stg file+1.csv").write_text("state,scanCount,hour,projectName\nFAILED,5,2023-12-31 23:00:00,api\n")
    (tmp_path / "again.csv").write_text(PROD)
    (tmp_path / "note.txt").write_text("x\n")
    raw = read_csv_files(spark, str(tmp_path), number_rows=True)
    got = values(raw, "source_file", "row_no", "projectName", "scanCount", "scanType", "state")
    assert got[:2] == [("again.csv", 0, "Web, shop", "3", "SNIPPET", "COMPLETED"), ("again.csv", 1, None, "2", "SIGNATURE", None)]
    assert [r for r in got if r[0].startswith("stg")] == [("stg file+1.csv", 0, "api", "5", None, "FAILED")]
    assert len(got) == 5
    assert values(totals.scan_type_rows(enrich(raw)), "scanType", "rows") == [("SIGNATURE", 2), ("SNIPPET", 2), ("Unknown", 1)]


def test_csv_files_of_one_name_stay_apart(spark, tmp_path):
    for folder in ("a", "b/c"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "prod.csv").write_text(PROD)
    got = read_csv_files(spark, str(tmp_path / "*"))
    assert values(got, "source_file") == [("prod.csv",)] * 2
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "prod.csv").write_text(PROD)
    assert values(read_csv_files(spark, str(tmp_path / "[ad]")).select("source_file").distinct(), "source_file") == [("a/prod.csv",), ("d/prod.csv",)]


def test_csv_rows_are_numbered_across_splits(spark, tmp_path):
    lines = "\n".join(f"2024-01-01 00:00:00,{i}" for i in range(5000))
    (tmp_path / "long.csv").write_text("hour,scanCount\n" + lines + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = read_csv_files(spark, str(tmp_path), number_rows=True)
        assert raw.where("row_no = cast(scanCount as bigint)").count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_landing_prunes_years(spark, tmp_path):
    a = activity(spark, [row(hour=f"{y}-05-05 05", scans=y) for y in (2021, 2022, 2023)] + [row(hour=None)])
    path = str(tmp_path / "landed")
    land(a, path)
    back = read_landed(spark, path)
    assert totals.totals_by_grain(back).exceptAll(totals.totals_by_grain(a)).isEmpty()
    assert back.count() == 4
    kept = filter_years(back, 2022, 2022)
    assert values(kept, "year", "scanCount") == [(2022, 2022)]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "GreaterThanOrEqual(hour_ts" in plan


def test_landing_replaces_all_or_some_years(spark, tmp_path):
    path = str(tmp_path / "landed")
    land(activity(spark, [row(hour="2021-01-01 00"), row(hour="2022-01-01 00")]), path)
    land(activity(spark, [row(hour="2022-01-01 00", scans=7)]), path, only_years=True)
    assert values(read_landed(spark, path), "year", "scanCount") == [(2021, 1), (2022, 7)]
    land(activity(spark, [row(hour="2023-01-01 00")]), path)
    assert values(read_landed(spark, path), "year") == [(2023,)]


def test_landed_rows_without_any_hour(spark, tmp_path):
    path = str(tmp_path / "landed")
    land(activity(spark, [row(hour=None)]), path)
    assert values(read_landed(spark, path), "year", "scanCount") == [(None, 1)]


def test_landed_cube(spark, tmp_path, folder):
    from scanlytics.sources.views import event_activity

    cube = activity_cube(event_activity(spark, folder))
    path = str(tmp_path / "cube")
    land_cube(cube, path)
    back = read_cube(spark, path).select(*cube.columns)
    assert back.exceptAll(cube).isEmpty() and back.count() == cube.count()
    assert back.agg(F.sum("scans_all")).first() == cube.agg(F.sum("scans_all")).first()


def test_files_without_rows_count(spark, archive):
    from scanlytics.sources.archives import archive_contents, archive_entries

    with zipfile.ZipFile(archive, "a") as z:
        z.writestr("empty.csv", "hour,scanCount\n")
    contents = archive_contents(spark, str(archive))
    entries = archive_entries(contents)
    assert sorted(r.source_file for r in entries.collect()) == ["empty.csv", "prod.csv", "x/stg.csv"]
    a = enrich(read_archives(spark, str(archive)))
    assert totals.summary_totals(a).first().total_files == 2
    assert totals.summary_totals(a, entries).first().total_files == 3


@pytest.mark.parametrize("format", ["parquet", "json", "csv"])
def test_group_tree(spark, tmp_path, format):
    from scanlytics import projects_in_group, read_group_tree

    rows = [("g", None, "Team", False), ("p", "g", "x", True), ("q", "g", "y", None)]
    tree = spark.createDataFrame(rows, "id string, pid string, name string, isProject boolean")
    path = str(tmp_path / "tree")
    tree.write.format(format).option("header", True).save(path)
    back = read_group_tree(spark, path, format)
    assert values(projects_in_group(back, "Team"), "projectName") == [("x",), ("y",)]


def test_entries_are_dealt_out_by_size(spark, tmp_path):
    from scanlytics.sources import archives as A

    for k in range(30):
        with zipfile.ZipFile(tmp_path / f"a{k:02d}.zip", "w") as z:
            for e in range(3):
                z.writestr(f"{e}.csv", "hour,scanCount\n" + "2024-01-01 00:00:00,1\n" * (5000 if k == e == 0 else 20))
    planned = A.plan_entries(A.archive_files(spark, str(tmp_path)))
    entries, tasks = A.dealt_entries(planned, task_bytes=1 << 20)
    found = entries.collect()
    assert len(found) == 90 and {r.task for r in found} <= set(range(tasks))
    per_task = {}
    for r in found:
        per_task[r.task] = per_task.get(r.task, 0) + r.packed_bytes + A._ENTRY_BYTES
    assert max(per_task.values()) < (1 << 20) + 200_000 and len(per_task) == tasks > 4
    raw = A.read_files(A.archive_files(spark, str(tmp_path)), task_bytes=1 << 20)
    assert raw.count() == 89 * 20 + 5000 and raw.select("source_file").distinct().count() == 90
    # planning reads names and sizes in tasks; nothing but sums per bucket reaches the driver
    plan = entries._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "content" not in plan


def test_folder_without_archives_has_no_rows(spark, tmp_path):
    assert read_archives(spark, str(tmp_path)).isEmpty()


def test_landed_hours_are_filtered_by_the_scan(spark, tmp_path):
    path = str(tmp_path / "landed")
    rows = spark.range(200_000).selectExpr("make_timestamp_ntz(2024, 1, 1, 0, 30, 0) + make_dt_interval(0, cast(id % 8000 as int)) AS hour_ts", "id AS scanCount", "'s' AS scanType")
    land(enrich(rows.withColumn("source_file", F.lit("a.csv"))).coalesce(1), path)
    back = read_landed(spark, path).where("hour_ts >= timestamp_ntz'2024-11-20 00:00:00'")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(hour_ts" in plan
    assert back.agg(F.min("hour_ts")).first()[0].minute == 0
    with pytest.raises(ValueError, match="full hours"):
        rows.withColumn("year", F.lit(2024)).write.partitionBy("year").parquet(str(tmp_path / "old"))
        land(enrich(rows.withColumn("source_file", F.lit("a.csv"))), str(tmp_path / "old"), only_years=True)


def write_log(path, rows, stamp=None):
    import os

    with zipfile.ZipFile(path, "w") as z:
        z.writestr("log.csv", "hour,projectName,scanCount,state\n" + "".join(f"{r}\n" for r in rows))
    if stamp:
        os.utime(path, (stamp, stamp))


def same_rows(left, right):
    columns = [c for c in right.columns if c not in ("archive", "load")]
    assert left.select(*columns).exceptAll(right.select(*columns)).isEmpty() and left.count() == right.count()


def test_refresh_reads_changed_archives_only(spark, tmp_path):
    from scanlytics.sources.incremental import manifest, read_snapshot, read_snapshot_cube, refresh

    logs, path = tmp_path / "logs", str(tmp_path / "snapshot")
    logs.mkdir()

    def as_landed_whole():
        whole = enrich(read_archives(spark, str(logs)))
        back = read_snapshot(spark, path)
        same_rows(back, whole)
        same_rows(read_snapshot_cube(spark, path), activity_cube(whole))

    assert refresh(spark, str(logs), path)["read"] == 0
    assert read_snapshot(spark, path).isEmpty() and read_snapshot_cube(spark, path).isEmpty()
    for k in range(4):
        write_log(logs / f"{k}.zip", [f"202{k}-01-01 0{h}:00:00,p{h % 3},{h},COMPLETED" for h in range(9)], 1_700_000_000)
    assert refresh(spark, str(logs), path) == {"load": 0, "read": 4, "unchanged": 0, "taken_back": 0}
    as_landed_whole()
    assert refresh(spark, str(logs), path) == {"load": 0, "read": 0, "unchanged": 4, "taken_back": 0}

    # an unchanged archive is not even opened: it could be anything of the same size and time
    good = (logs / "3.zip").read_bytes()
    (logs / "3.zip").write_bytes(b"x" * len(good))
    import os

    os.utime(logs / "3.zip", (1_700_000_000, 1_700_000_000))
    write_log(logs / "1.zip", ["2021-01-01 00:00:00,p0,5,FAILED", "2029-01-01 00:00:00,new,7,COMPLETED", "bad,,1,"], 1_700_000_500)
    write_log(logs / "4.zip", ["2024-01-01 00:00:00,p9,2,COMPLETED"], 1_700_000_500)
    assert refresh(spark, str(logs), path) == {"load": 1, "read": 2, "unchanged": 3, "taken_back": 1}
    (logs / "3.zip").write_bytes(good)
    os.utime(logs / "3.zip", (1_700_000_000, 1_700_000_000))
    as_landed_whole()

    # replaced twice and removed; a refresh that broke off before its manifest counts for nothing
    write_log(logs / "1.zip", ["2021-01-01 00:00:00,p0,6,FAILED"], 1_700_000_900)
    (logs / "0.zip").rename(tmp_path / "0.zip")
    read_snapshot(spark, path).limit(3).select("archive", "hour_ts").write.parquet(f"{path}/rows/load=2/year=2020")
    as_before = read_snapshot(spark, path).count()
    assert refresh(spark, str(logs), path) == {"load": 2, "read": 1, "unchanged": 3, "taken_back": 2}
    as_landed_whole()
    assert as_before == 31 and manifest(spark, path).where("live").count() == 4
    kept = filter_years(read_snapshot(spark, path), 2021, 2021)
    assert "GreaterThanOrEqual(hour_ts" in kept._jdf.queryExecution().executedPlan().toString()
