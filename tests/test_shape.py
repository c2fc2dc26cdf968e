"""The executed plans have the shape they were designed for."""

import re

import pytest

import __spark_entry__ as contract
from scanlytics.registry import queries as registered
from scanlytics.plans import blocks, capacity, profile, rankings, totals
from scanlytics.sources.views import event_activity, numbered_event_activity


def executed(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def count(word, plan):
    return len(re.findall(word, plan))


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(
    "metric",
    [
        totals.summary_totals, totals.totals_by_grain, totals.scan_types_by_grain, totals.distinct_lists,
        lambda a: blocks.time_blocks(a, ["global", "file_year_project"]),
        lambda a: rankings.top_projects(a, ["scan_date"]),
        lambda a: capacity.contributors(a, 10),
        lambda a: capacity.flagged_hours(a, 10),
        lambda a: profile.top_values(a),
    ],
)
def test_one_scan(spark, folder, no_broadcast, metric):
    plan = executed(metric(event_activity(spark, folder)))
    assert count("FileScan", plan) == 1
    assert count("Python|Pandas|CartesianProduct|NestedLoop", plan) == 0


def test_unused_columns_are_not_read(spark, folder):
    plan = executed(capacity.hourly_sph(event_activity(spark, folder)))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


@pytest.mark.parametrize("name", ["top_projects", "top_projects_by_date", "profile_top_values", "profile_preview"])
def test_top_k_is_cut_before_the_shuffle(spark, folder, name):
    plan = executed(contract.queries()[name](spark, folder))
    assert count("WindowGroupLimit", plan) >= 2


def test_contributors_are_cut_before_the_shuffle(spark):
    plan = executed(contract.entry(spark))
    assert count("WindowGroupLimit", plan) >= 2


def test_quantiles_share_one_count(spark, folder, no_broadcast):
    plan = executed(profile.numeric_stats(numbered_event_activity(spark, folder)))
    assert count("ReusedExchange", plan) >= 1


def test_page_is_a_top_k(spark, folder):
    plan = executed(contract.queries()["project_scans_page"](spark, folder))
    assert "TakeOrderedAndProject" in plan


def test_python_runs_in_the_archive_reader_only(spark, folder):
    for name, query in registered.queries().items():
        if not name.startswith("zip_"):
            plan = query(spark, folder)._jdf.queryExecution().executedPlan().toString()
            assert count("Python|Pandas|InArrow", plan) == 0, name
