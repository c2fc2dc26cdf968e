"""Large roll-ups get as many tasks as their rows need."""

import pytest

from scanlytics import session
from scanlytics.operators import cube as K
from scanlytics.plans import blocks, scan_report, series, totals
from scanlytics.registry import queries as registered
from scanlytics.sources.views import event_activity, order_activity

METRICS = {
    "time_blocks": lambda a: blocks.time_blocks(a, ["global", "file_project", "file_year_project"]),
    "busiest_quietest": lambda a: blocks.busiest_quietest(a, ["file_year_project"]),
    "totals": totals.totals_by_grain,
    "scan_types": totals.scan_types_by_grain,
    "daily": scan_report.daily_counts,
    "records": scan_report.report_records,
    "series": lambda a: series.hourly_series(a, ["projectName"]),
    "evolution": lambda a: series.scan_type_evolution(a, ["year", "projectName"]),
}


def _rows(df):
    return sorted(map(str, registered.flat(df).collect()))


@pytest.mark.parametrize("name", METRICS)
def test_rows_are_dealt_out_by_their_number(spark, folder, monkeypatch, name):
    plain = _rows(METRICS[name](order_activity(spark, folder)))
    monkeypatch.setattr(session, "ROWS_PER_TASK", 500)
    activity = order_activity(spark, folder)
    dealt = METRICS[name](activity)
    tasks = session.tasks_for(spark, activity.count())
    assert tasks > spark.sparkContext.defaultParallelism
    # the join's two sides and the roll-up
    assert dealt._jdf.queryExecution().executedPlan().toString().count(f", {tasks}), REPARTITION_BY_NUM") >= 3
    assert _rows(dealt) == plain


def test_few_keys_and_unmarked_rows_are_left_as_they_are(spark, folder, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 500)
    activity, unmarked = order_activity(spark, folder), event_activity(spark, folder)
    assert K.deal_out(activity, ["year", "hour_ts"]) is activity
    assert K.deal_out(activity, ["projectName"]) is activity
    assert K.deal_out(unmarked, ["projectName", "hour_ts"]) is unmarked
