"""Times the headline queries and one whole report; prints one JSON line.

Each query runs once to warm up, then three times into the no-op sink; the median counts.
"""

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from scanlytics import ReportOptions, write_report  # noqa: E402
from scanlytics.registry.queries import queries  # noqa: E402
from scanlytics.session import configure, scratch_path  # noqa: E402
from scanlytics.sources.views import order_activity  # noqa: E402

HEADLINE = [
    "summary_totals",
    "totals_by_grain",
    "scan_types_by_grain",
    "time_blocks_by_grain",
    "busiest_quietest_by_grain",
    "top_projects",
    "top_projects_by_year_block",
    "top_projects_by_type_date",
    "series_hourly",
    "series_by_project",
    "evolution_by_project",
    "column_trends",
    "sph_summary",
    "sph_flagged_hours",
    "sph_contributors",
    "sph_display_series",
    "project_scans_daily",
    "project_scans_breakdown",
    "profile_numeric",
    "profile_top_values",
    "group_filtered_totals",
    "zip_roundtrip",
    "landed_roundtrip",
]
RUNS = 3


def timed(action):
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        configure(SparkSession.builder.master(f"local[{cpus}]").appName("scanlytics-bench"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    if names == ["all"]:
        names = list(registered)

    def run(name):
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(statistics.median(timed(lambda: run(name)) for _ in range(RUNS)), 3)
    if names == HEADLINE:
        out = scratch_path(spark, "bench-report")
        options = ReportOptions(capacity_sph=60)
        seconds["full_report"] = round(timed(lambda: write_report(order_activity(spark, folder), out, options)), 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    scale = float(scale) if scale.replace(".", "", 1).isdigit() else scale
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
