"""Activity rows mapped from general star-schema and event tables, for tests and the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlytics.functions import columns as C
from scanlytics.functions.enrich import enrich, sized
from scanlytics.operators.ranking import row_positions
from scanlytics.schema import LOG_COLUMNS
from scanlytics.session import tasks_for

_ROWS_PER_BUCKET = 1 << 20

VIEW_COLUMNS = ["source_file", "hour_ts", *[c for c in LOG_COLUMNS if c != "hour"]]


# The columns used, so that opening a table needs no job to infer its schema.
_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_returnflag string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_TABLES[name]).parquet(f"{folder}/{name}.parquet")


def event_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One log row per event: hour grain, with null projects, null states and mixed case."""
    events = _table(spark, folder, "events")
    return events.select(
        F.expr("concat('instance_', cast(user_id % 3 as string), '.csv')").alias("source_file"),
        C.floor_hour(F.col("ts")).alias("hour_ts"),
        F.col("event_id").alias("codeLocationId"),
        F.expr("concat('loc_', cast(event_id as string))").alias("codeLocationName"),
        F.expr("concat('v', cast(event_id % 4 as string))").alias("versionName"),
        F.expr(
            "case when event_id % 50 = 0 then null else concat('project_', cast(user_id as string)) end"
        ).alias("projectName"),
        F.expr("cast(1 + event_id % 5 as bigint)").alias("scanCount"),
        F.expr(
            "case event_type when 'click' then 'SIGNATURE' when 'view' then 'SNIPPET' "
            "when 'purchase' then 'BINARY_ANALYSIS' when 'signup' then 'package_manager' "
            "else 'Snippet_Scan' end"
        ).alias("scanType"),
        F.expr("cast(round(value * 100) as bigint)").alias("totalScanSize"),
        F.expr("cast(round(value * 100) as bigint) % 10000").alias("maxScanSize"),
        F.expr(
            "case when event_id % 97 = 0 then null else case (event_id * 7 + user_id) % 10 "
            "when 6 then 'success' when 7 then 'FAILED' when 8 then 'Cancelled' "
            "when 9 then 'IN_PROGRESS' else 'COMPLETED' end end"
        ).alias("state"),
        F.col("event_type").alias("transitionReason"),
    )


def event_activity(spark: SparkSession, folder: str) -> DataFrame:
    return enrich(event_rows(spark, folder))


def numbered_event_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Event activity with ``row_no``, the position in the file by code location id."""
    rows = event_rows(spark, folder)
    bucket = C.integer_div(F.col("codeLocationId"), F.lit(_ROWS_PER_BUCKET))
    return enrich(row_positions(rows, ["source_file"], "codeLocationId", bucket))


def order_rows(spark: SparkSession, folder: str, lines_known: int | None = None) -> DataFrame:
    """One log row per order line: seven years, many projects, five files.

    The dimensions are joined among themselves first, so the lines are shuffled once, on the order key; with their
    number known, to as many tasks as they need.
    """
    tasks = tasks_for(spark, lines_known)

    def table(name):
        return _table(spark, folder, name)

    place = table("nation").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    lines = table("lineitem")
    if tasks is not None:
        lines, orders = lines.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")
    lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    cents = "cast(round(l_extendedprice * 100) as bigint)"
    return lines.select(
        F.expr("concat(lower(r_name), '.csv')").alias("source_file"),
        F.expr("cast(to_date(l_shipdate) as timestamp_ntz) + make_dt_interval(0, cast(l_orderkey % 24 as int))").alias("hour_ts"),
        F.col("l_orderkey").alias("codeLocationId"),
        F.expr("concat('order_', cast(l_orderkey as string))").alias("codeLocationName"),
        F.expr("concat('v', cast(l_linenumber as string))").alias("versionName"),
        F.col("c_name").alias("projectName"),
        F.expr("cast(l_quantity as bigint)").alias("scanCount"),
        F.expr(
            "case l_returnflag when 'A' then 'SIGNATURE' when 'N' then 'SNIPPET' else 'binary_analysis' end"
        ).alias("scanType"),
        F.expr(cents).alias("totalScanSize"),
        F.expr(f"{cents} % 100000").alias("maxScanSize"),
        F.expr(
            "case o_orderstatus when 'F' then 'Completed' when 'O' then 'ERROR' else 'IN_PROGRESS' end"
        ).alias("state"),
        F.col("o_orderpriority").alias("transitionReason"),
    )


def order_activity(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "lineitem").count()  # from the files' footers
    return sized(enrich(order_rows(spark, folder, rows)), rows)


def group_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Regions over nations over customers as a project-group tree: ``id, pid, name, isProject``."""

    def level(table, prefix, key, name, parent, is_project):
        pid = F.concat(F.lit(parent[0]), F.col(parent[1]).cast("string")) if parent else F.lit(None).cast("string")
        return _table(spark, folder, table).select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"),
            pid.alias("pid"),
            F.col(name).alias("name"),
            F.lit(is_project).alias("isProject"),
        )

    return (
        level("region", "r", "r_regionkey", "r_name", None, False)
        .unionByName(level("nation", "n", "n_nationkey", "n_name", ("r", "n_regionkey"), False))
        .unionByName(level("customer", "c", "c_custkey", "c_name", ("n", "c_nationkey"), True))
    )
