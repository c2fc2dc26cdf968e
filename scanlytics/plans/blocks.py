"""Time-of-day profile in three-hour blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlytics.functions import columns as C
from scanlytics.operators import cube as K
from scanlytics.schema import BLOCK_STARTS, STATUSES

_LEAD = ["grain", "source_file", "year", "projectName", "status"]


def _profiles(activity: DataFrame, grains: Sequence[str], measure: str) -> DataFrame:
    """One row per grain key and status with ``total`` and ``counts``, the eight blocks in display order.

    The blocks are columns of the aggregate, so all eight exist without a join to a block table, and the
    total needs no window. A row without an hour belongs to no block.
    """
    hours = K.not_null(activity, "hour_ts").withColumn("_block", C.block_start(F.col("hour_ts")))
    keys = [*K.finest_keys(grains), "_block"]
    reduced = K.roll_up(K.deal_out(hours, keys), keys, measure)
    cells = [
        F.sum(F.when(F.col("_block") == start, F.col(f"{measure}_{status}")).otherwise(0)).alias(f"{status}_{start}")
        for status in STATUSES
        for start in BLOCK_STARTS
    ]
    wide = K.by_grains(reduced, grains, cells)
    per_status = [
        F.struct(
            F.lit(status).alias("status"),
            sum((F.col(f"{status}_{s}") for s in BLOCK_STARTS[1:]), F.col(f"{status}_{BLOCK_STARTS[0]}")).alias("total"),
            F.array(*[F.col(f"{status}_{s}") for s in BLOCK_STARTS]).alias("counts"),
        )
        for status in STATUSES
    ]
    long = wide.select("grain", "source_file", "year", "projectName", F.inline(F.array(*per_status)))
    return long.where(F.col("total") > 0)


def _start_of(index):
    return F.element_at(F.array(*[F.lit(s) for s in BLOCK_STARTS]), index + 1)


def time_blocks(activity: DataFrame, grains: Sequence[str] = ("global",), measure: str = "rows") -> DataFrame:
    """Count and share of each block; ``measure`` is log rows, or scans."""
    long = _profiles(activity, grains, measure).select(*_LEAD, "total", F.posexplode("counts").alias("block_order", "count"))
    start = _start_of(F.col("block_order"))
    return long.select(
        *_LEAD,
        "block_order",
        C.block_name(start).alias("time_block"),
        start.alias("block_start"),
        ((start + 3) % 24).alias("block_end"),
        "count",
        C.percent(F.col("count"), F.col("total")).alias("percentage"),
    )


def busiest_quietest(activity: DataFrame, grains: Sequence[str] = ("global",), measure: str = "rows") -> DataFrame:
    """The fullest block and the emptiest block that has rows; the earlier start wins a tie."""

    def as_pair(sign):
        return lambda count, i: F.struct(count.alias("count"), (sign * _start_of(i)).alias("start"))

    def used(pair):
        return pair["count"] > 0

    counts = F.col("counts")
    best = F.array_max(F.filter(F.transform(counts, as_pair(-1)), used))
    least = F.array_min(F.filter(F.transform(counts, as_pair(1)), used))
    found = _profiles(activity, grains, measure).withColumns({"_best": best, "_least": least})
    out = [*_LEAD]
    for name, pair, start in (("busiest", "_best", -F.col("_best.start")), ("quietest", "_least", F.col("_least.start"))):
        count = F.col(f"{pair}.count")
        out += [
            start.alias(f"{name}_hour"),
            ((start + 3) % 24).alias(f"{name}_hour_end"),
            count.alias(f"{name}_count"),
            C.percent(count, F.col("total")).alias(f"{name}_percentage"),
        ]
    return found.select(*out)
