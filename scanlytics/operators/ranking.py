"""Top-k per group, row positions and stride sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows per group, numbered from 1.

    The window holds row_number alone, so Catalyst plans a group limit below the shuffle: each task
    sends at most k rows per group, however large the group is.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def stride_sample(
    series: DataFrame, keys: Sequence[str], points: int, order: str = "hour_ts", keep: Column | None = None
) -> DataFrame:
    """Every n-th point of each series, n = length div points (at least 1), plus rows that match ``keep``.

    For hourly series only: a series then has at most 24 rows a day, which bounds the window.
    """
    whole = W.partitionBy(*(keys or [F.lit(0)]))
    position = F.row_number().over(whole.orderBy(order)) - 1
    stride = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(whole) / F.lit(points)))
    numbered = series.withColumns({"_position": position, "_stride": stride})
    chosen = F.col("_position") % F.col("_stride") == 0
    if keep is not None:
        chosen = chosen | keep
    return numbered.where(chosen).drop("_position", "_stride")


def row_positions(
    df: DataFrame, keys: Sequence[str], order: str, bucket: Column, position: str = "row_no"
) -> DataFrame:
    """0-based position of each row within its group, without bringing a group into one task.

    ``bucket`` must grow with ``order``. Rows are numbered inside (group, bucket) and shifted by the
    sizes of the buckets before it, which come from a small count table.
    """
    spread = df.withColumn("_bucket", bucket)
    sizes = spread.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(order)) - 1
    return (
        spread.withColumn("_inside", inside)
        .join(starts, [*keys, "_bucket"])
        .withColumn(position, F.col("_start") + F.col("_inside"))
        .drop("_bucket", "_inside", "_start")
    )
