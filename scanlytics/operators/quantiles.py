"""Exact interpolated quantiles per group by radix selection, without holding or sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanlytics.operators.cube import not_null

#: A code has 64 bits; each pass settles as many of them.
_DIGIT = 16
_PASSES = 64 // _DIGIT
_FRACTION_BITS = 52
_LEAST_EXPONENT, _MOST_EXPONENT = -1022, 1023


def with_code(df: DataFrame, value: str, code: str) -> DataFrame:
    """Adds a bigint in the order of the double ``value``: its bits, negative for a negative value; both zeros are 0,
    NaN comes last and a null first.

    Spark has no function for the bits, so they are put together from exponent and fraction; the logarithm may be one
    off next to a power of two, which the quotient tells. Steps are columns of their own, so that none is computed twice.
    """
    size, guess, exponent, fraction = (F.col(f"_{name}") for name in ("size", "guess", "exponent", "fraction"))
    one = F.lit(1 << _FRACTION_BITS)
    infinite = F.lit(2047 << _FRACTION_BITS)
    tiny = fraction < 1  # a number below the least exponent has no leading one
    lead = exponent - F.when(tiny, _LEAST_EXPONENT).otherwise(_LEAST_EXPONENT - 1)
    part = F.when(tiny, fraction).otherwise(fraction - 1) * one.cast("double")
    bits = lead.cast("bigint") * one + part.cast("bigint")
    rounded = F.when(size == 0, F.lit(0).cast("bigint")).when(size == float("inf"), infinite).otherwise(bits)
    steps = {
        "_size": F.abs(F.col(value)),
        "_guess": F.least(F.greatest(F.floor(F.log2(size)), F.lit(_LEAST_EXPONENT)), F.lit(_MOST_EXPONENT)),
        "_rest": size / F.pow(F.lit(2.0), guess),
        "_exponent": guess + F.when(F.col("_rest") >= 2, 1).when((F.col("_rest") < 1) & (guess > _LEAST_EXPONENT), -1).otherwise(0),
        "_fraction": size / F.pow(F.lit(2.0), exponent),
        "_bits": F.when(F.isnan(F.col(value)), infinite + 1).otherwise(rounded),
        # never null, so that no join asks for that again on one of its sides only
        code: F.coalesce(F.when(F.col(value) < 0, -F.col("_bits")).otherwise(F.col("_bits")), F.lit(-(1 << 63))),
    }
    for name, step in steps.items():
        df = df.withColumn(name, step)
    return df.drop(*[name for name in steps if name != code])


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float]) -> DataFrame:
    """``keys, fraction, quantile`` with linear interpolation between neighbours.

    The built-in exact percentile keeps every distinct value of a group in one buffer. Here equal values are counted
    first, and the counts are added up for ever shorter prefixes of the values' codes: 48, 32 and 16 bits. Then the
    wanted positions are looked for from the shortest prefix down, each pass among the at most 65,536 cells that share
    the prefix found before. However values lie, close together or far apart, no task gets more of them than that for
    one position, beyond its share of the counts.
    """
    counted = (
        not_null(df, *keys, value)
        .groupBy(*keys, F.col(value).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    layers = [with_code(counted, "_value", "_prefix")]
    for _ in range(_PASSES - 1):
        shorter = F.shiftright("_prefix", _DIGIT).alias("_prefix")
        layers.append(layers[-1].groupBy(*keys, shorter).agg(F.sum("_n").alias("_n")))

    # every fraction needs the values at floor and ceil of its position
    def target(fraction: float, side) -> Column:
        place = F.lit(float(fraction)) * (F.col("_total") - 1)
        return F.struct(F.lit(float(fraction)).alias("fraction"), place.alias("place"), side(place).alias("index"))

    def holding(cells: DataFrame, within: Sequence[str]) -> DataFrame:
        """Cells that hold a target, with the count before them."""
        until = W.partitionBy(*within).orderBy("_prefix").rowsBetween(W.unboundedPreceding, W.currentRow)
        placed = cells.withColumn("_from", F.col("_before") + F.sum("_n").over(until) - F.col("_n"))
        inside = lambda t: (t["index"] >= F.col("_from")) & (t["index"] < F.col("_from") + F.col("_n"))
        held = placed.withColumn("_targets", F.filter("_targets", inside)).where(F.size("_targets") > 0)
        return held.withColumn("_before", F.col("_from")).drop("_from")

    targets = F.array(*[target(f, side) for f in fractions for side in (F.floor, F.ceil)])
    top = layers[-1].withColumn("_total", F.sum("_n").over(W.partitionBy(*keys)))
    found = holding(top.withColumns({"_before": F.lit(0).cast("bigint"), "_targets": targets}).drop("_total"), keys)
    for layer in layers[-2::-1]:
        wanted = found.select(*keys, F.col("_prefix").alias("_parent"), "_before", "_targets")
        children = layer.withColumn("_parent", F.shiftright("_prefix", _DIGIT))
        found = holding(children.join(wanted, [*keys, "_parent"]), [*keys, "_parent"])
    picked = (
        found.select(*keys, "_value", F.inline("_targets"))
        .groupBy(*keys, F.col("fraction").alias("_fraction"), F.col("place").alias("_place"))
        .agg(F.min_by("_value", "index").alias("_low"), F.max_by("_value", "index").alias("_high"))
    )
    gap = F.col("_place") - F.floor("_place")
    return picked.select(
        *keys,
        F.col("_fraction").alias("fraction"),
        (F.col("_low") + (F.col("_high") - F.col("_low")) * gap).alias("quantile"),
    )
