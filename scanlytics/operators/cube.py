"""The activity cube and roll-ups over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlytics.functions import columns as C
from scanlytics.functions.enrich import size_of
from scanlytics.schema import STATUSES
from scanlytics.session import tasks_for

CUBE_KEYS = [
    "source_file",
    "year",
    "scan_date",
    "hour_ts",
    "projectName",
    "has_project_column",
    "has_hour_column",
    "project_label",
    "scanType",
]

# Key columns of each grain; a grain's name lists its keys.
GRAINS = {
    "global": [],
    "year": ["year"],
    "project": ["projectName"],
    "year_project": ["year", "projectName"],
    "file": ["source_file"],
    "file_year": ["source_file", "year"],
    "file_project": ["source_file", "projectName"],
    "file_year_project": ["source_file", "year", "projectName"],
}
_GRAIN_KEYS = {"source_file": "file", "year": "year", "projectName": "project"}


def measures(*kinds: str, statuses: Sequence[str] = STATUSES) -> list[str]:
    return [f"{kind}_{status}" for kind in kinds for status in statuses]


def sums(*kinds: str, statuses: Sequence[str] = STATUSES) -> list[Column]:
    return [F.sum(m).alias(m) for m in measures(*kinds, statuses=statuses)]


def roll_up(activity: DataFrame, keys: Sequence[str], *kinds: str) -> DataFrame:
    return activity.groupBy(*keys).agg(*sums(*kinds))


def deal_out(activity: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows marked with their number (``sized``) dealt out by ``keys`` to as many tasks as they need; others as they are.

    For roll-ups by project and more, which leave nearly as many groups as rows: combining before the shuffle would hold
    them all in hash maps and save little, and the groups of one task would grow with the input. A roll-up to these keys
    needs no further shuffle. Keys without the project, or the project alone, have few values for their rows: those are
    left as they are, to be combined first.
    """
    tasks = tasks_for(activity.sparkSession, size_of(activity))
    if tasks is None or "projectName" not in keys or len(keys) < 2:
        return activity
    return activity.repartition(tasks, *keys)


def not_null(df: DataFrame, *keys: str) -> DataFrame:
    """A null in an explicit grouping key is no group."""
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df


def activity_cube(activity: DataFrame) -> DataFrame:
    """One row per file, hour, project label and scan type; all additive metrics derive from it.

    Map-side combine shrinks a hot project to at most one row per hour and type before the shuffle.
    """
    label = C.project_label(F.col("projectName"), F.col("versionName"))
    return roll_up(activity.withColumn("project_label", label), CUBE_KEYS, "rows", "scans", "size")


def unpivot_status(
    df: DataFrame, keys: Sequence[str], kinds: Sequence[str], statuses: Sequence[str] = STATUSES
) -> DataFrame:
    """One row per status that has at least one log row (needs the rows_* columns)."""
    entries = [
        F.struct(
            F.lit(status).alias("status"),
            *[F.col(f"{kind}_{status}").alias(kind) for kind in dict.fromkeys(["rows", *kinds])],
        )
        for status in statuses
    ]
    long = df.select(*keys, F.inline(F.array(*entries))).where(F.col("rows") > 0)
    return long if "rows" in kinds else long.drop("rows")


def by_grains(
    reduced: DataFrame, grains: Sequence[str], aggregates: Sequence[Column], also_by: Sequence[str] = ()
) -> DataFrame:
    """GROUP BY GROUPING SETS over the given grains, each with the ``also_by`` keys added.

    Feed it a roll-up to the finest grain, not raw rows: the sets multiply their input. No rows give no
    groups, the global one included; ``summary_totals`` is what reports an empty log.
    Returns ``grain, source_file, year, projectName, *also_by, *aggregates``.
    """
    unknown = set(grains) - set(GRAINS)
    if unknown:
        raise ValueError(f"unknown grains: {sorted(unknown)}")
    used = [k for k in _GRAIN_KEYS if any(k in GRAINS[g] for g in grains)]
    if not used:
        totals = reduced.groupBy(*also_by).agg(*aggregates)
        flagged = totals.withColumns({k: F.lit(None).cast(reduced.schema[k].dataType) for k in _GRAIN_KEYS if k in reduced.columns})
        named = flagged.withColumn("grain", F.lit("global"))
    else:
        sets = [[F.col(k) for k in [*GRAINS[g], *also_by]] for g in grains]
        flags = [F.grouping(k).alias(f"_no_{k}") for k in used]
        grouped = reduced.groupingSets(sets, *used, *also_by).agg(*flags, *aggregates)
        for k in used:
            grouped = grouped.where((F.col(f"_no_{k}") == 1) | F.col(k).isNotNull())
        parts = F.concat_ws("_", *[F.when(F.col(f"_no_{k}") == 0, F.lit(_GRAIN_KEYS[k])) for k in used])
        named = grouped.withColumn("grain", F.when(parts == "", "global").otherwise(parts))
        named = named.drop(*[f"_no_{k}" for k in used])
    for k in _GRAIN_KEYS:
        if k not in named.columns:
            named = named.withColumn(k, F.lit(None).cast("int" if k == "year" else "string"))
    lead = ["grain", *_GRAIN_KEYS, *also_by]
    return named.select(*lead, *[c for c in named.columns if c not in lead])


def finest_keys(grains: Sequence[str]) -> list[str]:
    """The keys a roll-up must keep so that all grains can be derived from it."""
    return [k for k in _GRAIN_KEYS if any(k in GRAINS[g] for g in grains)]
