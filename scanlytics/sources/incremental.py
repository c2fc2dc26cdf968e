"""Snapshots that follow a folder of archives: only new and replaced archives are read.

A snapshot is three tables, each partitioned by ``load``, the number of the refresh that wrote it: ``rows`` (as
``landing`` stores them), ``cube`` (signed deltas of the additive measures) and ``manifest`` (every archive's size and
time, with the load that holds its rows). The manifest is written last and names the load that counts, so a refresh
that breaks off leaves the snapshot as it was and is simply run again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanlytics.functions.enrich import enrich
from scanlytics.operators.cube import CUBE_KEYS, activity_cube, measures, sums
from scanlytics.schema import RAW_SCHEMA
from scanlytics.session import scratch_path
from scanlytics.sources.archives import archive_files, common_folder, read_files
from scanlytics.sources.landing import landed_rows, write_by_year

_STATE = "archive string, modificationTime timestamp, length bigint, folder string, held_by int, live boolean, load int"
_MEASURES = measures("rows", "scans", "size")


def refresh(spark: SparkSession, archives: str, snapshot: str, hour_formats: Sequence[str] = ()) -> dict[str, int]:
    """Bring ``snapshot`` up to date with the archives below ``archives``; returns the load and what it found.

    An archive counts as unchanged when its path, size and time are those of the manifest. Rows of replaced and removed
    archives stay in their files, but are marked as dead in the manifest; the cube takes them back by negative
    measures, made from the landed rows, not from the old archive. Nothing is written when nothing changed. ``source_file`` is
    the entry's name with the archive's path below the folder common to all archives at the first refresh. An empty
    folder makes an empty snapshot.
    """
    old = manifest(spark, snapshot)
    load = 0 if old is None else _newest(old) + 1
    # written once: every use of the list would ask the store for each archive's size and time again
    listing = scratch_path(spark, "listing")
    archive_files(spark, archives).withColumnRenamed("path", "archive").write.parquet(listing)
    found = spark.read.schema("archive string, modificationTime timestamp, length bigint").parquet(listing)
    live = old.where("live") if old is not None else spark.createDataFrame([], _STATE)
    same = ["archive", "modificationTime", "length"]
    changed = found.join(live, same, "left_anti")
    gone = live.join(found, same, "left_anti")
    first = old.select("folder").first() if old is not None else None
    folder = first.folder if first else common_folder(found.withColumnRenamed("archive", "path"))[0]

    # written first: the states of archives must not be read again while the rows are
    path = scratch_path(spark, "refresh")
    state = changed.select(*same, F.lit(folder).alias("folder"), F.lit(load).alias("held_by"), F.lit(True).alias("live"))
    if old is not None:
        kept = live.join(gone.select("archive", "held_by"), ["archive", "held_by"], "left_anti")
        dead = gone.withColumn("live", F.lit(False)).unionByName(old.where("NOT live"))
        state = state.unionByName(kept.drop("load")).unionByName(dead.drop("load"))
    state.write.parquet(path)
    state = spark.read.schema(_STATE.removesuffix(", load int")).parquet(path)
    fresh = state.where(F.col("live") & (F.col("held_by") == load))
    counts = state.agg(
        F.count_if(F.col("live") & (F.col("held_by") == load)).alias("read"),
        F.count_if(F.col("live") & (F.col("held_by") < load)).alias("unchanged"),
        F.count_if(~F.col("live")).alias("dead"),
    ).first()
    taken_back = 0 if old is None else gone.count()
    done = {"load": load, "read": counts.read, "unchanged": counts.unchanged, "taken_back": taken_back}
    if old is not None and not counts.read and not taken_back:
        return done | {"load": load - 1}

    raw = read_files(fresh.withColumnRenamed("archive", "path"), folder)
    write_by_year(landed_rows(enrich(raw, hour_formats)), f"{snapshot}/rows/load={load}")
    delta = activity_cube(_rows(spark, snapshot).where(F.col("load") == load))
    if taken_back:
        # as the previous manifest has them: rows that were live then and are not now
        lost = state.where(~F.col("live")).select("archive", F.col("held_by").alias("load"))
        before = read_snapshot(spark, snapshot).join(lost, ["archive", "load"], "left_semi")
        minus = activity_cube(before)
        minus = minus.select(*CUBE_KEYS, *[(-F.col(m)).alias(m) for m in _MEASURES])
        delta = delta.unionByName(minus).groupBy(*CUBE_KEYS).agg(*sums("rows", "scans", "size"))
    delta.select(*CUBE_KEYS, *_MEASURES).write.mode("overwrite").parquet(f"{snapshot}/cube/load={load}")
    state.write.mode("overwrite").parquet(f"{snapshot}/manifest/load={load}")
    return done


def manifest(spark: SparkSession, snapshot: str) -> DataFrame | None:
    """The newest manifest, one row for each archive and load that holds or held its rows; None if no archive landed yet."""
    try:
        states = spark.read.schema(_STATE).parquet(f"{snapshot}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    newest = _newest(states)
    return None if newest is None else states.where(F.col("load") == newest)


def _newest(states: DataFrame) -> int | None:
    return states.agg(F.max("load")).first()[0]


def _rows(spark: SparkSession, snapshot: str) -> DataFrame:
    schema = landed_rows(enrich(spark.createDataFrame([], RAW_SCHEMA))).schema.add("load", T.IntegerType())
    return enrich(spark.read.schema(schema).parquet(f"{snapshot}/rows"))


def read_snapshot(spark: SparkSession, snapshot: str) -> DataFrame:
    """Activity rows of the archives that the newest manifest holds, with ``load``.

    Filters on ``year`` and ``hour_ts`` reach the scan. Dead rows go by an anti join with the manifest's dead archives;
    a snapshot without any is not joined.
    """
    state = manifest(spark, snapshot)
    if state is None:
        return enrich(spark.createDataFrame([], RAW_SCHEMA)).withColumn("load", F.lit(0))
    rows = _rows(spark, snapshot).where(F.col("load") <= _newest(state))
    dead = state.where("NOT live").select("archive", F.col("held_by").alias("load"))
    return rows if dead.isEmpty() else rows.join(dead, ["archive", "load"], "left_anti")


def read_snapshot_cube(spark: SparkSession, snapshot: str) -> DataFrame:
    """The cube of all that ``read_snapshot`` gives: the sum of the loads' deltas; no row is read."""
    state = manifest(spark, snapshot)
    if state is None:
        return activity_cube(enrich(spark.createDataFrame([], RAW_SCHEMA)))
    deltas = spark.read.parquet(f"{snapshot}/cube").where(F.col("load") <= _newest(state))
    return deltas.groupBy(*CUBE_KEYS).agg(*sums("rows", "scans", "size")).where("rows_all > 0")
