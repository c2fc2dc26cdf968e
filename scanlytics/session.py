"""Session settings and the shared folder used for checkpoints and intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Left to the cluster: master, memory, executor count and spark.sql.shuffle.partitions.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Rows that a task of a large join or roll-up gets. Spark's number of shuffle partitions does not follow the input, and AQE
#: merges partitions by their packed size, which says little about the memory of sorts and hash maps.
ROWS_PER_TASK = 1 << 19


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may go without it; it then gets a folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    named = named or context.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="scanlytics-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def tasks_for(spark: SparkSession, rows: int | None) -> int | None:
    """How many tasks so many rows need, ``ROWS_PER_TASK`` each; None if Spark's own choice is as many or they are not known."""
    tasks = -(-(rows or 0) // ROWS_PER_TASK)
    return tasks if tasks > spark.sparkContext.defaultParallelism else None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table, new on every call."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
