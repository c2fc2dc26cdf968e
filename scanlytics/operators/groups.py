"""Nested project groups: all projects below a group, at any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlytics.session import scratch_path


def projects_in_group(tree: DataFrame, group: str, contains: bool = False) -> DataFrame:
    """Distinct project names below every group named ``group``.

    ``tree`` has one row per child link: ``id, pid, name, isProject``. Paths double: each round every group's link is
    followed by that of the group it points to, so a round tells all that is up to 1, 2, 4, 8, ... levels below the
    wanted groups, and a chain of a thousand levels takes about ten rounds of two joins. Groups found need no link any
    more; links that end at the top, or in groups that have none, drop out. Links and findings are written to the shared folder, so a lost
    executor costs one round. Projects are joined once, at the end. On cyclic input the walk ends when no path can be
    longer. ``contains`` matches the name as a substring. A node that does not say whether it is a project is one.
    """
    spark, folder = tree.sparkSession, scratch_path(tree.sparkSession, "groups")
    tree = tree.withColumn("isProject", F.coalesce("isProject", F.lit(True)))
    kind = tree.schema["id"].dataType.simpleString()
    name = F.col("name")
    named = F.contains(name, F.lit(group)) if contains else name == group
    groups = tree.where(~F.col("isProject") & F.col("id").isNotNull())
    groups.where(named).select("id").distinct().write.parquet(f"{folder}/found/round=0")
    groups.select("id", "pid").where("pid IS NOT NULL").distinct().write.parquet(f"{folder}/links/round=0")

    def read(name: str, columns: str, last: int) -> DataFrame:
        return spark.read.schema(f"{columns}, round int").parquet(f"{folder}/{name}").where(F.col("round") == last)

    done, links = 0, read("links", f"id {kind}, pid {kind}", 0).drop("round")
    reach, most = 1, links.count()
    while reach <= 2 * most and not links.isEmpty():
        found = spark.read.schema(f"id {kind}, round int").parquet(f"{folder}/found").select("id")
        below = links.join(found.withColumnRenamed("id", "pid"), "pid", "left_semi").select("id").distinct()
        below.join(found, "id", "left_anti").write.parquet(f"{folder}/found/round={done + 1}")
        found = spark.read.schema(f"id {kind}, round int").parquet(f"{folder}/found").select("id")
        # what is found stays as a target, but need not be led further
        open_links = links.join(found, "id", "left_anti")
        further = links.select(F.col("id").alias("pid"), F.col("pid").alias("beyond"))
        doubled = open_links.join(further, "pid").select("id", F.col("beyond").alias("pid")).distinct()
        done, reach = done + 1, 2 * reach
        doubled.write.parquet(f"{folder}/links/round={done}")
        links = read("links", f"id {kind}, pid {kind}", done).drop("round")
    found = spark.read.schema(f"id {kind}, round int").parquet(f"{folder}/found").select(F.col("id").alias("pid"))
    projects = tree.where("isProject").select("pid", F.col("name").alias("projectName"))
    return projects.join(found, "pid", "left_semi").select("projectName").where(F.col("projectName").isNotNull()).distinct()
