"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlytics.llm.common import stored


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Columns ``id``, ``component`` (its least id) for every id in ``edges`` (``a``, ``b``, both bigint).

    Each round every node takes the least label among itself and its neighbours, then the label of that label, so
    chains shorten by half. Labels are written to the shared folder each round; only a count of changes reaches the
    driver. Ends when nothing changes; raises if that takes more than ``rounds``.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).selectExpr("a AS id", "least(a, b) AS component"), "labels")
    for _ in range(rounds):
        offered = both.join(labels, both["b"] == labels["id"]).select("a", "component")
        near = offered.unionByName(labels.selectExpr("id AS a", "component")).groupBy("a").agg(F.min("component").alias("c"))
        heads = labels.selectExpr("id AS head", "component AS beyond")
        jumped = near.join(heads, near["c"] == heads["head"], "left").selectExpr("a AS id", "least(c, beyond) AS component")
        old = labels.selectExpr("id", "component AS old")
        moved = stored(jumped.join(old, "id"), "labels")
        labels = moved.select("id", "component")
        if not moved.where("component <> old").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
