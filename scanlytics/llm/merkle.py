"""Merkle manifest of a table: leaves, subroots by language, one root, and a proof for every row.

Trees are cut into superblocks of 8 ** 4 consecutive nodes. Going up, each superblock of leaves becomes one outer node,
superblocks of these one node each, and so on. Going down, a superblock's nodes are cogrouped with the one outer row
that holds the way from its top to the root: the siblings on every level. No task holds more than one superblock.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from scanlytics.llm.cells import KEY, numbered, refine, row_mark, sortable
from scanlytics.llm.common import stored

ARITY = 8
LEVELS = 4
BLOCK = ARITY**LEVELS
#: A step on the way up: the place of the node among its run, and the run's other nodes in order.
_PATH = "array<struct<place:int,others:array<string>>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field_text(value: Column) -> Column:
    """``-`` for a null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field_text(v) for v in values]).cast("binary"), 256)


def hash_of(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode("ascii")).hexdigest()


def reduce_run(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes, and above them ``levels`` levels of hashes of ``ARITY`` consecutive ones each."""
    made = [nodes]
    for _ in range(levels):
        below = made[-1]
        made.append([hash_of(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return made


def steps(made: list[list[str]], at: int) -> Iterator[tuple[int, list[str]]]:
    """The way of node ``at`` of the lowest level up to the single top."""
    for nodes in made[:-1]:
        start, place = at // ARITY * ARITY, at % ARITY
        run = nodes[start : start + ARITY]
        yield place, run[:place] + run[place + 1 :]
        at //= ARITY


def fold(node: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a node and its way lead to."""
    for place, others in path:
        node = hash_of([*others[:place], node, *others[place:]])
    return node


def height(count: int) -> int:
    """Levels above ``count`` nodes until one remains."""
    levels = 0
    while count > 1:
        count, levels = -(-count // ARITY), levels + 1
    return levels


@dataclass
class Level:
    """Nodes of all trees at one height: ``tree, at, node, levels`` (how many are left to the tree's top)."""

    nodes: DataFrame

    def above(self) -> Level:
        """One node for each superblock, from groups of at most ``BLOCK``."""

        def up(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("at")
            left = int(frame["levels"].iloc[0])
            top = reduce_run(frame["node"].tolist(), min(LEVELS, left))[-1][0]
            return pd.DataFrame({"tree": frame["tree"].iloc[:1], "at": [int(frame["at"].iloc[0]) // BLOCK], "node": [top], "levels": [max(0, left - LEVELS)]})

        blocks = self.nodes.withColumn("block", F.floor(F.col("at") / BLOCK))
        made = blocks.groupBy("tree", "block").applyInPandas(up, "tree bigint, at bigint, node string, levels int")
        return Level(stored(made, "merkle-nodes"))

    def with_paths(self, outer: DataFrame) -> DataFrame:
        """``tree, at, path`` up to the top of ``outer`` (``tree, at, path`` of each superblock's node)."""

        def down(frame: pd.DataFrame, beyond: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("at")
            made = reduce_run(frame["node"].tolist(), min(LEVELS, int(frame["levels"].iloc[0])))
            rest = as_path(beyond["path"].iloc[0])
            paths = [as_rows([*steps(made, i), *rest]) for i in range(len(frame))]
            return pd.DataFrame({"tree": frame["tree"], "at": frame["at"], "path": paths})

        joined = cogrouped(self.nodes, outer).applyInPandas(down, f"tree bigint, at bigint, path {_PATH}")
        return stored(joined, "merkle-paths")


def as_path(rows) -> list[tuple[int, list[str]]]:
    return [(r["place"], list(r["others"])) for r in rows]


def as_rows(path: list[tuple[int, list[str]]]) -> list[dict]:
    return [{"place": place, "others": others} for place, others in path]


def cogrouped(nodes: DataFrame, outer: DataFrame):
    """The nodes and the outer row of each superblock, together in one task."""
    blocks = nodes.withColumn("block", F.floor(F.col("at") / BLOCK)).groupBy("tree", "block")
    return blocks.cogroup(outer.withColumn("block", F.col("at")).groupBy("tree", "block"))


def trees(nodes: DataFrame) -> tuple[list[Level], DataFrame]:
    """All levels from ``tree, at, node, levels`` up to one node for each tree, and these tops (``tree, node``)."""
    made = [Level(nodes)]
    while True:
        made.append(made[-1].above())
        if not made[-1].nodes.where("levels > 0").limit(1).count():
            return made, made[-1].nodes.select("tree", "node")


def outer_paths(levels: list[Level], beyond: DataFrame) -> DataFrame:
    """The ways of the superblocks of the lowest level; ``beyond`` (``tree, at, path``) leads on from the trees' tops."""
    paths = beyond
    for level in levels[-2:0:-1]:
        paths = level.with_paths(paths)
    return paths


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    doc_id: str = "doc_id", tree: str = "lang", text: str = "text",
) -> DataFrame:
    """Digest, subroot, root, proof and a check under tampering for every row.

    A leaf is the hash of the row's ``fields``; leaves of one ``tree`` value stand in the order of ``doc_id``, their tops
    in the bytewise order of the values, a null before all. Returns doc_id, leaf, subroot, root, proof_sha256,
    folded_root and verified. Where 3 divides the CRC-32 of the decimal id, the folded root is made from the row with
    A-Z of its text in lower case; elsewhere from the row itself.

    A null id comes first in its tree and is never tampered with. Rows that repeat an id stand in the order of their
    digests, equal rows in any; each is a leaf. A tree of one leaf is that leaf, as is a table of one tree its subroot.
    An empty table has no rows and so no root. Other columns are not looked at.
    """
    spark = docs.sparkSession
    lower = F.translate(F.col(f"`{text}`"), _UPPER, _LOWER)
    touched = F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    changed = digest(*[lower if f == text else F.col(f"`{f}`") for f in fields])
    group = F.col(f"`{tree}`").cast("string")
    # before all for a null; a blank, before any digit, ends the value
    order = F.coalesce(F.concat(F.lit("."), F.lower(F.hex(group.cast("binary")))), F.lit("-"))
    leaves = docs.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), order.alias("ordered"), digest(*[F.col(f"`{f}`") for f in fields]).alias("leaf"),
        F.when(touched, changed).alias("tampered"),
    )
    key = F.concat("ordered", F.lit(" "), sortable(F.col("doc_id")), F.left(F.col("leaf"), F.lit(16)), row_mark())
    leaves = stored(leaves.withColumn(KEY, key), "leaves")
    names = stored(leaves.groupBy("ordered").agg(F.count(F.lit(1)).alias("leaves")).withColumn(KEY, F.col("ordered")), "trees")
    # the trees in order: their numbers, and how many leaves stand before each
    by_name = refine(names, weight="leaves")
    inside = _before(numbered(names, by_name, "tree", {"leaves_before": ("bigint", [c.weight_before for c in by_name.leaves])}))
    inside = stored(inside, "tree-starts")

    placed = numbered(leaves, refine(leaves), "place").join(inside, "ordered")
    nodes = stored(
        placed.select("tree", (F.col("place") - F.col("start")).alias("at"), F.col("leaf").alias("node"), _height(F.col("leaves")).alias("levels"), F.col("doc_id").cast("string"), "tampered"),
        "leaf-nodes",
    )
    lower_levels, subroots = trees(nodes.select("tree", "at", "node", "levels"))
    count = inside.count()
    tops = subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("at"), "node", F.lit(height(count)).alias("levels"))
    upper_levels, root = trees(tops)
    ends = root.select("tree", F.lit(0).cast("bigint").alias("at"), F.array().cast(_PATH).alias("path"))
    # the way of each subroot goes on from the top of its tree
    to_root = Level(tops).with_paths(outer_paths(upper_levels, ends)) if count else ends
    beyond = to_root.select(F.col("at").alias("tree"), F.lit(0).cast("bigint").alias("at"), "path")
    whole = root.first()
    facts = subroots.select("tree", F.col("node").alias("subroot"), F.lit(whole.node if whole else None).cast("string").alias("root"))
    outer = outer_paths(lower_levels, beyond).join(facts, "tree")

    def finish(frame: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        leaf = frame["node"].tolist()
        made = reduce_run(leaf, min(LEVELS, int(frame["levels"].iloc[0])))
        rest, top = as_path(above["path"].iloc[0]), above["root"].iloc[0]
        proofs, folded = [], []
        for i, (own, other) in enumerate(zip(leaf, frame["tampered"])):
            path = [*steps(made, i), *rest]
            proofs.append(hash_of([node for _, others in path for node in others]))
            folded.append(fold(own if other is None else other, path))
        return pd.DataFrame({
            "doc_id": frame["doc_id"], "leaf": leaf, "subroot": above["subroot"].iloc[0], "root": top,
            "proof_sha256": proofs, "folded_root": folded, "verified": [f == top for f in folded],
        })

    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    finished = cogrouped(nodes, outer).applyInPandas(finish, schema)
    return finished.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def _height(count: Column) -> Column:
    """``height`` as a column: exact for any bigint."""
    steps_above = [F.when(count > ARITY**k, 1).otherwise(0) for k in range(21)]
    return sum(steps_above[1:], steps_above[0])


def _before(names: DataFrame) -> DataFrame:
    """``ordered, tree, start, leaves``: where each tree's leaves begin in the order of all."""
    inside = Window.partitionBy("leaves_before").orderBy("tree").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("leaves_before") + F.coalesce(F.sum("leaves").over(inside), F.lit(0))
    return names.select("ordered", "tree", start.alias("start"), "leaves")
