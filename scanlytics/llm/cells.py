"""Exact positions in the order of a key, found by counting: histograms of key prefixes, refined where it matters.

No sample, no sort of all rows and no task that sees a group: each round counts the rows of every cell (the rows whose
keys share a prefix) and opens the cells that are too coarse. A cell's child prefixes begin behind what its least and
greatest key have in common, so one far key or a run of equal digits costs one round, not one for each digit. The driver
holds counts of cells only; their number follows from the limits, not from the rows.

Keys are ASCII strings whose byte order is the wanted order; they should differ for rows that are not the same.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A row's key; also the name of the internal columns, which begin with it.
KEY = "sort_key"
CELL = f"{KEY}_cell"
_ROWS_A_CELL = 512
_MOST_DIGITS = 4


def sortable(number: Column) -> Column:
    """16 hex digits in the order of the bigint; ``-``, before all, for a null."""
    return F.coalesce(F.lower(F.lpad(F.hex(number.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")), F.lit("-"))


def row_mark() -> Column:
    """16 hex digits that no two rows of a table have in common; fixed once the table is written."""
    return F.lower(F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))


@dataclass
class Cell:
    prefix: str
    rows: int
    weight: int
    low: str
    high: str
    #: Rows and weight of all cells before it.
    rows_before: int = 0
    weight_before: int = 0


@dataclass
class Cells:
    """Leaf cells in key order, and the rounds (prefix, length of its children's prefixes) that led to them."""

    leaves: list[Cell]
    rounds: list[dict[str, int]] = field(default_factory=list)

    @property
    def rows(self) -> int:
        return sum(c.rows for c in self.leaves)

    @property
    def weight(self) -> int:
        return sum(c.weight for c in self.leaves)


def _place(leaves: list[Cell]) -> list[Cell]:
    leaves.sort(key=lambda c: c.low)
    rows = weight = 0
    for cell in leaves:
        cell.rows_before, cell.weight_before = rows, weight
        rows, weight = rows + cell.rows, weight + cell.weight
    return leaves


def _opened_rows(keyed: DataFrame, opened: dict[str, int], how: str) -> DataFrame:
    """Rows with the child length of their cell; ``opened`` is bounded by the number of cells, so it is broadcast."""
    spark = keyed.sparkSession
    table = spark.createDataFrame(list(opened.items()), f"{KEY}_of string, {KEY}_length int")
    return keyed.join(F.broadcast(table), F.col(CELL) == F.col(f"{KEY}_of"), how).drop(f"{KEY}_of")


def _in_cells(keyed: DataFrame, rounds: list[dict[str, int]]) -> DataFrame:
    whole = rounds[0][""] if rounds else 0
    rows = keyed.withColumn(CELL, F.left(F.col(KEY), F.lit(whole)))
    for opened in rounds[1:]:
        child = F.left(F.col(KEY), F.col(f"{KEY}_length"))
        rows = _opened_rows(rows, opened, "left").withColumn(CELL, F.coalesce(child, F.col(CELL))).drop(f"{KEY}_length")
    return rows


def in_cells(keyed: DataFrame, cells: Cells) -> DataFrame:
    """Adds ``sort_key_cell``, the prefix of the leaf cell that each row is in."""
    return _in_cells(keyed, cells.rounds)


def refine(keyed: DataFrame, too_coarse: Callable[[list[Cell]], dict[str, int]] | None = None, weight: str | None = None) -> Cells:
    """Count the cells of ``keyed`` (column ``sort_key``, and the bigint column ``weight``, by default 1) until none
    holds more than about four times its share of rows and none is named by ``too_coarse``, which gets all cells in
    order and returns the prefixes to open, each with a number of digits.

    Read ``keyed`` from a written table: it is scanned once a round. A cell whose keys are all equal stays whole.
    """
    weighed = F.sum(F.col(weight) if weight else F.lit(1))
    counted = [F.count(F.lit(1)).alias("rows"), weighed.alias("weight"), F.min(KEY).alias("low"), F.max(KEY).alias("high")]
    root = keyed.select(KEY, *([weight] if weight else [])).agg(*counted).first()
    if not root.rows:
        return Cells([])
    cells = Cells([Cell("", root.rows, root.weight, root.low, root.high)])
    digits = min(_MOST_DIGITS, max(1, math.ceil(math.log(max(1, root.rows / _ROWS_A_CELL), 16))))
    limit = max(2 * _ROWS_A_CELL, 4 * root.rows // 16**digits)
    while True:
        wanted = {c.prefix: min(_MOST_DIGITS, max(1, math.ceil(math.log(c.rows / limit, 16)) + 1)) for c in cells.leaves if c.rows > limit}
        for prefix, more in (too_coarse(cells.leaves) if too_coarse else {}).items():
            wanted[prefix] = max(more, wanted.get(prefix, 0))
        if not cells.rounds:
            wanted[""] = digits
        opened = {c.prefix: len(os.path.commonprefix([c.low, c.high])) + wanted[c.prefix] for c in cells.leaves if c.prefix in wanted and c.low != c.high}
        if not opened:
            return cells
        inside = _in_cells(keyed.select(KEY, *([weight] if weight else [])), cells.rounds)
        if cells.rounds:
            inside = _opened_rows(inside, opened, "inner")
        else:
            inside = inside.withColumn(f"{KEY}_length", F.lit(opened[""]))
        found = inside.groupBy(F.left(F.col(KEY), F.col(f"{KEY}_length")).alias("prefix")).agg(*counted).collect()
        kept = [c for c in cells.leaves if c.prefix not in opened]
        cells.leaves = _place(kept + [Cell(r.prefix, r.rows, r.weight, r.low, r.high) for r in found])
        cells.rounds.append(opened)


def numbered(keyed: DataFrame, cells: Cells, position: str, columns: dict[str, tuple[str, list]] | None = None) -> DataFrame:
    """Adds ``position``, from 0 on in key order, and per-cell ``columns`` (name: type and one value for each leaf).

    One exchange: rows meet the rows of their own cell, are numbered there and shifted by the cells before.
    """
    columns = columns or {}
    spark: SparkSession = keyed.sparkSession
    names = "".join(f", `{name}` {kind}" for name, (kind, _) in columns.items())
    values = [(c.prefix, c.rows_before, *more) for c, *more in zip(cells.leaves, *[v for _, v in columns.values()])]
    table = spark.createDataFrame(values, f"{KEY}_of string, {KEY}_before bigint{names}")
    rows = _in_cells(keyed, cells.rounds)
    rows = rows.join(F.broadcast(table), F.col(CELL) == F.col(f"{KEY}_of")).drop(f"{KEY}_of")
    inside = F.row_number().over(W.partitionBy(CELL).orderBy(KEY)) - 1
    return rows.withColumn(position, F.col(f"{KEY}_before") + inside).drop(f"{KEY}_before", CELL)
