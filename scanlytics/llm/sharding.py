"""Histogram sort into shards of equal bytes: splitters by counting, one exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlytics.llm.cells import KEY, Cell, numbered, refine, row_mark
from scanlytics.llm.common import stored

LAW = "bytes"
#: A group of equal texts of at most this share of a mean shard is not cut.
TOLERANCE_PARTS = 100
_GROUP_DIGITS = 16
_PROBE_DIGITS = 3
_ADDED = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def group_of(key: str) -> str:
    return key[:_GROUP_DIGITS]


class Splitters:
    """Where shards begin. The key order is cut at equal steps of bytes: a row whose middle is byte m of all bytes goes
    to shard floor(shards * m / bytes). Rows of a group within the tolerance go where the group's middle goes."""

    def __init__(self, shards: int, parts: int):
        self.shards, self.parts = shards, parts

    def shard(self, halves: int, total: int) -> int:
        """The shard of a place given in half bytes."""
        return halves * self.shards // (2 * total)

    def starts(self, leaves: list[Cell]) -> dict[str, tuple[int, int]]:
        """Begin and bytes of every group that fills one leaf or several; leaves of several groups hold whole ones."""
        found: dict[str, tuple[int, int]] = {}
        for c in leaves:
            if group_of(c.low) == group_of(c.high):
                begin, weight = found.get(group_of(c.low), (c.weight_before, 0))
                found[group_of(c.low)] = begin, weight + c.weight
        return found

    def place(self, cell: Cell, groups: dict[str, tuple[int, int]], total: int) -> int | None:
        """The leaf's shard; None if a splitter lies in it and has to be looked for."""
        if group_of(cell.low) == group_of(cell.high):
            begin, weight = groups[group_of(cell.low)]
            if weight * self.shards * self.parts <= total:
                return self.shard(2 * begin + weight, total)
        begin, end = 2 * cell.weight_before, 2 * (cell.weight_before + cell.weight)
        if cell.rows == 1 or cell.low == cell.high:
            return self.shard((begin + end) // 2, total)
        first = self.shard(begin, total)
        return first if first == self.shard(end - 1, total) else None

    def too_coarse(self, leaves: list[Cell]) -> dict[str, int]:
        total, groups = leaves[-1].weight_before + leaves[-1].weight, self.starts(leaves)
        return {c.prefix: _PROBE_DIGITS for c in leaves if self.place(c, groups, total) is None}


def shard_documents(
    docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text",
    carry: Sequence[str] | None = None, tolerance_parts: int = TOLERANCE_PARTS,
) -> DataFrame:
    """Every row with its shard and its place (``slot``, from 0 on without a gap) in it; shards have near equal bytes.

    Rows are ordered by a hash of the text, then by one of the id, so copies lie together. Exact bytes below candidate
    boundaries are counted over all rows, first for evenly spaced prefixes of the key, then only in the cells in which
    a splitter still has to lie, until each splitter is settled: it falls between two rows, and not within a group of
    equal texts that has at most 1 / ``tolerance_parts`` of a mean shard. Larger groups are cut, so a shard's bytes
    differ from the mean by no more than the tolerance and half of each of the two rows at its ends. Then rows move once, into cells.

    Adds size (UTF-8 bytes of the text and 1; a null text: 1), text_crc32, law, shard, slot and grown_shard (null: under
    this law one more shard moves rows of all others). ``carry`` names the columns to keep, by default all; one named
    like an added column is replaced. Null ids count as equal ids, rows that repeat an id and a text are told apart by
    their place in the table written on the way, and an empty table has no shards.
    """
    columns = [c for c in (docs.columns if carry is None else carry) if c not in _ADDED]
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    group = F.left(F.md5(content.cast("binary")), F.lit(_GROUP_DIGITS))
    of_id = F.left(F.md5(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("-")).cast("binary")), F.lit(_GROUP_DIGITS))
    keyed = stored(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in columns]).alias("carried"),
            (F.octet_length(content) + 1).cast("bigint").alias("size"),
            F.crc32(content.cast("binary")).alias("text_crc32"),
            F.concat(group, of_id, row_mark()).alias(KEY),
        ),
        "sizes",
    )
    splitters = Splitters(shards, tolerance_parts)
    cells = refine(keyed, splitters.too_coarse, "size")
    groups, total = splitters.starts(cells.leaves), cells.weight
    shard_of = [splitters.place(c, groups, total) for c in cells.leaves]
    first_row: dict[int, int] = {}
    for c, shard in zip(cells.leaves, shard_of):
        first_row.setdefault(shard, c.rows_before)
    placed = numbered(keyed, cells, "at", {"shard": ("int", shard_of), "first_row": ("bigint", [first_row[s] for s in shard_of])})
    return placed.select(
        "carried.*",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("at") - F.col("first_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
