"""Threshold-scaled sketches: every shingle hash below a fixed share of the hash range is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanlytics.llm.cells import CELL, KEY, in_cells, refine, sortable
from scanlytics.llm.common import stored
from scanlytics.llm.native import gram_hashes, word_hashes, words

SHINGLE = 5
#: One hash in SCALE is kept, whatever the document's length, so sketches merge and compare by plain set operations.
SCALE = 4


def _threshold(scale: int) -> int:
    return -(1 << 63) + (1 << 64) // scale


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted array of the kept hashes of the text's word shingles.

    A text of fewer words than a shingle has one shingle of all its words. If no hash lies below the threshold the
    least one is kept, so that only a text without words has an empty sketch.
    """
    items = words(text)
    return F.transform(F.array(items), lambda w: _kept(w, shingle, scale))[0]


def _kept(items: Column, shingle: int, scale: int) -> Column:
    hashes = F.transform(F.array(word_hashes(items)), lambda h: F.when(
        F.size(h) >= shingle, gram_hashes(h, list(range(shingle)), shingle)
    ).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>")))[0]

    def below(h: Column) -> Column:
        low = F.filter(h, lambda x: x < F.lit(_threshold(scale)))
        return F.when((F.size(low) > 0) | (F.size(h) == 0), low).otherwise(F.array(F.array_min(h)))

    return F.array_sort(F.array_distinct(F.transform(F.array(hashes), below)[0]))


def as_text(kept: Column) -> Column:
    """Twelve hexadecimal digits for each hash, in ascending order."""
    digits = F.transform(kept, lambda h: F.lpad(F.lower(F.hex(F.shiftright(h.bitwiseAND(F.lit((1 << 63) - 1)), 15))), 12, "0"))
    return F.array_join(digits, "")


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first document's shingles that the second has too, however much longer that is.

    1 for two documents without words, 0 if only the first has none.
    """
    return F.when(F.size(a) > 0, shared(a, b) / F.size(a)).otherwise(F.when(F.size(b) == 0, 1.0).otherwise(0.0))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets."""
    both = F.size(a) + F.size(b) - shared(a, b)
    return F.when(both > 0, shared(a, b) / both).otherwise(1.0)


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of both documents' shingles together. A least hash that stood in for an empty sketch goes as soon as
    the other has one below the threshold; of two such hashes the lesser stays."""
    both = F.array_union(a, b)
    low = F.filter(both, lambda x: x < F.lit(_threshold(scale)))
    return F.array_sort(F.when((F.size(low) > 0) | (F.size(both) == 0), low).otherwise(F.array(F.array_min(both))))


def with_next(docs: DataFrame, doc_id: str, column: str) -> DataFrame:
    """Adds ``next``: the column's value in the next row by id (equal ids by a hash of the value), after the last that of
    the first.

    Rows are dealt out in cells of the order whose sizes are counted first (``cells``), so neither one far id nor many
    null ids, which come first, gather in a task. Each cell finds its own neighbours; its last row gets the first value
    of the next cell.
    """
    key = F.concat(sortable(F.col(doc_id)), F.lower(F.lpad(F.hex(F.xxhash64(column)), 16, "0")))
    cells = refine(stored(docs.select(key.alias(KEY)), "id-order"))
    rows = in_cells(docs.withColumn(KEY, key), cells)
    inside = Window.partitionBy(CELL).orderBy(KEY)
    seen = rows.withColumns({"_next": F.lead(column).over(inside), "_inner": F.lead(F.lit(True)).over(inside)})
    lows = [c.low for c in cells.leaves]
    follows = docs.sparkSession.createDataFrame(
        [(c.prefix, low) for c, low in zip(cells.leaves, lows[1:] + lows[:1])], "_of string, _low string"
    )
    begins = docs.withColumn(KEY, key).join(F.broadcast(follows), F.col(KEY) == F.col("_low"))  # one row or copies of it
    begins = begins.groupBy("_of").agg(F.first(column).alias("_first"))
    joined = seen.join(begins, F.col(CELL) == F.col("_of"), "left")
    return joined.withColumn("next", F.when(F.col("_inner"), F.col("_next")).otherwise(F.col("_first"))).drop(KEY, CELL, "_next", "_inner", "_of", "_first")


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how near they and the next document's are.

    The edited text ends in the first floor(n_chars / 4) code points of the next document by id instead of as many of
    its own; after the last document comes the first. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next (how much of the document the edited text and the next document
    contain) and resemblance_edited. A null text counts as empty. Rows that repeat an id follow each other by a hash of the text.
    Other columns are dropped.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = with_next(rows, "id", "text")
    n = F.length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - tail), F.substring(F.col("next"), F.lit(1), tail))
    rows = rows.select("id", n.cast("long").alias("n_chars"), "text", "next", edited.alias("edited"))
    rows = rows.select(
        "id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch(F.col("text")).alias("own"),
        sketch(F.col("edited")).alias("changed"),
        sketch(F.col("next")).alias("following"),
    )
    return rows.select(
        F.col("id").alias(doc_id),
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        containment(F.col("own"), F.col("changed")).alias("near_edited"),
        containment(F.col("own"), F.col("following")).alias("near_next"),
        resemblance(F.col("own"), F.col("changed")).alias("resemblance_edited"),
    )
