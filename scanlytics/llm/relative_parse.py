"""Duplicate passages by relative Lempel-Ziv parsing: documents are factored against all documents before them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlytics.llm import segments as S
from scanlytics.llm.common import stored

_MOST = 1 << 20
_RUN_BITS = 20
_CELLS = "id bigint, first bigint, n int, core bigint, whole bigint"


def cell_table(docs: DataFrame, shape: S.Shape, units) -> DataFrame:
    """The cells of every document (columns id, text): id, first, n, core, whole."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def items():
            for batch in batches:
                for key, text in zip(batch["id"], batch["text"]):
                    for offset, piece in S.pieces(units(text.encode("utf-8", "surrogatepass")), shape.window, _MOST):
                        yield key, piece, offset

        for held in S.batched(items(), _MOST):
            found = S.cells([h[1] for h in held], [h[2] for h in held], shape)
            if len(found.doc):
                keys = np.array([h[0] for h in held], np.int64)[found.doc]
                yield pd.DataFrame(
                    {"id": keys, "first": found.first, "n": found.count.astype(np.int32), "core": found.core, "whole": found.whole}
                )

    return docs.where("text <> ''").mapInPandas(task, _CELLS)


def pack(first: Column, n: Column) -> Column:
    """A run of n windows from ``first`` on as one number; lists of numbers reach numpy without objects."""
    return F.shiftleft(first, _RUN_BITS) + n


def unpack(runs: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    runs = np.asarray([] if runs is None else runs, np.int64)
    return runs >> _RUN_BITS, runs & ((1 << _RUN_BITS) - 1)


def merged(starts: np.ndarray, ends: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal runs covered by the stretches [start, end)."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    covered = np.zeros(size + 2, np.int8)
    covered[1:-1] = np.cumsum(steps[:-1]) > 0
    edges = np.flatnonzero(np.diff(covered))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def factors_of(first: np.ndarray, n: np.ndarray, reference: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The parse of one document, from left to right: rows of start, length, reference, offset.

    Given are runs of ``n`` windows from ``first`` on that document ``reference`` has from ``at`` on, no two of them over
    one window. A factor goes on as long as the next window is found at the next place of the same reference. It takes
    all words of its windows; the next factor takes the words after them, so no word is in two factors.
    """
    first, kept = np.unique(first, return_index=True)
    if not len(first):
        return np.zeros((0, 4), np.int64)
    n, reference, shift = n[kept], reference[kept], at[kept] - first
    goes_on = (first[1:] == first[:-1] + n[:-1]) & (reference[1:] == reference[:-1]) & (shift[1:] == shift[:-1])
    head = np.flatnonzero(np.r_[True, ~goes_on])
    last = np.r_[head[1:], len(first)] - 1
    end = first[last] + n[last] - 1 + window
    start = np.maximum(first[head], np.r_[0, end[:-1]])
    return np.stack([start, end - start, reference[head], start + shift[head]], axis=1)


def factor_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 13, with_text: bool = False
) -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256, factors and, if asked, kept_text.

    Every document is parsed against the documents with smaller ids. The index has all their blocks, the content-defined
    cells of windows of ``window`` words, each with the first place that has it (smallest id, then leftmost). The parse
    goes from left to right: a factor ``[start, length, reference, offset]`` says that these words stand in document
    ``reference`` from its word ``offset`` on, and goes on as long as the following blocks are found at the following
    places. Where a block is not found whole, at the ends of factors, its windows are looked up one by one among those
    of all blocks with the same core, with their first places. Words outside factors are literals and stay; words of
    factors are removed. Factors share no word, and the document is its literals and what its factors refer to.

    A factor is the longest along the first places of its blocks; one that only a later place continues is given as two.
    A null or empty text has no words. A null id is smaller than none and refers to none: such rows are kept whole.
    Rows that repeat an id must repeat its text; they are not earlier than each other and get equal results. Other
    columns are dropped.
    """
    shape = S.Shape(window=window, gram=max(1, min(5, window - 8)), span=window)
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    known = base.where("id IS NOT NULL")
    cells = cell_table(known, shape, S.word_units)
    indexed = cells.groupBy("core").agg(F.min("id").alias("core_first"), F.max("id").alias("core_last"))
    # written first, so that both sides of the join are shuffled and a core with very many cells can be split
    indexed = stored(indexed.where("core_first < core_last").select("core"), "cores")
    repeated = stored(cells.join(indexed, "core"), "cells")
    wholes = stored(repeated.groupBy("core", "whole").agg(F.min(F.struct("id", "first")).alias("source")), "wholes")
    several = wholes.groupBy("core").agg(F.count("*").alias("wholes")).where("wholes > 1")
    edges = wholes.join(several.select("core"), "core", "left_semi").select("core", "whole")
    marked = repeated.join(wholes, ["core", "whole"]).withColumn("run", pack(F.col("first"), F.col("n")))
    inside = _listed(marked.where("source.id < id"), "run", "source.first", "inside")
    open_cells = marked.where("source.id >= id").join(edges, ["core", "whole"], "left_semi")
    to_check = open_cells.groupBy("id").agg(F.collect_list("run").alias("open"))

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for key, value, runs in zip(batch["id"], batch["text"], batch["open"]):
                rolling = S.Rolling(S.word_units(value.encode("utf-8", "surrogatepass")))
                first, n = unpack(runs)
                place = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                middle = place + window // 2
                made.append((np.full(len(place), key), place, rolling.of(place, middle), rolling.of(middle, place + window)))
            columns = [np.concatenate(c) for c in zip(*made)]
            yield pd.DataFrame(dict(zip(["id", "place"], columns)) | {"head": columns[2].view(np.int64), "tail": columns[3].view(np.int64)})

    checked = known.join(to_check, "id").mapInPandas(windows, "id bigint, place bigint, head bigint, tail bigint")
    earliest = checked.groupBy("head", "tail").agg(F.min(F.struct("id", "place")).alias("source"))
    found = checked.join(earliest, ["head", "tail"]).where("source.id < id")
    hits = _listed(found.withColumn("run", pack(F.col("place"), F.lit(1))), "run", "source.place", "hits")
    parsed = known.join(inside, "id", "left").join(hits, "id", "left")
    rest = base.where("id IS NULL").withColumns({c: F.lit(None).cast("array<bigint>") for c in ("inside", "hits")})
    outputs = f"{doc_id} bigint, n_words bigint, n_removed bigint, kept_sha256 string, factors array<array<bigint>>"
    names = ["n_words", "n_removed", "kept_sha256", "factors"] + ["kept_text"] * with_text

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value, inside, hits in zip(batch["text"], batch["inside"], batch["hits"]):
                words = value.encode("utf-8", "surrogatepass").split()  # bytes part at exactly these six blanks
                found = [np.asarray(x, np.int64).reshape(-1, 3) for x in (inside, hits) if x is not None]
                factors, kept = [], words
                if found:
                    runs, reference, at = np.concatenate(found).T
                    parse = factors_of(*unpack(runs), reference, at, window)
                    factors = parse.tolist()
                    bounds = [0, *np.cumsum(parse[:, :2], axis=1).ravel().tolist(), len(words)]
                    kept = [w for a, b in zip(bounds[::2], bounds[1::2]) for w in words[a:b]]
                joined = b" ".join(kept)
                digest = hashlib.sha256(joined).hexdigest()
                row = [len(words), len(words) - len(kept), digest, factors]
                rows.append(row + [joined.decode("utf-8", "surrogatepass")] * with_text)
            made = pd.DataFrame(rows, columns=names, index=batch.index)
            yield pd.concat([batch["id"].rename(doc_id), made], axis=1)

    columns = ["id", "text", "inside", "hits"]
    return parsed.select(columns).unionByName(rest.select(columns)).mapInPandas(finish, outputs + ", kept_text string" * with_text)


def _listed(runs: DataFrame, run: str, at: str, name: str) -> DataFrame:
    """Per document one list of numbers, three for each run: the run, its reference and the place there."""
    threes = F.collect_list(F.array(F.col(run), F.col("source.id"), F.col(at).cast("long")))
    return runs.groupBy("id").agg(F.flatten(threes).alias(name))
