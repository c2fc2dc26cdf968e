"""Exact removal of repeated byte strings with suffix arrays over the places that can repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlytics.llm import segments as S
from scanlytics.llm.common import stored
from scanlytics.llm.relative_parse import cell_table, merged
from scanlytics.llm.suffix_array import common_prefixes, suffix_array

#: Places after which a phrase ends: the hash of the last CUT_GRAM bytes is 0 modulo CUT_EVERY.
CUT_GRAM, CUT_EVERY = 4, 12


def repeated_windows(strings: list[bytes], counts: np.ndarray, window: int) -> list[np.ndarray]:
    """For each string, which of its first ``counts`` windows of ``window`` bytes are also another's (or its own other).

    The strings are cut into phrases where their content says so; ids of phrases follow their bytes, no phrase begins
    another, and so the suffix array of the phrase ids has the suffixes that start at a cut in byte order. A window is
    the piece up to its first cut and what follows; windows are equal if these pieces are, and their suffixes lie in
    one stretch of the array in which neighbours share all the rest of the window.
    """
    lengths = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    data = b"".join(strings)
    rolling = S.Rolling(S.byte_units(data))
    total = len(data)
    owner = np.repeat(np.arange(len(strings)), lengths)
    cut = np.zeros(total + 1, bool)
    grams = rolling.grams(CUT_GRAM)
    cut[CUT_GRAM : CUT_GRAM + len(grams)] = grams % np.uint64(CUT_EVERY) == 0
    inside = np.zeros(total + 1, bool)
    inside[:-1] = np.arange(total) - begins[owner] >= CUT_GRAM
    cuts = np.flatnonzero(cut & inside)

    # phrases: from a string's begin or CUT_GRAM bytes before a cut, to the next cut or the string's end
    heads = np.union1d(begins, cuts)
    tails = np.append(heads[1:], total)
    head_owner = owner[heads]
    from_cut = cut[heads] & (heads != begins[head_owner])
    starts = np.where(from_cut, heads - CUT_GRAM, heads)
    phrases = [data[a:b] for a, b in zip(starts.tolist(), tails.tolist())]
    ids = {p: i + 2 for i, p in enumerate(sorted(set(phrases)))}
    last_of_string = np.append(head_owner[1:] != head_owner[:-1], True)
    text, phrase_at = [], []
    for k, (phrase, last) in enumerate(zip(phrases, last_of_string.tolist())):
        text.append(ids[phrase])
        phrase_at.append(k)
        if last:
            text.append(1)
            phrase_at.append(-1)
    text.append(0)
    phrase_at.append(-1)
    order = np.array(phrase_at)[np.array(suffix_array(text))]
    order = order[order >= 0]
    order = order[from_cut[order]]
    where = heads[order]
    shared = common_prefixes(rolling, where, ends[owner[where]], window) if len(where) else np.zeros(0, np.int64)
    rank = np.full(total + 1, -1, np.int64)
    rank[where] = np.arange(len(where))

    # every window's start, and its first cut that its own bytes decide
    n = counts.astype(np.int64)
    place = np.repeat(begins - np.cumsum(n) + n, n) + np.arange(n.sum())
    at = np.searchsorted(cuts, place + CUT_GRAM)
    first_cut = cuts[np.minimum(at, len(cuts) - 1)] if len(cuts) else np.full(len(place), total)
    none = (at >= len(cuts)) | (first_cut >= place + window)
    first_cut = np.where(none, place + window, first_cut)
    ahead = first_cut - place
    left = rolling.of(place, first_cut)
    stretch = np.zeros(len(place), np.int64)
    by_ahead = np.argsort(ahead, kind="stable")
    bounds = np.flatnonzero(np.r_[True, np.diff(ahead[by_ahead]) != 0, True]) if len(place) else np.zeros(0, np.int64)
    for a, b in zip(bounds[:-1], bounds[1:]):
        these = by_ahead[a:b]
        rest = window - int(ahead[these[0]])
        if rest > 0:
            stretch[these] = np.cumsum(shared < rest)[rank[first_cut[these]]]
    folded = S.mix(S.mix(left ^ S.mix(ahead.astype(np.uint64))) ^ stretch.astype(np.uint64)) if len(place) else np.zeros(0, np.uint64)
    _, inverse, times = np.unique(folded, return_inverse=True, return_counts=True)
    found = times[inverse] > 1 if len(place) else np.zeros(0, bool)
    return np.split(found, np.cumsum(n)[:-1]) if len(n) else []


def drop_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 400, hot: int = 64, most: int = 1 << 20, with_spans: bool = False
) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256 and, if asked, spans (byte ranges removed).

    A byte goes if a string of ``window`` bytes that covers it also starts anywhere else in the documents, each taken
    alone as UTF-8. Content-defined cells of windows whose core occurs once cannot repeat and are left out; cells met
    twice as a whole repeat in all their windows. What is left, one text for each different cell, is dealt out by core
    and decided by suffix arrays. A core with more than ``hot`` different cells is dealt out in narrower cells first.
    A core whose texts still have more than ``most`` bytes gathers in no task: its windows are counted by two hashes of
    64 bits each, wherever their texts lie.

    A null or empty text has no bytes. Rows with a null id are kept whole and repeat nothing. A row that repeats an id
    must repeat its text; it counts as another place, so strings of ``window`` bytes in it go. Other columns are
    dropped.
    """
    shape = S.Shape(window=window, gram=max(1, min(24, window // 4)), span=max(1, window // 3))
    fine = S.Shape(window=window, gram=shape.gram, span=max(1, window // 25))
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    known = base.where("id IS NOT NULL")
    cells = cell_table(known, shape, S.byte_units)
    cores = cells.groupBy("core").agg(F.count("*").alias("times")).where("times > 1").select("core")
    repeated = stored(cells.join(cores, "core"), "byte-cells")
    wholes = repeated.groupBy("core", "whole").agg(
        F.count("*").alias("times"), F.min(F.struct("id", "first")).alias("place"), F.first("n").alias("n")
    )
    several = wholes.groupBy("core").agg(F.count("*").alias("wholes")).where("wholes > 1")
    told = stored(wholes.join(several, "core", "left").where("times > 1 OR wholes > 1"), "byte-wholes")
    full = repeated.join(told.where("times > 1").select("core", "whole"), ["core", "whole"], "left_semi")
    full = full.select("id", "first", "n")
    # one text of each different cell of a core that has several; those met once ask, the others only answer
    asked = told.where("wholes > 1").select(
        F.col("place.id").alias("id"), F.col("place.first").alias("first"), "n", "core", (F.col("wholes") > hot).alias("hot")
    )
    by_doc = asked.groupBy("id").agg(F.collect_list(F.struct("first", "n", "core", "hot")).alias("cells"))

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, value, found in zip(batch["id"], batch["text"], batch["cells"]):
                data = value.encode("utf-8", "surrogatepass")
                rows = []
                for c in found:
                    stretch = data[c["first"] : c["first"] + c["n"] - 1 + window]
                    if not c["hot"]:
                        rows.append((c["core"], key, c["first"], c["n"], stretch))
                        continue
                    parts = S.cells([S.byte_units(stretch)], [c["first"]], fine)
                    for first, n, core in zip(parts.first.tolist(), parts.count.tolist(), parts.core.tolist()):
                        at = first - c["first"]
                        rows.append((core, key, first, n, stretch[at : at + n - 1 + window]))
                yield pd.DataFrame(rows, columns=["core", "id", "first", "n", "bytes"])

    dealt = known.join(by_doc, "id").mapInPandas(cut_out, "core bigint, id bigint, first bigint, n int, bytes binary")
    # the rows that repeat an id have given the same cells once each
    dealt = dealt.dropDuplicates(["id", "first", "n", "core"]) if _ids_repeat(known) else dealt
    dealt = stored(dealt, "byte-texts")
    large = dealt.groupBy("core").agg(F.sum(F.length("bytes")).alias("size")).where(F.col("size") > most).select("core")
    large = stored(large, "large-cores")
    tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    gathered = dealt.join(large, "core", "left_anti").repartition(tasks * 2, "core").sortWithinPartitions("core")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All rows of a core come one after the other; texts are taken by whole cores, about 2 MB at a time."""
        waiting, size, rows, current = [], 0, [], None
        for batch in batches:
            for core, *row in zip(batch["core"], batch["id"], batch["first"], batch["n"], batch["bytes"]):
                if core != current:
                    if len(rows) > 1:
                        waiting += rows
                        size += sum(len(r[3]) for r in rows)
                    rows, current = [], core
                    if size > 2_000_000:
                        yield _decided(waiting, window)
                        waiting, size = [], 0
                rows.append(row)
        if len(rows) > 1:
            waiting += rows
        if waiting:
            yield _decided(waiting, window)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = batch["n"].to_numpy(np.int64)
            lengths = batch["bytes"].map(len).to_numpy(np.int64)
            rolling = S.Rolling(S.byte_units(b"".join(batch["bytes"])))
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(np.cumsum(lengths) - lengths, n) + step
            head, tail = rolling.of(at, at + window // 2), rolling.of(at + window // 2, at + window)
            yield pd.DataFrame(
                {"id": np.repeat(batch["id"].to_numpy(), n), "first": np.repeat(batch["first"].to_numpy(), n) + step,
                 "head": head.view(np.int64), "tail": tail.view(np.int64)}
            )

    spread = dealt.join(large, "core", "left_semi").mapInPandas(hashed, "id bigint, first bigint, head bigint, tail bigint")
    again = spread.groupBy("head", "tail").agg(F.count("*").alias("times")).where("times > 1")
    counted = spread.join(again, ["head", "tail"], "left_semi").select("id", "first", F.lit(1).alias("n"))
    partial = gathered.mapInPandas(decide, "id bigint, first bigint, n int")
    spans = full.unionByName(partial).unionByName(counted).groupBy("id").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    parsed = known.join(spans, "id", "left").select("id", "text", "runs")
    rest = base.where("id IS NULL").withColumn("runs", F.lit(None).cast("array<struct<first:bigint,n:int>>"))
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["spans"] * with_spans

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value, runs in zip(batch["text"], batch["runs"]):
                data = value.encode("utf-8", "surrogatepass")
                found, kept = [], data
                if runs is not None:
                    first = np.array([r["first"] for r in runs], np.int64)
                    n = np.array([r["n"] for r in runs], np.int64)
                    found = merged(first, first + n - 1 + window, len(data))
                    bounds = [0, *[x for f in found for x in f], len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
                row = [len(data), len(data) - len(kept), len(found), hashlib.sha256(kept).hexdigest()]
                rows.append(row + [[list(f) for f in found]] * with_spans)
            yield pd.concat([batch["id"].rename(doc_id), pd.DataFrame(rows, columns=names, index=batch.index)], axis=1)

    outputs = f"{doc_id} bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return parsed.unionByName(rest).mapInPandas(finish, outputs + ", spans array<array<bigint>>" * with_spans)


def _decided(rows: list[tuple], window: int) -> pd.DataFrame:
    found = repeated_windows([r[3] for r in rows], np.array([r[2] for r in rows]), window)
    out = []
    for (key, first, n, _), hits in zip(rows, found):
        edges = np.flatnonzero(np.diff(np.r_[0, hits.astype(np.int8), 0]))
        out += [(key, first + a, b - a) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
    return pd.DataFrame(out, columns=["id", "first", "n"])


def _ids_repeat(docs: DataFrame) -> bool:
    return bool(docs.groupBy("id").count().where("count > 1").limit(1).count())
