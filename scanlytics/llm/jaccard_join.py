"""Similarity join of documents on word n-grams: MinHash bands find candidates, full sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlytics.llm import segments as S
from scanlytics.llm.common import partitions, stored
from scanlytics.llm.components import components


@dataclass(frozen=True)
class Banding:
    """How many bands of how many rows catch a pair at ``threshold`` with probability ``recall`` at least."""

    threshold: float = 0.8
    recall: float = 0.9999
    rows: int = 4

    @property
    def bands(self) -> int:
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - self.threshold**self.rows)))


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted hashes of the text's different word n-grams; of all its words if they are fewer than n."""
    units = S.word_units(text.encode("utf-8", "surrogatepass"))
    return np.unique(S.Rolling(units).grams(min(n, len(units)))) if len(units) else units


def band_keys(sets: list[np.ndarray], banding: Banding) -> np.ndarray:
    """One row of band keys for each set; no set may be empty."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    values = np.concatenate(sets)
    rng = np.random.default_rng(20_240_229)
    odd = rng.integers(0, 1 << 63, (banding.bands, banding.rows), np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, (banding.bands, banding.rows), np.uint64)
    keys = np.empty((len(sets), banding.bands), np.uint64)
    for band in range(banding.bands):
        key = np.full(len(sets), band + 1, np.uint64)
        for row in range(banding.rows):
            key = S.mix(key ^ np.minimum.reduceat((values ^ shift[band, row]) * odd[band, row], starts))
        keys[:, band] = key
    return keys.view(np.int64)


def sketches(docs: DataFrame, n: int, banding: Banding) -> DataFrame:
    """id, size of the n-gram set, two hashes of the whole set, band keys (columns id, text; texts without words left out)."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.iloc[start : start + 500]
                found = [(key, s) for key, s in ((k, shingle_set(t, n)) for k, t in zip(part["id"], part["text"])) if len(s)]
                if not found:
                    continue
                sets = [s for _, s in found]
                yield pd.DataFrame(
                    {
                        "id": [key for key, _ in found],
                        "size": [len(s) for s in sets],
                        "sum1": np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64),
                        "sum2": np.array([S.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64),
                        "bands": list(band_keys(sets, banding)),
                    }
                )

    return docs.mapInPandas(task, "id bigint, size int, sum1 bigint, sum2 bigint, bands array<bigint>")


def linked_pairs(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets (rows) have which others (columns) at the threshold or above; exact."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(m), sizes)
    use = shared[inverse]
    owner, column = owner[use], column[inverse[use]]
    common = np.zeros((m, m), np.float64)
    by_column = np.argsort(column, kind="stable")
    owner, column = owner[by_column], column[by_column]
    width = max(1, 8_000_000 // m)
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (low, low + width))
        member = np.zeros((m, width), np.float32)
        member[owner[a:b], column[a:b] - low] = 1
        common += member @ member.T
    either = sizes[:, None] + sizes[None, :] - common
    linked = common >= threshold * either - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def _spanning(linked: np.ndarray) -> np.ndarray:
    """For each row, the least row that it hangs together with."""
    label = np.arange(len(linked))
    while True:
        least = np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, banding: Banding = Banding(), block: int = 192
) -> DataFrame:
    """Per document: class_id, n_links, set_id.

    Two documents are linked if the Jaccard similarity of their sets of word n-grams reaches the threshold (a text of
    fewer than n words is one gram). ``n_links`` counts the other rows that a row is linked with, copies included;
    ``class_id`` is the least id of all rows it hangs together with through links; ``set_id`` the least id with the
    same set. Equal sets are joined once. Documents that share a band key are candidates; candidates that hang
    together are compared in blocks of about ``block`` by ``block``, all pairs of blocks, on their full sets. Only
    counts and a spanning forest leave a task, so neither the rows nor a task grow with the square of a group.

    A null or empty text, or one of white space only, is linked with nothing and its own class. A null id gets a null
    class. Rows that repeat an id must repeat its text and are linked with each other. Other columns are dropped.
    """
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    known = base.where("id IS NOT NULL")
    sketched = stored(sketches(known, n, banding), "sketches")
    same = ["size", "sum1", "sum2"]
    sets = sketched.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    sets = stored(sets, "sets")
    keyed = sets.select("rep", F.explode("bands").alias("key"))
    leads = keyed.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("reps")).where("reps > 1")
    # every set takes its least lead; then only the few different labels of a key have to be brought together
    hits = stored(keyed.join(leads, "key").select("rep", "key", "lead"), "band-hits")
    first = stored(hits.groupBy("rep").agg(F.min("lead").alias("label")), "first-labels")
    labels = stored(hits.join(first, "rep").select("key", "label").distinct(), "key-labels")
    least = labels.groupBy("key").agg(F.min("label").alias("least"), F.count("*").alias("n")).where("n > 1")
    linked_labels = components(labels.join(least, "key").where("label <> least").selectExpr("label AS a", "least AS b").distinct())
    together = first.join(linked_labels, first["label"] == linked_labels["id"], "left")
    together = stored(together.select(F.col("rep").alias("id"), F.coalesce("component", "label").alias("component")), "candidates")
    sizes = together.groupBy("component").agg(F.count("*").alias("members"))
    placed = together.join(sizes, "component").withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    copies = sets.selectExpr("rep AS id", "copies")
    placed = placed.join(copies, "id").select("id", "component", "blocks", "own", "copies")

    def with_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch.drop(columns=["text"])
            out["grams"] = [shingle_set(t, n).tobytes() for t in batch["text"]]
            yield out

    chosen = known.dropDuplicates(["id"]) if _ids_repeat(sketched) else known
    held = chosen.join(placed, "id").select("id", "component", "blocks", "own", "copies", "text")
    held = held.mapInPandas(with_sets, "id bigint, component bigint, blocks int, own int, copies bigint, grams binary")
    dealt = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "copies", "grams"
    )
    pair = ["component", "low", "high"]
    dealt = dealt.repartition(2 * partitions(docs), *pair).sortWithinPartitions(*pair)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*pair, "own", "id", "copies", "grams"]
        rows = (row for batch in batches for row in zip(*[batch[c] for c in columns]))
        made: list[tuple] = []
        for (_, low, high), group in groupby(rows, key=lambda r: r[:3]):
            group = list(group)
            if len(group) < 2:
                continue
            linked = linked_pairs([np.frombuffer(r[6], np.uint64) for r in group], banding.threshold)
            if low != high:  # pairs inside one of the two blocks belong to that block alone
                own = np.array([r[3] for r in group])
                linked &= own[:, None] != own[None, :]
            ids = np.array([r[4] for r in group], np.int64)
            by_id = np.argsort(ids)
            linked, ids = linked[np.ix_(by_id, by_id)], ids[by_id]
            links = linked @ np.array([r[5] for r in group], np.int64)[by_id]
            lead = ids[_spanning(linked)]
            made += [row for row in zip(ids.tolist(), links.tolist(), lead.tolist()) if row[1]]
            if len(made) > 10_000:
                yield pd.DataFrame(made, columns=["id", "links", "lead"])
                made = []
        if made:
            yield pd.DataFrame(made, columns=["id", "links", "lead"])

    verified = stored(dealt.mapInPandas(compare, "id bigint, links bigint, lead bigint"), "links")
    classes = components(verified.selectExpr("id AS a", "lead AS b"))
    links = verified.groupBy("id").agg(F.sum("links").alias("links"))
    told = (
        sets.join(links, sets["rep"] == links["id"], "left").drop("id")
        .join(classes, F.col("rep") == classes["id"], "left")
        .select(*same, "rep", "copies", "links", "component")
    )
    members = sketched.select("id", *same).join(told, same)
    members = members.select(
        "id",
        F.coalesce("component", "rep").alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.col("rep").alias("set_id"),
    )
    rest = base.where("id IS NULL OR NOT rlike(text, '[^\\\\x20\\\\x09-\\\\x0D]')")
    alone = rest.select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("set_id"))
    return members.unionByName(alone).withColumnRenamed("id", doc_id)


def _ids_repeat(rows: DataFrame) -> bool:
    return bool(rows.groupBy("id").count().where("count > 1").limit(1).count())
