"""Importance resampling towards a target: hashed n-gram ratios, summed exactly on bit planes, and a Gumbel top draw."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlytics.llm.cells import KEY, Cells, numbered, refine, row_mark, sortable
from scanlytics.llm.common import stored

BUCKETS = 10_000
#: Documents whose planes are in memory at once.
_TOGETHER = 64
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def features(text: bytes | None) -> tuple[np.ndarray, int]:
    """CRC-32 of every word and of every two consecutive words joined by a space, and how many words there are.

    Only A-Z are lower-cased; a word is a run of ASCII letters, digits and bytes beyond ASCII. The hash of a pair goes
    on from that of its first word.
    """
    words = text.translate(_WORD_BYTES).split() if text else []
    own = list(map(crc32, words))
    pairs = map(crc32, words[1:], map(crc32, repeat(b" "), own))
    return np.fromiter([*own, *pairs], np.int64, max(0, 2 * len(words) - 1)), len(words)


def bit_planes(values: np.ndarray, bits: int) -> np.ndarray:
    """Plane k holds bit k of every value, 64 to a word: (..., buckets) -> (bits, ..., words). Negative values are taken
    in two's complement, so the last plane is their sign."""
    lanes = -(-values.shape[-1] // 64) * 64
    padded = np.zeros((*values.shape[:-1], lanes), np.int64)
    padded[..., : values.shape[-1]] = values
    return np.stack([np.packbits((padded >> k & 1).astype(np.uint8), axis=-1).view(np.uint64) for k in range(bits)])


def plane_weights(bits: int) -> np.ndarray:
    """What a bit of each plane is worth, the sign plane's being negative."""
    worth = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
    worth[-1] = -worth[-1]
    return worth


def signed_bits(values: np.ndarray) -> int:
    return max(int(values.max(initial=0)).bit_length(), int(-values.min(initial=0) - 1).bit_length()) + 1


def plane_sums(counts: np.ndarray, gain_planes: np.ndarray) -> np.ndarray:
    """For every row of ``counts`` the sum of count times gain: planes are anded, their bits counted, and the counts
    added up by powers of two."""
    worth = plane_weights(len(gain_planes))
    total = np.zeros(len(counts), np.int64)
    for j, plane in enumerate(bit_planes(counts, int(counts.max(initial=0)).bit_length()) if counts.any() else []):
        shared = np.bitwise_count(plane[:, None, :] & gain_planes[None, :, :]).sum(axis=2, dtype=np.int64)
        total += (shared @ worth) << j
    return total


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """``bucket, n`` over all features of the column ``text``; every task adds up its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in _texts(batch):
                total += np.bincount(features(text)[0] % buckets, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """1000 times the log ratio of each bucket's smoothed shares in target and source, rounded down: ``buckets`` numbers."""
    spark = source.sparkSession
    joined = spark.range(buckets).withColumnRenamed("id", "bucket")
    joined = joined.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    counts = joined.na.fill(0, ["s", "t"]).select("bucket", "s", "t")
    counts = stored(counts, "bucket-counts")
    totals = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    as_double = lambda c: c.cast("double")
    above = as_double(F.col("t") + 1) * F.lit(float(totals.s + buckets))
    below = as_double(F.col("s") + 1) * F.lit(float(totals.t + buckets))
    gain = F.floor(1000 * F.ln(above / below)).cast("bigint")
    return np.array([r.gain for r in counts.select("bucket", gain.alias("gain")).orderBy("bucket").collect()], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of ``doc_id, text``; the weight is the mean gain, rounded down."""
    buckets = len(gains)
    gain_planes = bit_planes(gains, signed_bits(gains))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sums, words, sizes = _texts(batch), [], [], []
            for i in range(0, len(texts), _TOGETHER):
                found = [features(t) for t in texts[i : i + _TOGETHER]]
                at = np.concatenate([f % buckets + k * buckets for k, (f, _) in enumerate(found)])
                counts = np.bincount(at, minlength=len(found) * buckets).reshape(len(found), buckets)
                sums.append(plane_sums(counts, gain_planes))
                words += [w for _, w in found]
                sizes += [len(f) for f, _ in found]
            n = np.array(sizes, np.int64)
            mean = np.concatenate(sums) // np.maximum(n, 1) if sums else n
            columns = [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(n), pa.array(mean)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(weighed, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc_id: Column, seed: int) -> Column:
    """A Gumbel variate in thousandths, fixed by the seed and the id; a null id is written ``-``."""
    spelled = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("-")))
    number = F.conv(F.left(F.sha2(spelled.cast("binary"), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((number + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    buckets: int = BUCKETS, percent: int = 25, least_words: int = 20, seed: int = 7,
) -> DataFrame:
    """Weigh every document by how much more like ``target`` than like ``docs`` its words and word pairs are, and draw
    ``percent`` of those with ``least_words`` words in proportion to that.

    Features fall into ``buckets`` by CRC-32; a bucket's gain is the log ratio of its shares in both. A document's
    counts, cut into bit planes, are anded with the planes of the gains; counted bits times powers of two are the exact
    sum. The draw is the top of weight plus Gumbel noise, ranked from 1 on over all documents by exact positions in the
    order of scores (``cells``): no task ranks all rows, and rows beyond the draw are not moved.

    Returns doc_id, n_features, weight, score and rank (null: not drawn). A null or empty text has no feature and
    weight 0. Ties go to the smaller id, a null id before all; rows that repeat an id and a score rank in any order. An
    empty target has no feature; an empty table draws nothing. Other columns are not looked at.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    wanted = target.select(F.col(f"`{target_text}`").alias("text"))
    gains = bucket_gains(bucket_counts(rows, buckets), bucket_counts(wanted, buckets), buckets)
    scored = weigh(rows, gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    key = F.concat(sortable(-F.col("score")), sortable(F.col("doc_id")), row_mark())
    scored = stored(scored.withColumn(KEY, F.when(F.col("n_words") >= least_words, key)), "scored")
    able = scored.where(F.col(KEY).isNotNull())
    cells = refine(able)
    drawn = percent * cells.rows // 100
    ahead = [c for c in cells.leaves if c.rows_before < drawn]
    columns = ["doc_id", "n_features", "weight", "score"]
    beyond = scored if not ahead else scored.where(F.col(KEY).isNull() | (F.col(KEY) > ahead[-1].high))
    rest = beyond.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    if not ahead:
        return rest
    ranked = numbered(able.where(F.col(KEY) <= ahead[-1].high), Cells(ahead, cells.rounds), "rank")
    rank = F.when(F.col("rank") < drawn, F.col("rank") + 1).cast("bigint").alias("rank")
    return ranked.select(*columns, rank).unionByName(rest)
