"""Benchmark decontamination with spaced seeds: substitutions inside a passage do not hide it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlytics.llm.common import stored
from scanlytics.llm.native import gram_hashes, plain_words, word_hashes

#: Seed tables of up to this many rows are sent to every executor (three numbers each); larger ones are joined by shuffles.
BROADCAST_SEEDS = 600_000
#: The same for the items' words, one number each.
BROADCAST_WORDS = 600_000

# 1 marks a word that counts, 0 one that is ignored. Every passage of 11 words or more of which a share of
# 0.8 agrees keeps a seed: its agreeing words come in so few runs that one has four words, or, with 11 or 15 words, all
# have three with one changed word between them.
MASKS = ("1111", "1110111")
#: Items of fewer words match only where all their words stand in a row,
LEAST_PARTIAL = 11
#: and of fewer than these not at all: they cannot be told from chance.
LEAST_ITEM = 5


@dataclass(frozen=True)
class Overlap:
    """What counts as a leak: any stretch of ``words`` words (of all, if the item is shorter) of which ``share`` agree."""

    words: int = 13
    share: float = 0.8


def seeds(hashes: Column) -> Column:
    """Hashes of every mask at every place; place i under mask k is element k * (number of places) + i.

    There are as many places for each mask as for the shortest; a longer one hashes what is left at a text's end.
    """
    span = min(map(len, MASKS))
    each = [gram_hashes(hashes, [i for i, c in enumerate(m) if c == "1"], span, k) for k, m in enumerate(MASKS)]
    return F.concat(*each)


def _seeded(rows: DataFrame) -> DataFrame:
    """Adds one row per seed: its hash and place.

    The outer form of explode keeps the optimizer from testing the seeds, and computing them, before it.
    """
    rows = rows.withColumn("seeds", seeds(F.col("words")))
    n = (F.size("seeds") / len(MASKS)).cast("int").alias("_n")
    exploded = rows.select(*[c for c in rows.columns if c != "seeds"], n, F.posexplode_outer("seeds").alias("_at", "seed"))
    return exploded.where("seed IS NOT NULL").withColumn("place", F.col("_at") % F.col("_n")).drop("_n", "_at")


def _stretch(equal: Column, need: Column, share: Column) -> Column:
    """Of the stretches of at least ``need`` places of which ``share`` are 1, the one with the most above the share.

    From prefix sums of (equal - share): each end meets the least sum that lies ``need`` places or more before it.
    ``end`` is 0 if there is none.
    """
    tiny = 1e-9
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("behind"), F.lit(0.0).alias("low"), F.lit(0).alias("low_at"),
        F.lit(-2 * tiny).alias("top"), F.lit(0).alias("first"), F.lit(0).alias("end"),
    )

    def step(s: Column, e: Column) -> Column:
        at, total = s["at"] + 1, s["sum"] + e - share
        behind = F.when(at > need, s["behind"] + F.get(equal, at - need - 1) - share).otherwise(F.lit(0.0))
        lower = (at > need) & (behind < s["low"] - tiny)
        low, low_at = F.when(lower, behind).otherwise(s["low"]), F.when(lower, at - need).otherwise(s["low_at"])
        better = (at >= need) & (total - low > s["top"] + tiny)
        return F.struct(
            at.cast("int").alias("at"), total.cast("double").alias("sum"), behind.cast("double").alias("behind"),
            low.cast("double").alias("low"), low_at.cast("int").alias("low_at"),
            F.when(better, total - low).otherwise(s["top"]).cast("double").alias("top"),
            F.when(better, low_at).otherwise(s["first"]).cast("int").alias("first"),
            F.when(better, at).otherwise(s["end"]).cast("int").alias("end"),
        )

    return F.aggregate(equal, start, step)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", overlap: Overlap = Overlap()
) -> DataFrame:
    """One row per document and benchmark item that share a passage: doc_id, item_id, first, length, matched, item_words.

    Words are runs of letters and digits in lower case. Every place of a document under every mask is hashed and joined
    with those of the benchmark, numbers only. What meets gives diagonals (document, item, shift), each once; then the
    words of both sides are brought to them and compared along the whole diagonal. Of its stretches that ``overlap``
    admits, the one with the most words above the share counts; ``first`` and ``length`` give the longest of a pair
    in the document (in words; the first among equals). With a ``share`` below 0.8 seeds may miss passages.

    Items of ``LEAST_ITEM`` to ``LEAST_PARTIAL`` - 1 words match only where all their words follow each other; shorter
    ones match nothing, nor do null or empty texts and rows with a null id. Repeated rows give their pair once. Other
    columns are dropped. The seeds and words of the benchmark are broadcast only after a count of them; beyond that the
    same joins shuffle.
    """
    items = benchmark.where(F.col(f"`{item_id}`").isNotNull()).select(
        F.col(f"`{item_id}`").alias("item"), word_hashes(plain_words(F.col(f"`{text}`"))).alias("item_words")
    )
    items = items.where(F.size("item_words") >= LEAST_ITEM).withColumn("item_key", F.xxhash64("item_words"))
    words = items.agg(F.sum(F.size("item_words"))).first()[0] or 0
    hinted = lambda df, small: F.broadcast(df) if small else df
    sought = _seeded(items.withColumnRenamed("item_words", "words"))
    sought = sought.select("seed", "item", "item_key", F.size("words").alias("item_size"), F.col("place").alias("item_place"))
    # a text is told from others of its id by a hash
    rows = docs.where(F.col(f"`{doc_id}`").isNotNull()).select(
        F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("doc_key")
    )
    seeded = _seeded(rows.select("doc", "doc_key", word_hashes(plain_words(F.col("text"))).alias("words")).select("doc", "doc_key", "words"))
    met = seeded.select("seed", "doc", "doc_key", "place").join(hinted(sought, words * len(MASKS) <= BROADCAST_SEEDS), "seed")
    diagonals = met.select("doc", "doc_key", "item", "item_key", "item_size", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    diagonals = stored(diagonals, "diagonals")

    of_hits = rows.join(diagonals.select("doc", "doc_key").distinct(), ["doc", "doc_key"], "left_semi").dropDuplicates(["doc", "doc_key"])
    of_hits = of_hits.select("doc", "doc_key", word_hashes(plain_words(F.col("text"))).alias("words"))
    # of a document only the words beside the item go on, of an item all
    low = F.greatest(F.lit(0), -F.col("shift"))
    begin = low + F.col("shift")
    beside = F.slice("words", begin + 1, F.least(F.col("item_size"), F.size("words") - F.col("shift")) - low)
    hits = diagonals.join(of_hits, ["doc", "doc_key"]).select("doc", "item", "item_key", "item_size", low.alias("low"), begin.alias("begin"), beside.alias("beside"))
    same_item = ["item", "item_key"]
    hits = hits.join(hinted(items.dropDuplicates(same_item), words <= BROADCAST_WORDS), same_item)
    agree = F.zip_with("beside", F.slice("item_words", F.col("low") + 1, F.size("beside")), lambda a, b: (a == b).cast("int"))
    compared = hits.select("doc", "item", "item_size", "begin", agree.alias("equal"))
    # exploded so that the conditions below read its fields instead of computing it again
    need = F.least(F.lit(overlap.words), F.col("item_size"))
    share = F.when(F.col("item_size") < LEAST_PARTIAL, 1.0).otherwise(overlap.share)
    # a stretch can only be there if so many words of the diagonal agree
    agreeing = F.aggregate("equal", F.lit(0), lambda a, e: a + e)
    stretch = F.when(agreeing >= need * share - 1e-9, _stretch(F.col("equal"), need, share))
    found = compared.select("*", F.explode_outer(F.array(stretch)).alias("kept")).where("kept.end > 0")
    length = F.col("kept.end") - F.col("kept.first")
    matched = F.aggregate(F.slice("equal", F.col("kept.first") + 1, length), F.lit(0), lambda a, e: a + e)
    found = found.select("doc", "item", "item_size", (F.col("begin") + F.col("kept.first")).alias("first"), length.alias("length"), matched.alias("matched"))
    best = found.groupBy("doc", "item").agg(F.max(F.struct("length", "matched", (-F.col("first")).alias("back"), "item_size")).alias("best"))
    return best.select(
        F.col("doc").alias(doc_id),
        F.col("item").alias(item_id),
        (-F.col("best.back")).cast("long").alias("first"),
        F.col("best.length").cast("long").alias("length"),
        F.col("best.matched").cast("long").alias("matched"),
        F.col("best.item_size").cast("long").alias("item_words"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", overlap: Overlap = Overlap()) -> DataFrame:
    """The documents that share no passage with the benchmark, columns as given. Rows with a null id stay."""
    leaked = find_leaks(docs, benchmark, doc_id=doc_id, text=text, overlap=overlap).select(doc_id).distinct()
    return docs.join(leaked, doc_id, "left_anti").select(docs.columns)
