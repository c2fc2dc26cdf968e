"""Substring search over project names from a trigram index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlytics.operators.cube import not_null
from scanlytics.operators.ranking import row_positions

_LONGEST = 3
#: So many of the pattern's rarest grams are intersected; the names left are checked.
_GRAMS_USED = 4
_BUCKETS = 1024
_NAMES, _COUNTS, _POSTINGS = "projectName string, name_no bigint", "gram string, names bigint", "gram string, name_no bigint"


def _grams(text, length: int):
    starts = F.sequence(F.lit(1), F.char_length(text) - length + 1)
    made = F.transform(starts, lambda i: F.substring(text, i, F.lit(length)))
    return F.when(F.char_length(text) >= length, made).otherwise(F.array().cast("array<string>"))


def build_name_index(activity: DataFrame, path: str) -> None:
    """Write the index of all distinct project names below ``path``: ``names`` (sorted by number), ``postings`` (each run
    of one to three characters of a name in lower case, sorted) and ``grams`` (how many names have it).

    The rows are read once. No name and no gram gathers in one task: postings are dealt out by gram and number.
    """
    spark = activity.sparkSession
    names = not_null(activity, "projectName").select("projectName").distinct()
    bucket = F.pmod(F.xxhash64("projectName"), F.lit(_BUCKETS))
    numbered = row_positions(names, [], "projectName", bucket, "name_no").withColumn("name_no", F.col("name_no").cast("bigint"))
    numbered.select("projectName", "name_no").write.mode("overwrite").parquet(f"{path}/names")
    stored = spark.read.schema(_NAMES).parquet(f"{path}/names")
    lower = F.lower("projectName")
    all_grams = F.array_distinct(F.concat(*[_grams(lower, n) for n in range(1, _LONGEST + 1)]))
    postings = stored.select(F.explode(all_grams).alias("gram"), "name_no")
    postings.repartitionByRange("gram", "name_no").sortWithinPartitions("gram", "name_no").write.mode("overwrite").parquet(f"{path}/postings")
    counted = spark.read.schema(_POSTINGS).parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    counted.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/grams")


def search_names(spark: SparkSession, path: str, text: str | None) -> DataFrame:
    """``projectName`` of every indexed name that contains ``text``, regardless of case; all for an empty text.

    The pattern's grams are looked up in the counts (a few rows), the postings of the rarest are read and intersected,
    and the names left are checked. A gram that no name has ends the search.
    """
    names = spark.read.schema(_NAMES).parquet(f"{path}/names")
    if not text:
        return names.select("projectName")
    low = text.lower()
    size = min(_LONGEST, len(low))
    grams = sorted({low[i : i + size] for i in range(len(low) - size + 1)})
    counts = spark.read.schema(_COUNTS).parquet(f"{path}/grams").where(F.col("gram").isin(grams))
    known = {r.gram: r.names for r in counts.collect()}
    if len(known) < len(grams):
        return names.select("projectName").limit(0)
    rarest = sorted(grams, key=lambda g: (known[g], g))[:_GRAMS_USED]
    postings = spark.read.schema(_POSTINGS).parquet(f"{path}/postings").where(F.col("gram").isin(rarest))
    if len(rarest) > 1:
        postings = postings.groupBy("name_no").agg(F.count(F.lit(1)).alias("found")).where(F.col("found") == len(rarest))
    left = names.join(postings.select("name_no"), "name_no", "left_semi")
    return left.where(F.contains(F.lower("projectName"), F.lit(low))).select("projectName")
