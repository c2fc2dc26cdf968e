"""Column expressions on words and their hashes; they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a regular expression class.
BLANK = r"[\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """The words that white space separates; none for a null or blank text."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{BLANK}+|{BLANK}+\z", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, rf"{BLANK}+"))


def plain_words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(split, lambda w: w != "")


def word_hashes(items: Column) -> Column:
    return F.transform(items, lambda w: F.xxhash64(w))


def gram_hashes(hashes: Column, places: list[int], span: int, salt: int = 0) -> Column:
    """From each place on: one hash of the words at the given offsets; none if fewer than ``span`` words."""
    at = F.sequence(F.lit(0), F.size(hashes) - span)
    made = F.transform(at, lambda i: F.xxhash64(F.lit(salt), *[F.get(hashes, i + p) for p in places]))
    return F.when(F.size(hashes) >= span, made).otherwise(F.array().cast("array<bigint>"))
