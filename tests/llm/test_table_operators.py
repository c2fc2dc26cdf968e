"""Sharding, resampling and the manifest against their plain versions, and on odd tables."""

import random

import numpy as np
import brute_tables as brute
import pytest
from pyspark.sql import functions as F
from scanlytics.llm import cells, fingerprints, merkle, resampling, sharding

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, sort_key int, shard string"


def docs(spark, rows):
    """(doc_id, text, lang) with columns named like those that operators use themselves."""
    return spark.createDataFrame([(d, t, g, "src" if d is None or d % 5 else None, len(t) if t else None, "x", 1, "y") for d, t, g in rows], SCHEMA)


def varied(count=700, seed=5):
    rng = random.Random(seed)
    words = ["The", "of", "and", "Éa", *[f"W{i}" for i in range(300)], *[f"w{i}" for i in range(300)]]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    copy, rows = make(30), []
    for d in range(count):
        text = copy if d % 3 == 0 else make(rng.choice([1, 5, 30, 120]))
        lang = "en" if d % 2 else rng.choice(["de", "fr", "", "éo", None])
        rows.append((d * d * 7 - 1000, text, lang))
    return [*rows, (1 << 62, None, "en"), (-(1 << 62), "", "single"), (5, make(9000), "zz"), (None, "A null id", "en")]


def as_dicts(table):
    return [r.asDict() for r in table.collect()]


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.mark.parametrize("block", [8, 64, 4096])
def test_manifest(spark, monkeypatch, block):
    levels = {8: 1, 64: 2, 4096: 4}[block]
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(merkle, "LEVELS", levels)
    table = docs(spark, varied(300 if block == 8 else 700))
    got = by_id(merkle.manifest(table).collect())
    assert got == brute.manifest(as_dicts(table))
    assert 0 < sum(r[6] for r in got) < len(got)


def test_manifest_of_odd_tables(spark):
    assert merkle.manifest(docs(spark, [])).isEmpty()
    one = docs(spark, [(3, "Only One", None)])
    assert by_id(merkle.manifest(one).collect()) == brute.manifest(as_dicts(one))
    assert merkle.manifest(one).first().root == merkle.manifest(one).first().leaf
    langs = docs(spark, [(i, "x", f"lang {i:03d}") for i in range(100)])
    assert by_id(merkle.manifest(langs).collect()) == brute.manifest(as_dicts(langs))
    same = docs(spark, [(None, "x", "en")] * 30 + [(7, "x", "en")] * 30)
    got = merkle.manifest(same).collect()
    assert len(got) == 60 and len({r.root for r in got}) == 1 and all(r.verified for r in got)


def sharded(table, **options):
    return by_id(sharding.shard_documents(table, **options).select("doc_id", "size", "text_crc32", "shard", "slot").collect())


def test_shards(spark):
    table = docs(spark, varied())
    plain = [(r.doc_id, r.text) for r in table.collect()]
    assert sharded(table) == brute.shards(plain)
    assert sharded(table, shards=3, tolerance_parts=2) == brute.shards(plain, 3, 2)
    kept = sharding.shard_documents(table)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "sort_key", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert {(r.doc_id, r.text) for r in kept.collect()} == set(plain)


def test_shards_are_near_equal_and_keep_small_groups(spark):
    rng = random.Random(2)
    rows = [(i, f"group {i % 400} " + "x" * (i % 400), "en") for i in range(4000)] + [(10_000 + i, "hot " * 50, "en") for i in range(2000)]
    rng.shuffle(rows)
    found = sharding.shard_documents(docs(spark, rows)).collect()
    total = sum(r["size"] for r in found)
    by_shard, by_text = {}, {}
    for r in found:
        by_shard.setdefault(r.shard, []).append(r)
        by_text.setdefault(r.text, set()).add(r.shard)
    assert sorted(by_shard) == list(range(16))
    for part in by_shard.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 16) <= total / 16 / 100 + 2 * 420
    cut = [t for t, s in by_text.items() if len(s) > 1]
    assert cut == [t for t in cut if t.startswith("hot") or 10 * len(t) > total / 1600]
    assert len(by_text["hot " * 50]) > 4


def test_shards_of_odd_tables(spark):
    assert sharding.shard_documents(docs(spark, [])).isEmpty()
    one = sharding.shard_documents(docs(spark, [(None, None, None)])).collect()
    assert [(r["size"], r.text_crc32, r.shard, r.slot) for r in one] == [(1, 0, 8, 0)]
    same = sharding.shard_documents(docs(spark, [(1, "abc", "en")] * 5000)).collect()
    sizes = [sum(r.shard == s for r in same) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 5000
    assert sorted((r.shard, r.slot) for r in same) == [(s, k) for s in range(16) for k in range(sizes[s])]


def resampled(table, target, **options):
    return by_id(resampling.resample(table, target, **options).collect())


def test_resampling(spark):
    table, target = docs(spark, varied()), docs(spark, [(1, "The of W1 w2 W1 Éa", "en"), (2, None, "en"), (3, "w7-w8, w7", "en")])
    plain, wanted = [(r.doc_id, r.text) for r in table.collect()], [r.text for r in target.collect()]
    got = resampled(table, target)
    assert got == brute.resampled(plain, wanted)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, sum(r[4] is not None for r in got) + 1))
    other = dict(buckets=97, percent=60, seed=11)
    assert resampled(table, target, least_words=3, **other) == brute.resampled(plain, wanted, least=3, **other)


def test_plane_sums_are_exact():
    rng = np.random.default_rng(1)
    for most, span in ((1, 5), (200, 30_000), (5000, 1)):
        counts = rng.integers(0, most + 1, (9, 333))
        counts[3] = 0
        gains = rng.integers(-span, span, 333)
        planes = resampling.bit_planes(gains, resampling.signed_bits(gains))
        assert (resampling.plane_sums(counts, planes) == counts @ gains).all()
    for edge in (-4, 3, 0, -1):
        gains = np.full(10, edge)
        planes = resampling.bit_planes(gains, resampling.signed_bits(gains))
        assert (resampling.plane_sums(np.ones((1, 10), int), planes) == 10 * edge).all()


def test_resampling_of_odd_tables(spark):
    empty, target = docs(spark, []), docs(spark, [(1, "a b", "en")])
    assert resampling.resample(empty, target).isEmpty()
    rows = [(d, t, "en") for d, t in ((None, None), (4, ""), (5, "\t;"), (6, "ab " * 20), (7, "ab " * 19), (None, "cd " * 30))]
    table = docs(spark, rows)
    for wanted in (empty, target):
        got = resampled(table, wanted, percent=100)
        assert got == brute.resampled([r[:2] for r in rows], [r.text for r in wanted.collect()], percent=100)
    same = resampling.resample(docs(spark, [(9, "w " * 25, "en")] * 4000), target).collect()
    assert sorted(r["rank"] for r in same if r["rank"]) == list(range(1, 1001)) and len(same) == 4000


def test_next_rows_of_far_and_null_ids(spark):
    """One far id and a third of null ids: all rows find their neighbour, and no cell holds more than its share."""
    rng = random.Random(6)
    rows = [(None if k % 3 == 0 else k * 5, f"text {rng.random()}") for k in range(9000)] + [(1 << 61, "far"), (-(1 << 61), "near")]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = fingerprints.with_next(table, "doc_id", "text").collect()
    follows = {r.text: r.next for r in got}
    assert len(got) == len(rows) == len(set(follows.values()))
    known = sorted(r for r in rows if r[0] is not None)
    assert all(follows[a[1]] == b[1] for a, b in zip(known, known[1:]))
    at, chain = "near", []
    while at not in chain[:1]:
        chain.append(at)
        at = follows[at]
    assert len(chain) == len(rows)
    keyed = table.select(F.concat(cells.sortable(F.col("doc_id")), F.lower(F.lpad(F.hex(F.xxhash64("text")), 16, "0"))).alias(cells.KEY))
    assert max(c.rows for c in cells.refine(keyed).leaves) <= 1024
    same = fingerprints.with_next(spark.createDataFrame([(1, "a")] * 3 + [(2, "b")], "doc_id bigint, text string"), "doc_id", "text").collect()
    assert sorted((r.text, r.next) for r in same) == [("a", "a"), ("a", "a"), ("a", "b"), ("b", "a")]


def test_merged_sketches_are_sketches_of_the_union(spark):
    rng = random.Random(1)
    texts = [(" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([1, 3, 5, 6, 40]))), " ".join(f"v{rng.randrange(10**6)}" for _ in range(rng.choice([2, 5, 200])))) for _ in range(200)]
    table = spark.createDataFrame([*texts, ("", ""), ("", "a b")], "a string, b string")
    a, b = fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))
    top = fingerprints._threshold(fingerprints.SCALE)
    for r in table.select(a.alias("a"), b.alias("b"), fingerprints.merged(a, b).alias("m")).collect():
        low = sorted({h for h in [*r.a, *r.b] if h < top})
        assert list(r.m) == (low or ([min([*r.a, *r.b])] if r.a or r.b else []))
