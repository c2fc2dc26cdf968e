"""Leaks by the stated rule: any stretch of 13 words (of all, if the item is shorter) of which 0.8 agree."""

import itertools
import random

import brute
import pytest

from scanlytics.llm import decontamination


@pytest.mark.parametrize("words, changed", [(11, 2), (12, 2), (13, 2), (14, 2), (15, 3), (20, 4)])
def test_each_passage_keeps_a_seed(words, changed):
    for places in itertools.combinations(range(words), changed):
        agrees = "".join("0" if p in places else "1" for p in range(words))
        assert any(
            all(agrees[at + k] == "1" for k, c in enumerate(m) if c == "1") for m in decontamination.MASKS for at in range(words - len(m) + 1)
        )


def test_changes_near_the_ends(spark):
    rng = random.Random(6)
    items = [(n, ["w%dx%d" % (n, k) for k in range(n)]) for n in (10, 11, 12, 13, 14, 15, 16, 30)]
    docs = []
    for n, v in items:
        for places in [(0,), (3,), (n - 1,), (0, n - 1), (1, 2), (3, 7), (3, 7, 11), (0, 1, 2), *[tuple(rng.sample(range(n), 3)) for _ in range(6)]]:
            w = ["other" if k in places else x for k, x in enumerate(v)]
            docs.append((len(docs), ["before"] * 3 + w + ["after"] * 3))
    rows = lambda pairs: [(k, " ".join(w)) for k, w in pairs]
    table = spark.createDataFrame(rows(docs), "doc_id bigint, text string")
    bench = spark.createDataFrame(rows(items), "item_id bigint, text string")
    got = decontamination.find_leaks(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute.leaks(rows(docs), rows(items))
    assert all(r.length >= min(13, r.item_words) and r.matched >= 0.8 * r.length for r in got)
    for r in got:
        v, w = dict(items)[r.item_id], dict(docs)[r.doc_id]
        aligned = [sum(a == b for a, b in zip(w[r.first : r.first + r.length], v[k : k + r.length])) for k in range(len(v) - r.length + 1)]
        assert r.matched in aligned


@pytest.mark.parametrize("limit", [600_000, 0])
def test_long_items_and_documents(spark, monkeypatch, limit):
    """An item of 20,000 words, one of 6,000 and a document of a million: only numbers meet, and words come afterwards."""
    monkeypatch.setattr(decontamination, "BROADCAST_WORDS", limit)
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", limit)
    rng = random.Random(8)
    make = lambda n: ["v%d" % rng.randrange(1 << 30) for _ in range(n)]
    items = [(1, make(20_000)), (2, make(6_000)), (3, make(7)), (4, make(4))]
    changed = [w if k % 9 else "other" for k, w in enumerate(items[0][1])]
    million = make(500_000) + items[1][1][:5_000] + make(495_000)
    docs = [(1, changed), (2, million), (3, make(30) + items[2][1] + make(5)), (4, items[3][1]), (5, items[2][1][:6] + make(9)), (6, make(4_000))]
    rows = lambda pairs: [(k, " ".join(w)) for k, w in pairs]
    table = spark.createDataFrame(rows(docs), "doc_id bigint, text string")
    bench = spark.createDataFrame(rows(items), "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id, r.first, r.length, r.matched) for r in decontamination.find_leaks(table, bench).collect())
    agreeing = sum(k % 9 > 0 for k in range(20_000))  # the last word but one differs, so the last adds less than it costs
    assert got == [(1, 1, 1, 19_997, agreeing - 1), (2, 2, 500_000, 5_000, 5_000), (3, 3, 30, 7, 7)]
