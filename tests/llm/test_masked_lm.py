"""Language-model scoring: rare words count, ids grow, and the defaults learn every place."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scanlytics.llm import masked_lm


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def scores(df):
    return {r.doc_id: r.mean_log_likelihood for r in df.collect()}


def test_ids_grow_with_the_vocabulary():
    sizes = [masked_lm.Shape.of_vocabulary(n).ids for n in (10, 10_000, 400_000, 20_000_000)]
    assert sizes == sorted(sizes) and sizes[0] == masked_lm.Shape().ids and sizes[3] > 6 * sizes[2] > 12 * sizes[1]


def test_rare_words_are_told_apart(spark):
    rng = random.Random(1)
    shape = masked_lm.Shape(classes=4, members=4, unknown=2)
    common = [" ".join(rng.choice("abcdefghijklmn") for _ in range(40)) for _ in range(60)]
    docs = table(spark, list(enumerate(common + ["a b often c d"] * 9 + ["a b once c d"])))
    counted = masked_lm.word_counts(docs)
    frequent, shares = masked_lm.corpus_words(docs, shape, counted=counted)
    words, network = masked_lm.Words(shape, frequent), masked_lm.Network.start(shape, shares)
    assert not {"often", "once", "never"} & set(words.ids)
    never = next(w for w in ("never%d" % k for k in range(50)) if words.shared(w) == words.shared("often"))
    got = {r.doc_id: r for r in masked_lm.score(table(spark, [(1, "often"), (2, "once"), (3, never), (4, None), (1, "often")]), words, network, counted=counted).collect()}
    assert got[1].log_likelihood > got[3].log_likelihood + np.log(9 / 0.5) - 1e-6 and got[4].mean_log_likelihood is None
    # the probabilities of all counted words and of one that is not, under one context, sum to no more than one
    every = [r.w for r in counted.collect()]
    total = sum(np.exp(x) for x in scores(masked_lm.score(table(spark, list(enumerate(every))), words, network, counted=counted)).values())
    assert 0.9 < total < 1


@pytest.mark.parametrize("asked", [{}, {"every": 6}])
def test_each_place_is_learnt_once(spark, monkeypatch, asked):
    texts = ["one", "a b c", "d e f g h i j k", " ".join("w%d" % i for i in range(100))]
    rounds = []

    def recorded(docs, words, network, phase, text="text", every=1, **more):
        rounds.append((phase, every))
        return network

    monkeypatch.setattr(masked_lm, "train_round", recorded)
    masked_lm.score_documents(table(spark, list(enumerate(texts))), **asked)
    for t in texts:
        n = len(t.split())
        assert sorted(p for phase, every in rounds for p in masked_lm.learnt(t, n, phase, every)) == list(range(n))


def test_defaults_learn_order(spark):
    rng = random.Random(5)
    cycle = ["w%d" % i for i in range(30)]
    rows = [(d, " ".join(cycle[(d + k) % 30] for k in range(300))) for d in range(1_500)]
    mixed = [(10_000 + d, " ".join(rng.sample(t.split(), 300))) for d, t in rows[:20]]
    got = scores(masked_lm.score_documents(table(spark, rows + mixed)))
    assert min(got[d] for d in range(20)) > max(got[d] for d, _ in mixed) + 1


def test_a_step_is_adagrad_on_the_whole_gradient():
    shape = masked_lm.Shape(classes=3, members=4, unknown=2, side=1, width=3, hidden=5)
    rng = np.random.default_rng(3)
    weights = masked_lm.Network.start(shape, np.full(12, 1 / 12)).weights.astype(np.float64)
    network, squares = masked_lm.Network(shape, weights.copy()), masked_lm.Network(shape, np.full_like(weights, 1e-3))
    room, total = masked_lm.Network(shape, np.zeros_like(weights)), squares.weights.copy()
    for classes in (3, 1, 3):  # a class that is not met keeps its weights
        around, target = rng.integers(0, 13, (20, 2)), rng.integers(0, 4, 20) * 3 + rng.integers(0, classes, 20)
        g = masked_lm.Network(shape, weights).gradient(around, target).weights
        total += g * g
        weights = weights - 0.05 * g / np.sqrt(total)
        network.learn(around, target, squares, room, 0.05)
        assert np.allclose(network.weights, weights) and np.allclose(squares.weights, total)


def test_far_logits_are_told_apart():
    shape = masked_lm.Shape(classes=2, members=2, unknown=1, side=1, width=2, hidden=2)
    network = masked_lm.Network.start(shape, np.full(4, 0.25))
    network.at["class_bias"][:] = [500, -500]
    network.at["members"][:, -1] = [[-300, 300], [0, 0]]
    got = network.log_probabilities(np.full((4, 2), 4), np.arange(4))
    assert np.all(np.isfinite(got)) and np.allclose(got, [-600, -1000, 0, -1000], atol=2)


def test_words_are_those_of_split(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "_BYTES", 64)  # several pieces
    blank = "".join(c for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x30000)]) if c.isspace())
    texts = ["", None, " Ab  cd ", "A\u0130b \u039F\u03A3 x\u200by", blank + "a" + "b".join(blank) + "C", "ab " * 300, "\n", "one"]
    split = [(t or "").lower().split() for t in texts]
    words, lengths = masked_lm._split(pa.array(texts))
    assert words.to_pylist() == sum(split, []) and lengths.tolist() == [len(s) for s in split]
    pieces = list(masked_lm._pieces([pa.RecordBatch.from_pydict({"text": texts}), pa.RecordBatch.from_pydict({"text": ["z"]})], "text"))
    assert len(pieces) > 2 and [t for p in pieces for t in p.column("text").to_pylist()] == [*texts, "z"]
    got = {r.w: r.n for r in masked_lm.word_counts(table(spark, list(enumerate(texts)))).collect()}
    assert got == {w: sum(s.count(w) for s in split) for w in set(sum(split, []))}


def test_contexts_end_with_their_text():
    words = masked_lm.Words(masked_lm.Shape(classes=3, members=4, unknown=2), "abcdefghij")
    ids = np.arange(6)
    apart = [words.around(ids[a:b], np.array([b - a])) for a, b in ((0, 1), (1, 1), (1, 6))]
    assert np.array_equal(words.around(ids, np.array([1, 0, 5])), np.concatenate(apart))
    assert apart[2].tolist()[0] == [12, 12, 2, 3] and apart[2].tolist()[4] == [3, 4, 12, 12]


def test_words_at_hand_are_scored_as_joined_ones(spark):
    rng = random.Random(2)
    shape = masked_lm.Shape(classes=4, members=4, unknown=2)
    docs = table(spark, [(d, " ".join("w%d" % int(rng.expovariate(0.03)) for _ in range(50))) for d in range(80)] + [(100, None), (101, "never w1 w1")])
    counted = masked_lm.word_counts(docs.where("doc_id < 101"))
    frequent, shares = masked_lm.corpus_words(docs, shape, counted=counted)
    network = masked_lm.Network.start(shape, shares)
    seldom = masked_lm.seldom_words(counted, len(frequent))
    assert not set(seldom) & set(frequent) and len(seldom) == counted.count() - len(frequent)
    half = dict(list(seldom.items())[::2])
    joined, mixed, at_hand = (
        {r.doc_id: r for r in masked_lm.score(docs, masked_lm.Words(shape, frequent, some), network, counted=counted).collect()} for some in (None, half, seldom)
    )
    for d, r in joined.items():
        assert r.n_words == mixed[d].n_words == at_hand[d].n_words
        assert r.log_likelihood == pytest.approx(mixed[d].log_likelihood) == pytest.approx(at_hand[d].log_likelihood)


def test_few_rows_are_sorted_for_the_most_frequent_words(spark):
    counted = spark.range(1, 20_001).select(F.concat(F.lit("w"), F.col("id") % 7, F.lit("_"), "id").alias("w"), (F.lit(100_000) / F.col("id")).cast("bigint").alias("n"))
    every = sorted((-r.n, r.w) for r in counted.collect())
    for most in (0, 1, 500, 19_999, 30_000):
        assert [(-r.n, r.w) for r in masked_lm.most_frequent(counted, most).collect()] == every[:most]
    assert 500 <= masked_lm.at_least_as_frequent(counted, 500).count() < 560
