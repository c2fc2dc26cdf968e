"""Quality decisions: a document classifier's evidence with host and path posteriors by empirical Bayes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlytics.llm.common import stored

#: At most so many labelled documents train the classifier, chosen by a hash of their ids.
TRAINING_ROWS = 20_000
#: So many words per verdict make up the lexicon.
LEXICON_WORDS = 1_000
#: Site tables of up to this many rows are broadcast, larger ones joined by shuffles.
BROADCAST_SITES = 100_000

LETTERS = re.compile(r"[^\W\d_]+")
_ODD = np.zeros(256)
_ODD[[ord(c) for c in "#$%&*|{}[]<>=~^\\@_+/"]] = 1
_DIGIT = np.zeros(256)
_DIGIT[[ord(c) for c in "0123456789"]] = 1
_STOP = np.zeros(256)
_STOP[[ord(c) for c in ".,;:!?"]] = 1
SHAPE = ("length", "odd", "digits", "stops", "again", "distinct", "word_length", "lines_again", "upper")


def shape_features(text: str) -> list[float]:
    """Numbers that tell running text from noise; all 0 for an empty text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(SHAPE)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lines = [x for x in data.split(b"\n") if x]
    n, size = len(words), len(data)
    again = sum([a == b for a, b in zip(words, words[1:])])
    return [
        np.log1p(n),
        np.sqrt(counts @ _ODD / n),
        counts @ _DIGIT / size,
        counts @ _STOP / n,
        again / n,
        np.log1p(len(set(words))) / np.log1p(n),
        min(size / n, 40.0),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        counts[65:91].sum() / n,
    ]


def terms_of(text: str) -> set[str]:
    return set(LETTERS.findall(text.lower()))


def lexicon_features(text: str, lexicons: list[dict[str, float]]) -> list[float]:
    """For each lexicon: the highest weight of a word in the text, and the sum for 100 different words."""
    terms = terms_of(text)
    out = []
    for lexicon in lexicons:
        hits = [lexicon[w] for w in lexicon.keys() & terms] or [0.0]
        out += [max(hits), min(100 * sum(hits) / max(len(terms), 1), 50.0)]
    return out


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> Logistic:
        """Newton's method; a class with no row gives the other class's probability near 1."""
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.c_[np.ones(len(x)), (x - mean) / scale]
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 0.1
        w = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            gradient = z.T @ (p - y) + penalty * w
            curvature = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(curvature, gradient)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[0] + (x - self.mean) / self.scale @ self.weights[1:], -12, 12)


@dataclass
class Classifier:
    lexicons: list[dict[str, float]]
    good: Logistic
    clean: Logistic

    def features(self, texts) -> np.ndarray:
        rows = [shape_features(t) + lexicon_features(t, self.lexicons) for t in texts]
        return np.array(rows or np.zeros((0, len(SHAPE) + 2 * len(self.lexicons))), np.float64)


def _lexicon(counted: DataFrame, mark: str, marked: int, total: int) -> dict[str, float]:
    """The words with the most significant log odds of occurring in marked documents."""
    rest = max(total - marked, 1)
    odds = F.log((F.col(mark) + 0.5) / (marked + 1)) - F.log((F.col("n") - F.col(mark) + 0.5) / (rest + 1))
    error = F.sqrt(1 / (F.col(mark) + 0.5) + 1 / (F.col("n") - F.col(mark) + 0.5))
    best = counted.where(f"{mark} >= 3").select("word", odds.alias("odds"), (odds / error).alias("z")).where("z > 3.2")
    return {r.word: r.odds for r in best.orderBy(F.desc("z"), "word").limit(LEXICON_WORDS).collect()}


def train(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> Classifier:
    """Learns from at most ``training_rows`` labelled documents. Labels given more than once are averaged."""
    told = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id").agg(
        F.coalesce(F.avg("quality"), F.lit(1.0)).alias("quality"), F.coalesce(F.avg("toxic"), F.lit(0.0)).alias("toxic")
    )
    told = told.selectExpr("doc_id", "int(quality < 0.5) AS bad", "int(toxic >= 0.5) AS toxic")
    sample = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_rows)
    # its size is bounded by the parameter
    rows = stored(docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(sample), "doc_id"), "labelled")
    total, bad, toxic = rows.agg(F.count("*"), F.sum("bad"), F.sum("toxic")).first()
    bad, toxic = bad or 0, toxic or 0

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(w, b, t) for x, b, t in zip(batch["text"], batch["bad"], batch["toxic"]) for w in terms_of(x) if len(w) < 40]
            yield pd.DataFrame(found, columns=["word", "bad", "toxic"])

    counted = rows.mapInPandas(words, "word string, bad int, toxic int").groupBy("word")
    counted = stored(counted.agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum("toxic").alias("toxic")).where("bad >= 3 OR toxic >= 3"), "words")
    model = Classifier([_lexicon(counted, "bad", bad, total), _lexicon(counted, "toxic", toxic, total)], None, None)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": list(model.features(batch["text"])), "bad": batch["bad"], "toxic": batch["toxic"]})

    known = rows.mapInPandas(features, "x array<double>, bad int, toxic int").collect()
    width = len(SHAPE) + 2 * len(model.lexicons)
    x = np.array([r.x for r in known] + [[0.0] * width])  # one row of no weight keeps an empty table from failing
    model.good = Logistic.fit(x, np.array([1 - r.bad for r in known] + [1], np.float64))
    model.clean = Logistic.fit(x, np.array([1 - r.toxic for r in known] + [1], np.float64))
    return model


def evidence(docs: DataFrame, model: Classifier) -> DataFrame:
    """Per row: doc_id, key (hash of the text), host, path, and the classifier's log odds of good and of clean."""
    source = docs.select(
        "doc_id",
        F.xxhash64("text").alias("key"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("source", F.lit("")).alias("host"),
        F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).alias("path"),
    )

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = model.features(batch["text"])
            yield batch.drop(columns=["text"]).assign(good=model.good.logits(x), clean=model.clean.logits(x))

    return source.mapInPandas(task, "doc_id bigint, key bigint, host string, path string, good double, clean double")


def _strength(groups: DataFrame, mean: str) -> tuple[float, float]:
    """Pseudo-count of the Beta prior from which the groups' rates were drawn, by moments; and the overall rate."""
    n, rate, spread, inverse = groups.agg(
        F.count("*"),
        F.sum(F.col(mean) * F.col("n")) / F.sum("n"),
        F.sum(F.col("n") * F.col(mean) * F.col(mean)) / F.sum("n"),
        F.count("*") / F.sum("n"),
    ).first()
    if not n:
        return 1.0, 0.5
    rate = min(max(rate, 1e-4), 1 - 1e-4)
    between = max(spread - rate**2 - rate * (1 - rate) * inverse, 1e-9)
    return float(np.clip(rate * (1 - rate) / between - 1, 2.0, 10_000.0)), rate


def site_rates(scored: DataFrame) -> DataFrame:
    """Per path: how much its documents' site moves the log odds of good and of clean.

    Rates of hosts shrink toward the rate of all documents, and rates of paths toward their host's, each as strongly
    as the spread between groups leaves open; a site with few documents stays near its prior.
    """
    p = {k: 1 / (1 + F.exp(-F.col(k))) for k in ("good", "clean")}
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.avg(v).alias(k) for k, v in p.items()])
    paths = stored(paths, "paths")
    hosts = paths.groupBy("host").agg(
        F.sum("n").alias("n"), *[(F.sum(F.col(k) * F.col("n")) / F.sum("n")).alias(k) for k in p]
    )
    hosts = stored(hosts, "hosts")
    shrunk, terms = hosts, []
    for k in p:
        host_strength, rate = _strength(hosts, k)
        path_strength, _ = _strength(paths, k)
        shrunk = shrunk.withColumn(k, (F.col(k) * F.col("n") + rate * host_strength) / (F.col("n") + host_strength))
        terms.append((k, path_strength, rate))
    paths = paths.join(shrunk.select("host", *[F.col(k).alias(f"host_{k}") for k in p]), "host")

    def log_odds(c: Column) -> Column:
        c = F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
        return F.log(c / (1 - c))

    out = []
    for k, strength, rate in terms:
        posterior = (F.col(k) * F.col("n") + F.col(f"host_{k}") * strength) / (F.col("n") + strength)
        out.append((log_odds(posterior) - float(logit(rate))).alias(f"site_{k}"))
    return paths.select("path", *out)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, site_weight: float = 0.5, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, key, quality, clean (probabilities), keep.

    A document is kept if the probability that it is of good quality and not toxic reaches ``threshold``. Its log odds
    are the classifier's plus ``site_weight`` times what its host (source) and path (source and language) add. With no
    labels everything is kept. A null text counts as empty, a null source or language as "". Repeated rows are judged
    alike; ``key`` (hash of the text) tells rows with one id apart. Extra columns are ignored.
    """
    model = train(docs, labels, training_rows)
    scored = stored(evidence(docs, model), "evidence")
    sites = stored(site_rates(scored), "sites")
    few = sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES
    joined = scored.join(F.broadcast(sites) if few else sites, "path")
    chance = {k: 1 / (1 + F.exp(-(F.col(k) + site_weight * F.col(f"site_{k}")))) for k in ("good", "clean")}
    told = joined.select("doc_id", "key", chance["good"].alias("quality"), chance["clean"].alias("clean"))
    return told.withColumn("keep", F.col("quality") * F.col("clean") >= threshold)


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, columns as given."""
    told = judge(docs, labels, threshold)
    rejected = told.where("NOT keep").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.xxhash64("text").eqNullSafe(F.col("_key"))
    return docs.join(rejected, same, "left_anti").select(docs.columns)
