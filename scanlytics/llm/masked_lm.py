"""Masked pseudo-likelihood: every word is predicted from the words on both sides of it."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlytics.llm.common import stored, text_or_empty

_CHUNK = 16_384
#: Rows, and weights, that are worked on at once, so that they stay in a core's cache.
_ROWS, _BLOCK = 2_048, 32_768
#: Weights that a task sends for averaging in one row.
_WEIGHTS = 4_096
#: Bytes of texts that are split at once.
_BYTES = 1 << 21
#: So many words after the frequent ones are sent to tasks with their counts; those of all others are joined.
_SENT = 65_536
#: The count that a word gets which the counted documents do not have.
_UNSEEN = 0.5


@dataclass(frozen=True)
class Shape:
    """Ids are dealt into ``classes`` classes of ``members``; a word's probability is its class's times its own in it."""

    classes: int = 32
    members: int = 32
    unknown: int = 64
    side: int = 2
    width: int = 16
    hidden: int = 32

    @classmethod
    def of_vocabulary(cls, different: int) -> Shape:
        """Ids grow with the square root of how many different words there are: 4 * sqrt of them, 1,024 at least.

        A task holds the whole network, so it cannot grow as fast as the vocabulary; the counts of words do.
        """
        side = max(32, math.ceil(2 * different**0.25))
        return cls(classes=side, members=side, unknown=side * side // 16)

    @property
    def ids(self) -> int:
        return self.classes * self.members

    @property
    def known(self) -> int:
        return self.ids - self.unknown

    @property
    def parts(self) -> dict[str, tuple[int, ...]]:
        return {
            "embed": (self.ids + 1, self.width),  # the last is what lies beyond a document's ends
            "inner": (2 * self.side, self.width, self.hidden),
            "bias": (self.hidden,),
            "classes": (self.hidden, self.classes),
            "class_bias": (self.classes,),
            "members": (self.classes, self.hidden + 1, self.members),  # the last row of each class is its bias
        }


class Network:
    """Embeddings of the words around one go through one rectified layer into two softmaxes."""

    def __init__(self, shape: Shape, weights: np.ndarray):
        self.shape, self.weights, self.at, self.first = shape, weights, {}, {}
        start = 0
        for name, size in shape.parts.items():
            count = int(np.prod(size))
            self.first[name], self.at[name] = start, weights[start : start + count].reshape(size)
            start += count
        # of each class, and without its bias turned for the way back; taken here once, not in each step
        self.member = list(self.at["members"])
        self.member_back = [m[:-1].T for m in self.member]

    @classmethod
    def start(cls, shape: Shape, shares: np.ndarray, seed: int = 5) -> Network:
        """Small random weights; the biases give each id its share of the corpus."""
        rng = np.random.default_rng(seed)
        size = sum(int(np.prod(s)) for s in shape.parts.values())
        new = cls(shape, np.zeros(size, np.float32))
        for name, scale in (("embed", 0.1), ("inner", 0.2), ("classes", 0.1), ("members", 0.1)):
            part = new.at[name][:, :-1] if name == "members" else new.at[name]
            part[...] = rng.normal(0, scale, part.shape)
        table = np.zeros((shape.members, shape.classes))
        table.flat = shares  # id = member * classes + class
        new.at["class_bias"][...] = np.log(table.sum(axis=0))
        new.at["members"][:, -1] = np.log(table / table.sum(axis=0)).T
        return new

    def _with_bias(self, name: str) -> np.ndarray:
        """A matrix and the bias that lies behind it, as its last row."""
        start, columns = self.first[name], self.at[name].shape[1]
        return self.weights[start : start + self.at[name].size + columns].reshape(-1, columns)

    def hidden(self, around: np.ndarray, near: np.ndarray | None = None) -> np.ndarray:
        """Of each row of ids around a place; a last column of ones stands for the bias of what follows."""
        h = np.ones((len(around), self.shape.hidden + 1), self.weights.dtype)
        total = h[:, :-1]
        if near is not None or len(around) < self.shape.ids:
            np.matmul(self._near(around) if near is None else near, self.at["inner"].reshape(-1, self.shape.hidden), out=total)
            total += self.at["bias"]
        else:
            total[...] = self.at["bias"]
            each = [self.at["embed"] @ inner for inner in self.at["inner"]]
            for low in range(0, len(around), _ROWS):
                part = total[low : low + _ROWS]
                for of, ids in zip(each, around[low : low + _ROWS].T):
                    part += of.take(ids, axis=0)
        np.maximum(total, 0, out=total)
        return h

    def _near(self, around: np.ndarray) -> np.ndarray:
        return self.at["embed"].take(around.ravel(), axis=0).reshape(len(around), around.shape[1] * self.shape.width)

    @staticmethod
    def _softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Turns each row x into exp(x - shift); returns the rows' sums and shifts. One shift serves rows that are alike."""
        shift = x.max(initial=-np.inf)
        if len(x) and shift - x.min() > 40:
            shift = x.max(axis=1)
            x -= shift[:, None]
        else:
            x -= shift
        np.exp(x, out=x)
        return x @ np.ones(x.shape[1], x.dtype), shift

    def _log_probability(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Of one column of each row of logits, which are overwritten."""
        own = x.take(np.arange(0, x.size, x.shape[1]) + of)
        sums, shift = self._softmax(x)
        return own - np.log(sums) - shift

    def _miss(self, x: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """Turns logits into the gradient of the loss, a mean over n rows, by them."""
        sums, _ = self._softmax(x)
        x *= (1 / (sums * n))[:, None]
        x.ravel()[np.arange(0, x.size, x.shape[1]) + of] -= 1 / n
        return x

    def _by_class(self, own: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The order of rows by class, and (class, first, end) of each class met."""
        order = np.argsort(_narrow(own, self.shape.classes), kind="stable")
        bounds = np.searchsorted(own[order], np.arange(self.shape.classes + 1)).tolist()
        return order, [(c, a, b) for c, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a]

    def log_probabilities(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        h = self.hidden(around)
        member, own = np.divmod(target, self.shape.classes)
        out = np.empty(len(target), self.weights.dtype)
        for low in range(0, len(target), _ROWS):
            rows = slice(low, low + _ROWS)
            out[rows] = self._log_probability(h[rows] @ self._with_bias("classes"), own[rows])
        order, runs = self._by_class(own)
        h, member = h.take(order, axis=0), member[order]
        for c, a, b in runs:
            out[order[a:b]] += self._log_probability(np.dot(h[a:b], self.member[c]), member[a:b])
        return out

    def gradient(self, around: np.ndarray, target: np.ndarray) -> Network:
        """Of the mean loss."""
        g = Network(self.shape, np.zeros_like(self.weights))
        ids, rows = self._gradient_into(g, around, target)
        g.at["embed"][ids] = rows
        return g

    def _gradient_into(self, g: Network, around: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Writes the gradient into ``g``, except that of the embeddings: returns the ids met and their rows."""
        n, shape = len(target), self.shape
        near = self._near(around)
        h = self.hidden(around, near)
        member, own = np.divmod(target, shape.classes)
        d = self._miss(h @ self._with_bias("classes"), own, n)
        np.matmul(h.T, d, out=g._with_bias("classes"))
        dh = d @ self.at["classes"].T
        order, runs = self._by_class(own)
        sorted_h, back = h.take(order, axis=0), np.empty_like(dh)
        logits = np.empty((n, shape.members), h.dtype)
        for c, a, b in runs:  # np.dot costs less than np.matmul for each of so many small products
            np.dot(sorted_h[a:b], self.member[c], out=logits[a:b])
        d = self._miss(logits, member[order], n)
        for c, a, b in runs:
            of = d[a:b]
            np.dot(sorted_h[a:b].T, of, out=g.member[c])
            np.dot(of, self.member_back[c], out=back[a:b])
        if len(runs) < shape.classes:
            g.at["members"][np.setdiff1d(np.arange(shape.classes), [c for c, _, _ in runs])] = 0
        dh[order] += back
        dh *= h[:, :-1] > 0
        np.matmul(np.ones(n, dh.dtype), dh, out=g.at["bias"])
        inner = self.at["inner"].reshape(-1, shape.hidden)
        np.matmul(near.T, dh, out=g.at["inner"].reshape(inner.shape))
        return _sums_by_id((dh @ inner.T).reshape(-1, shape.width), _narrow(around.ravel(), shape.ids + 1))

    def learn(self, around: np.ndarray, target: np.ndarray, squares: Network, g: Network, rate: float) -> None:
        """One AdaGrad step on these places; ``squares`` are the sums of squared gradients, ``g`` is room for this one."""
        ids, rows = self._gradient_into(g, around, target)
        embed, met = self.at["embed"], squares.at["embed"].take(ids, axis=0)
        met += rows * rows
        squares.at["embed"][ids] = met
        embed[ids] -= rate * rows / np.sqrt(met)
        for low in range(embed.size, len(self.weights), _BLOCK):  # the embeddings lie first
            part = slice(low, low + _BLOCK)
            by, total = g.weights[part], squares.weights[part]
            room = by * by
            total += room
            np.sqrt(total, out=room)
            np.divide(by, room, out=room)
            room *= rate
            self.weights[part] -= room


def _narrow(values: np.ndarray, end: int) -> np.ndarray:
    """Numbers from 0 below ``end``, in two bytes if they fit: those are sorted by digits."""
    return values.astype(np.uint16) if end <= 1 << 16 else values


def _sums_by_id(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids, and the sum of each one's rows."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    heads = np.flatnonzero(np.r_[np.ones(min(len(ids), 1), bool), ids[1:] != ids[:-1]])
    rows = rows.take(order, axis=0)
    return ids[heads].astype(np.int64), np.add.reduceat(rows, heads, axis=0) if len(heads) else rows


def _pieces(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The rows in order, in pieces of about ``_BYTES`` of text."""
    for rows in batches:
        ends = np.cumsum(pc.binary_length(rows.column(text)).fill_null(0).to_numpy(zero_copy_only=False))
        bounds = [0, *(np.flatnonzero(np.diff(ends // _BYTES)) + 1).tolist(), rows.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b > a:
                yield rows.slice(a, b - a)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words that str.split() finds in the texts in lower case, one after the other, and how many each text has."""
    split = pc.utf8_split_whitespace(pa.array([(t or "").lower() for t in texts.to_pylist()], pa.string()))
    words, owner = split.flatten(), pc.list_parent_indices(split)
    some = pc.not_equal(words, "")  # white space at an end leaves an empty one
    return words.filter(some), np.bincount(owner.filter(some).to_numpy(), minlength=len(texts))


class Words:
    """Ids of words: the frequent ones have their own, the rest share ``unknown`` by a hash.

    ``seldom`` has counts of some words without an id of their own, which then are looked up like the frequent ones.
    """

    def __init__(self, shape: Shape, frequent: Iterable[str], seldom: Mapping[str, int] | None = None):
        self.shape, seldom = shape, seldom or {}
        self.ids = {w: i for i, w in enumerate(frequent)}
        self.listed = pa.array([*self.ids, *seldom], pa.string())
        self.id_at = np.array([*self.ids.values(), *map(self.shared, seldom), -1], np.int64)  # the last is for words not listed
        self.log_count_at = np.log([1] * len(self.ids) + list(seldom.values()) + [1])

    def shared(self, word: str) -> int:
        """The id of a word that has none of its own."""
        return self.shape.known + crc32(word.encode("utf-8", "surrogatepass")) % self.shape.unknown

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: its id, and its place in the list, -1 if it is not there."""
        places = pc.index_in(words, value_set=self.listed).fill_null(-1).to_numpy(zero_copy_only=False)
        ids, other = self.id_at[places], places < 0
        ids[other] = np.array([self.shared(w) for w in words.filter(pa.array(other)).to_pylist()], np.int64)
        return ids, places

    def around(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The ids on both sides of each place, in texts of these lengths that follow each other."""
        side = self.shape.side
        at = np.arange(len(ids)) + side * np.repeat(np.arange(1, len(lengths) + 1), lengths)
        padded = np.full(len(ids) + side * (len(lengths) + 1), self.shape.ids, np.int64)
        padded[at] = ids
        return np.stack([padded[at + k] for k in range(-side, side + 1) if k], axis=1)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """w, n: how often each word occurs in all documents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pieces(batches, text):
            counts = _split(rows.column(text))[0].value_counts()
            yield pa.RecordBatch.from_arrays(counts.flatten(), ["w", "n"])

    counted = docs.select(text).mapInArrow(task, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    return stored(counted, "word-counts")


def at_least_as_frequent(counted: DataFrame, most: int) -> DataFrame:
    """So many most frequent words or some more, in no order: counts of words by the size of their counts, in steps of 4 %, tell which."""
    step = F.floor(F.log2(F.col("n")) * 16)
    least, found = 0, 0
    for r in sorted(counted.groupBy(step.alias("step")).count().collect(), reverse=True):
        least, found = r["step"], found + r["count"]
        if found >= most:
            break
    return counted.where(step >= least)


def most_frequent(counted: DataFrame, most: int) -> DataFrame:
    """So many most frequent words, ties by word, in this order. Each task sends as many rows to the sort, so few others may meet it."""
    return at_least_as_frequent(counted, most).orderBy(F.desc("n"), "w").limit(most)


def corpus_words(docs: DataFrame, shape: Shape, text: str = "text", counted: DataFrame | None = None) -> tuple[list[str], np.ndarray]:
    """The most frequent words of all documents (ties by word), and every id's share of all words."""
    counted = word_counts(docs, text) if counted is None else counted
    best = most_frequent(counted, shape.known).collect()
    total = counted.agg(F.sum("n")).first()[0] or 0
    counts = np.full(shape.ids, 1.0)
    counts[: len(best)] += [r.n for r in best]
    counts[shape.known :] += (total - sum(r.n for r in best)) / shape.unknown
    return [r.w for r in best], counts / counts.sum()


def shared_totals(counted: DataFrame, words: Words) -> np.ndarray:
    """For each shared id: how often the words under it occur, and the share of a word that was not counted."""
    shape = words.shape
    bucket = (F.crc32(F.col("w").cast("binary")) % shape.unknown).cast("int").alias("bucket")
    totals = np.full(shape.unknown, _UNSEEN)
    for r in counted.groupBy(bucket).agg(F.sum("n").alias("n")).collect():
        totals[r.bucket] += r.n
    for r in most_frequent(counted, len(words.ids)).collect():
        totals[words.shared(r.w) - shape.known] -= r.n
    return totals


def seldom_words(counted: DataFrame, frequent: int) -> dict[str, int]:
    """The counts of the ``_SENT`` words that come after so many most frequent ones."""
    best = most_frequent(counted, frequent + _SENT).collect()
    return {r.w: r.n for r in best[frequent:]}


def learnt(text: str, words: int, phase: int, every: int) -> np.ndarray:
    """The places of a text of so many words that a round learns; the phases 0 to ``every`` - 1 have each place once."""
    return np.arange((phase + crc32(text[:64].encode("utf-8", "surrogatepass"))) % every, words, every)


def train_round(docs: DataFrame, words: Words, network: Network, phase: int, text: str = "text", every: int = 1, batch: int = 1_024, rate: float = 0.05) -> Network:
    """One pass: in every document each ``every``-th place is masked and learnt, by one local model for each partition.

    The local models are averaged in Spark, weighted by how many places each has learnt; only one number for each
    weight of the network comes back. With ``every`` = 1 each place of each document is learnt once.
    """
    shape, start = network.shape, network.weights

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Network(shape, start.copy())
        squares, room = Network(shape, np.full_like(start, 1e-3)), Network(shape, np.zeros_like(start))
        held, size, seen = [], 0, 0

        def learn():
            nonlocal seen
            around, target = (np.concatenate(x) for x in zip(*held))
            for low in range(0, len(target), batch):
                local.learn(around[low : low + batch], target[low : low + batch], squares, room, rate)
            seen += len(target)

        for rows in _pieces(batches, text):
            split, lengths = _split(rows.column(text))
            ids, _ = words.of(split)
            around = words.around(ids, lengths)
            for value, end, n in zip(rows.column(text), np.cumsum(lengths).tolist(), lengths.tolist()):
                places = slice(end - n, end) if every == 1 else end - n + learnt(value.as_py() or "", n, phase, every)
                held.append((around[places], ids[places]))
                size += len(held[-1][1])
                if size >= _CHUNK:
                    learn()
                    held, size = [], 0
        if size:
            learn()
        for chunk, low in enumerate(range(0, len(start), _WEIGHTS) if seen else ()):
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "seen": [seen], "weights": [local.weights[low : low + _WEIGHTS].tobytes()]})

    def average(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(w, start.dtype).astype(np.float64) * n for w, n in zip(rows["weights"], rows["seen"]))
        mean = (total / rows["seen"].sum()).astype(start.dtype)
        return pd.DataFrame({"chunk": rows["chunk"][:1], "weights": [mean.tobytes()]})

    made = docs.select(text).mapInArrow(task, "chunk int, seen bigint, weights binary")
    rows = made.groupBy("chunk").applyInPandas(average, "chunk int, weights binary").collect()
    if not rows:
        return network
    return Network(shape, np.frombuffer(b"".join(r.weights for r in sorted(rows)), start.dtype).copy())


def score(
    docs: DataFrame, words: Words, network: Network, doc_id: str = "doc_id", text: str = "text", counted: DataFrame | None = None
) -> DataFrame:
    """Per document: doc_id, n_words, log_likelihood (sum of all words' log probabilities), mean_log_likelihood.

    With ``counted`` (of ``word_counts``) a word without an id of its own has its shared id's probability times its
    share of all counted words under that id; one that was not counted is taken to occur half a time. Counts of words
    that ``words`` lists are at hand, those of all others are joined. Without ``counted`` only the shared id's is taken.
    """
    shares = None if counted is None else np.log(shared_totals(counted, words))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pieces(batches, "text"):
            split, lengths = _split(rows.column("text"))
            ids, places = words.of(split)
            around = words.around(ids, lengths)
            log = np.zeros(len(ids))
            for low in range(0, len(ids), _CHUNK):
                log[low : low + _CHUNK] = network.log_probabilities(around[low : low + _CHUNK], ids[low : low + _CHUNK])
            rare = np.zeros(len(ids), bool)
            if shares is not None:
                shared, rare = ids >= words.shape.known, places < 0
                log += words.log_count_at[places]
                log[shared] -= shares[ids[shared] - words.shape.known]
            owner = np.repeat(np.arange(len(lengths)), lengths)
            ends = np.cumsum(np.bincount(owner[rare], minlength=len(lengths)))
            left = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), split.filter(pa.array(rare)))
            sums = np.bincount(owner, log, len(lengths))
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(lengths, pa.int64()), pa.array(sums, pa.float64()), left], ["id", "n_words", "log_likelihood", "rare"])

    source = docs.select(F.col(f"`{doc_id}`").alias("id"), text_or_empty(text).alias("text"))
    kind = dict(source.dtypes)["id"]
    made = source.mapInArrow(task, f"id {kind}, n_words bigint, log_likelihood double, rare array<string>")
    if counted is not None:
        # written once, so that a row keeps its number
        made = stored(made.withColumn("row", F.monotonically_increasing_id()), "scored")
        seldom = made.select("row", F.explode("rare").alias("w"))
        known = seldom.join(counted, "w", "left").select("row", F.log(F.coalesce(F.col("n").cast("double"), F.lit(_UNSEEN))).alias("more"))
        made = made.join(known.groupBy("row").agg(F.sum("more").alias("more")), "row", "left")
        made = made.withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("more", F.lit(0.0)))
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return made.select(F.col("id").alias(doc_id), "n_words", "log_likelihood", mean.alias("mean_log_likelihood"))


def score_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shape: Shape | None = None, rounds: int | None = None, every: int = 1
) -> DataFrame:
    """Trains the network on the documents and scores each of them by its pseudo-likelihood.

    Words are white-space words in lower case, counted over all documents. Unless a ``shape`` is given its ids grow with
    how many different words there are; the ``shape.known`` most frequent words have ids of their own, all others share
    ``shape.unknown`` ids by a hash, and the score of such a word is its shared id's times its own share under that id,
    from the counts of all words. The ``rounds`` of training learn one in ``every`` places each; by default there are as
    many as ``every``, so that each place of each document is learnt once, and every word of every document is scored. A
    null or empty text has no words, the sum 0 and a null mean; if no document has words nothing is learnt. Repeated rows
    are learnt from and scored one by one; other columns are dropped.
    """
    counted = word_counts(docs, text)
    shape = Shape.of_vocabulary(counted.count()) if shape is None else shape
    rounds = every if rounds is None else rounds
    frequent, shares = corpus_words(docs, shape, text, counted)
    words, network = Words(shape, frequent, seldom_words(counted, len(frequent))), Network.start(shape, shares)
    for turn in range(rounds):
        network = train_round(docs, words, network, turn * max(1, every // max(rounds, 1)), text, every)
    return score(docs, words, network, doc_id, text, counted)
