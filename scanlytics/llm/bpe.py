"""BPE encoding and decoding: frequent words from a minimal acyclic transducer, the rest by exact merging."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import sys
import types
import unicodedata
import uuid
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlytics.llm.common import stored, text_or_empty

# Fixed value: the split pattern of this vocabulary's file, with white space as Unicode defines it.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
)
# The same for texts without the characters of UNUSUAL, in the faster module.
USUAL_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|[_\x1c-\x1f])+")
UNUSUAL = re.compile("[²³¹¼½¾\u0250-\U0010ffff]")
END = "</w>"
#: Characters of the texts whose new words are merged together, if there is more than one text.
_CHARS = 1 << 18
#: Words of at most so many bytes are merged together with those of like length; a number above all ranks and token numbers.
_WIDTHS, _NONE = (8, 12, 16, 32), 1 << 30


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if visible in Latin-1, else one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Merger:
    """The vocabulary's own merges, applied to one word at a time."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.tokens |= {i: t for t, i in self.added.items()}
        self.symbols = byte_symbols()
        self._number()

    def _number(self) -> None:
        """Numbers for the merging of many words: a token's is its id, what has none gets one above all ids."""
        self.top = max(self.vocab.values(), default=-1)
        numbers = dict(self.vocab)
        of = lambda token: numbers.setdefault(token, self.top + 1 + len(numbers))
        self.inner = np.array([of(s) for s in self.symbols], np.int64)
        self.last = np.array([of(s + END) for s in self.symbols], np.int64)
        count = len(self.ranks)  # arrays straight from iterators, as each worker makes them
        pairs = np.fromiter((of(a) * _NONE + of(b) for a, b in self.ranks), np.int64, count)
        ranks = np.fromiter(self.ranks.values(), np.int64, count)
        results = np.fromiter((of(a + b) for a, b in self.ranks), np.int64, count)
        self.results = np.zeros(max(self.ranks.values(), default=-1) + 1, np.int64)
        self.results[ranks] = results
        # open addressing: a pair lies in the first free slot from its own on; the last slots are for those that run over
        self.bits = max(8, count.bit_length() + 1)
        self.slots = np.full((1 << self.bits) + count + 1, -1, np.int64)
        self.slot_ranks = np.full(len(self.slots), _NONE, np.int64)
        at, todo = self._slot(pairs), np.arange(count)
        while len(todo):
            free = todo[self.slots[at[todo]] < 0]
            _, first = np.unique(at[free], return_index=True)
            self.slots[at[free[first]]], self.slot_ranks[at[free[first]]] = pairs[free[first]], ranks[free[first]]
            todo = todo[self.slots[at[todo]] != pairs[todo]]
            at[todo] += 1

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pieces(self, word: str) -> list[str]:
        """The word's tokens: the pair of lowest rank merges first, the leftmost among equals."""
        parts = [self.symbols[b] for b in word.encode("utf-8")]
        if not parts:
            return []
        parts[-1] += END
        return self._merge_long(parts) if len(parts) > 64 else self._merge_short(parts)

    def _merge_short(self, parts: list[str]) -> list[str]:
        rank, none = self.ranks.get, len(self.ranks)
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def _merge_long(self, parts: list) -> list[str]:
        """The same with a heap, for words of any length."""
        n, ranks = len(parts), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or ranks.get((parts[i], parts[j])) != rank:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [p for p in parts if p is not None]

    def ids(self, word: str) -> list[int]:
        return [self.vocab[p] for p in self.pieces(word) if p in self.vocab]

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of numbers, _NONE if it does not merge or one of them is -1."""
        pairs = np.where((left < 0) | (right < 0), _NONE * _NONE, left * _NONE + right)
        at = self._slot(pairs)
        found = self.slots[at]
        ranks = np.where(found == pairs, self.slot_ranks[at], _NONE)
        todo = np.nonzero((found != pairs) & (found >= 0))
        while len(todo[0]):
            at[todo] += 1
            found = self.slots[at[todo]]
            same = found == pairs[todo]
            ranks[tuple(t[same] for t in todo)] = self.slot_ranks[at[tuple(t[same] for t in todo)]]
            todo = tuple(t[(found >= 0) & ~same] for t in todo)
        return ranks

    def ids_of_many(self, words: list[str]) -> list[list[int]]:
        """``ids`` of each word, merging in all words of like length at once."""
        raw = [w.encode("utf-8") for w in words]
        kind = np.searchsorted(_WIDTHS, [len(r) for r in raw])
        out: list = [None] * len(raw)
        for k in np.unique(kind).tolist():
            some = np.flatnonzero(kind == k).tolist()
            made = self._merge_many([raw[i] for i in some]) if k < len(_WIDTHS) else [self.ids(words[i]) for i in some]
            for i, ids in zip(some, made):
                out[i] = ids
        return out

    def _merge_many(self, raw: list[bytes]) -> list[list[int]]:
        lengths = np.array([len(r) for r in raw], np.int64)
        width, at = int(lengths.max()), np.arange(len(raw))
        if not lengths.min():
            return [ids for r in raw for ids in (self._merge_many([r]) if r else [[]])]
        table = np.frombuffer(b"".join([r.ljust(width, b"\0") for r in raw]), np.uint8).reshape(-1, width)
        parts = self.inner[table]
        parts[at, lengths - 1] = self.last[table[at, lengths - 1]]
        parts[np.arange(width) >= lengths[:, None]] = -1
        ranks = self._ranks_of(parts[:, :-1], parts[:, 1:])
        out, who = np.full((len(raw), width), -1, np.int64), at
        while ranks.shape[1]:
            i = ranks.argmin(axis=1)
            least = ranks[at, i]
            if (done := least == _NONE).any():
                out[who[done], : parts.shape[1]] = parts[done]
                parts, ranks, who, i, least = (x[~done] for x in (parts, ranks, who, i, least))
                at = np.arange(len(who))
            if not len(who):
                break
            # each word left has one part less, and the pairs beside the new part have new ranks
            columns = np.arange(parts.shape[1] - 1)
            parts = np.take_along_axis(parts, columns + (columns > i[:, None]), 1)
            parts[at, i] = self.results[least]
            ranks = np.take_along_axis(ranks, columns[:-1] + (columns[:-1] >= i[:, None]), 1)
            for by in (1, 0):
                has = np.flatnonzero((i >= by) & (i - by < ranks.shape[1]))
                k = i[has] - by
                ranks[has, k] = self._ranks_of(parts[has, k], parts[has, k + 1])
        out[who, : parts.shape[1]] = parts
        kept = (out >= 0) & (out <= self.top)
        flat, ends = out[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


def compile_lexicon(entries: Iterable[tuple[bytes, int]]) -> dict[str, np.ndarray]:
    """The minimal acyclic transducer of ``entries`` (unique keys in byte order): equal suffixes share their states.

    A path spells a word; the sum of the numbers on its arcs and at its end is the word's output. Numbers are pushed
    as far to the start as they go, so that tails with different outputs can be the same states.
    """
    registered: dict[tuple, int] = {}
    finals: list[int] = []
    arcs: list[tuple[tuple[int, int, int], ...]] = []

    def freeze(node) -> int:
        key = (node[1], tuple((b, o, t) for b, (o, t) in sorted(node[0].items())))
        if key not in registered:
            registered[key] = len(finals)
            finals.append(node[1])
            arcs.append(key[1])
        return registered[key]

    # a node is [arcs: byte -> [output, target], output at its end or -1]; path holds those not yet frozen
    path: list[list] = [[{}, -1]]
    previous = b""
    for word, output in entries:
        shared = 0
        while shared < min(len(word), len(previous)) and word[shared] == previous[shared]:
            shared += 1
        for depth in range(len(previous), shared, -1):
            path[depth - 1][0][previous[depth - 1]][1] = freeze(path.pop())
        rest = output
        for depth in range(shared):
            arc = path[depth][0][word[depth]]
            common = min(arc[0], rest)
            if (surplus := arc[0] - common) > 0:  # move what is not shared behind the arc
                below = path[depth + 1]
                for other in below[0].values():
                    other[0] += surplus
                if below[1] >= 0:
                    below[1] += surplus
                arc[0] = common
            rest -= common
        for depth in range(shared, len(word)):
            path[depth][0][word[depth]] = [rest if depth == shared else 0, None]
            path.append([{}, -1])
        path[-1][1] = rest if len(word) == shared else 0
        if not word:
            path[0][1] = output
        previous = word
    for depth in range(len(previous), 0, -1):
        path[depth - 1][0][previous[depth - 1]][1] = freeze(path.pop())
    root = freeze(path.pop())
    starts = np.zeros(len(arcs) + 1, np.int64)
    starts[1:] = np.cumsum([len(a) for a in arcs])
    flat = np.array([x for a in arcs for x in a] or np.zeros((0, 3)), np.int64).reshape(-1, 3)
    return {
        "root": np.array([root], np.int64),
        "finals": np.array(finals, np.int64),
        "starts": starts,
        "labels": flat[:, 0].astype(np.int64),
        "outputs": flat[:, 1],
        "targets": flat[:, 2],
    }


FIELDS = ("root", "finals", "starts", "labels", "outputs", "targets", "id_starts", "ids")


class Lexicon:
    """A compiled transducer over one memory-mapped file; output k stands for ids[id_starts[k] : id_starts[k + 1]]."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        views = {f: memoryview(arrays[f]) for f in FIELDS}  # plain integers come out faster than from numpy
        self.finals, self.starts, self.labels = views["finals"], views["starts"], views["labels"]
        self.outputs, self.targets = views["outputs"], views["targets"]
        self.id_starts, self.id_list = views["id_starts"], views["ids"]
        self.root = int(arrays["root"][0])

    @staticmethod
    def write(arrays: dict[str, np.ndarray], path: str) -> None:
        sizes = np.array([len(arrays[f]) for f in FIELDS], np.int64)
        with open(path, "wb") as out:
            out.write(sizes.tobytes())
            for f in FIELDS:
                out.write(arrays[f].astype(np.int64).tobytes())

    @classmethod
    def open(cls, path: str) -> Lexicon:
        whole = np.memmap(path, np.int64, "r")
        at, arrays = len(FIELDS), {}
        for f, size in zip(FIELDS, whole[: len(FIELDS)]):
            arrays[f] = whole[at : at + int(size)]
            at += int(size)
        return cls(arrays)

    def ids(self, word: bytes) -> list[int] | None:
        starts, labels, outputs, targets = self.starts, self.labels, self.outputs, self.targets
        state, total = self.root, 0
        for byte in word:
            end = starts[state + 1]
            k = bisect_left(labels, byte, starts[state], end)
            if k == end or labels[k] != byte:
                return None
            total += outputs[k]
            state = targets[k]
        if (last := self.finals[state]) < 0:
            return None
        total += last
        return self.id_list[self.id_starts[total] : self.id_starts[total + 1]].tolist()


def build_lexicon(words: Iterable[str], merger: Merger) -> dict[str, np.ndarray]:
    """Ids of the given words as one transducer."""
    keys = sorted({w.encode("utf-8") for w in words if w})
    sequences = [merger.ids(k.decode("utf-8")) for k in keys]
    arrays = compile_lexicon(zip(keys, range(len(keys))))
    lengths = np.zeros(len(keys) + 1, np.int64)
    lengths[1:] = np.cumsum([len(s) for s in sequences])
    return arrays | {"id_starts": lengths, "ids": np.array([i for s in sequences for i in s], np.int64)}


def normalized(text: str) -> str:
    """Composed, in lower case character by character (no final sigma). White space is dropped later in any case."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def pieces_of(text: str) -> list[str]:
    text = normalized(text)
    return (PIECES if UNUSUAL.search(text) else USUAL_PIECES).findall(text)


class Encoder:
    """Encodes and decodes. Words met are kept in two generations of ``keep`` words: when the younger is full, the older
    one, less the words met again meanwhile, is forgotten."""

    def __init__(self, merger: Merger, lexicon: Lexicon | None = None, keep: int = 100_000):
        self.merger, self.lexicon, self.keep = merger, lexicon, keep
        self.known: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}
        names = sorted(map(re.escape, merger.added), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(names) + ")") if names else None

    def _listed(self, word: str) -> list[int] | None:
        return self.lexicon.ids(word.encode("utf-8")) if self.lexicon is not None and len(word) <= 64 else None

    def word_ids(self, word: str) -> list[int]:
        found = self._listed(word)
        return self.merger.ids(word) if found is None else found

    def _value(self, ids: list[int]) -> tuple[str, str]:
        tokens = self.merger.tokens
        return " ".join([str(i) for i in ids]), " ".join([tokens[i] for i in ids])

    def _keep(self, word: str, value: tuple[str, str]) -> None:
        if len(self.known) >= self.keep:
            self.known, self.older = {}, self.known
        self.known[word] = value

    def entry(self, word: str) -> tuple[str, str]:
        """Ids as text, decoded text."""
        value = self.known.get(word) or self.older.pop(word, None)
        if value is None:
            value = self._value(self.word_ids(word))
        if len(word) <= 64:
            self._keep(word, value)
        return value

    def meet(self, words: Iterable[str]) -> None:
        """Keeps the words that are not known yet; those not in the lexicon are merged together."""
        unlisted: list[str] = []
        for word in set(words).difference(self.known, self.older):
            if (ids := self._listed(word)) is not None:
                self._keep(word, self._value(ids))
            elif len(word) <= 64:
                unlisted.append(word)
        for word, ids in zip(unlisted, self.merger.ids_of_many(unlisted)):
            self._keep(word, self._value(ids))

    def parts(self, text: str) -> list[tuple[str, str]]:
        get, entry = self.known.get, self.entry
        if self.special is None or not self.special.search(text):
            return [get(word) or entry(word) for word in pieces_of(text)]
        out: list[tuple[str, str]] = []
        for k, chunk in enumerate(self.special.split(text)):
            if k % 2:
                out.append((str(self.merger.added[chunk]), chunk))
            else:
                out += [get(word) or entry(word) for word in pieces_of(chunk)]
        return out

    def texts(self, text: str) -> tuple[str, str]:
        """All ids joined by one space, and the decoded text."""
        return self._joined(self.parts(text))

    @staticmethod
    def _joined(parts: list[tuple[str, str]]) -> tuple[str, str]:
        return " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts])

    def texts_of(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """``texts`` of each."""
        ends = np.cumsum([len(t) for t in texts]) // _CHARS
        for _, group in groupby(zip(ends.tolist(), texts), key=lambda x: x[0]):
            some = [t for _, t in group]
            cut = [None if self.special is not None and self.special.search(t) else pieces_of(t) for t in some]
            self.meet(chain.from_iterable(words or () for words in cut))
            for text, words in zip(some, cut):
                get, entry = self.known.get, self.entry
                yield self.texts(text) if words is None else self._joined([get(word) or entry(word) for word in words])

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.texts(text)[0].split()]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(self.merger.tokens[i] for i in ids if i in self.merger.tokens)


def worker_encoder(lexicon_name: str, spec_name: str) -> Encoder:
    """The encoder of this Python worker: opened by its first task and used by those after it, with the words met so far.

    Task code travels with the job, so its own globals are new in each task; the worker's module table is not. One
    encoder is held at a time, and it forgets its words when there are too many.
    """
    held = sys.modules.setdefault("scanlytics_worker", types.ModuleType("scanlytics_worker")).__dict__
    if held.get("encoder_of") != (lexicon_name, spec_name):
        with open(SparkFiles.get(spec_name), encoding="utf-8") as file:
            held["encoder"] = Encoder(Merger(json.load(file)), Lexicon.open(SparkFiles.get(lexicon_name)))
        held["encoder_of"] = (lexicon_name, spec_name)
    return held["encoder"]


def frequent_words(docs: DataFrame, limit: int, text: str = "text") -> list[str]:
    """About the ``limit`` most frequent white-space words of all documents, in lower case.

    Words are cut at the count at which the histogram of counts passes the limit, so that tasks send the driver
    only words above that, never ``limit`` words each.
    """
    words = docs.select(F.explode(F.split(F.lower(text_or_empty(text)), r"[^\p{L}]+")).alias("w"))
    counted = words.where("w <> '' AND length(w) <= 64").groupBy("w").agg(F.count("*").alias("n"))
    counted = stored(counted.where("n > 1"), "word-counts")
    steps = counted.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("step")).agg(F.count("*").alias("words")).collect()
    total, lowest = 0, 1 << 30
    for row in sorted(steps, key=lambda r: -r.step):
        if total + row.words > limit:
            break
        total, lowest = total + row.words, row.step
    return [r.w for r in counted.where(F.floor(F.log2("n") * 4) >= lowest).select("w").collect()]


def published(spark: SparkSession, arrays: dict[str, np.ndarray], spec_path: str) -> tuple[str, str]:
    """Ships lexicon and vocabulary to every executor; returns the names to open them by."""
    import shutil
    import tempfile

    folder = tempfile.mkdtemp(prefix="lexicon-")  # the driver serves the files from there as long as it lives
    names = f"lexicon-{uuid.uuid4().hex}.bin", f"vocabulary-{uuid.uuid4().hex}.json"
    Lexicon.write(arrays, os.path.join(folder, names[0]))
    shutil.copy(spec_path, os.path.join(folder, names[1]))
    for name in names:
        spark.sparkContext.addFile(os.path.join(folder, name))
    return names


def encode_documents(
    docs: DataFrame, vocabulary: str, text: str = "text", lexicon_words: int = 50_000, with_ids: bool = False
) -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked, ``ids`` and ``decoded`` to every document.

    ``vocabulary`` is the path of a tokenizers JSON file with word ends. Words are counted over all documents and the
    most frequent, at most ``lexicon_words`` (a bound on the lexicon, not on what is encoded), are compiled into the
    transducer; every other word is merged exactly. A null text counts as empty: no token. Repeated rows stay, extra
    columns are kept, and a column named like an output is replaced.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as file:
        merger = Merger(json.load(file))
    lexicon_name, spec_name = published(spark, build_lexicon(frequent_words(docs, lexicon_words, text), merger), vocabulary)
    outputs = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = worker_encoder(lexicon_name, spec_name)
        for batch in batches:
            rows = []
            for ids, decoded in encoder.texts_of([value or "" for value in batch[text]]):
                row = (ids.count(" ") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    row += ([int(i) for i in ids.split()], decoded)
                rows.append(row)
            made = pd.DataFrame(rows, columns=outputs, index=batch.index)
            yield pd.concat([batch.drop(columns=dropped), made], axis=1)

    source = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in outputs or c == text])
    dropped = [] if with_ids else [text]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name not in dropped]
    types = ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"] + ["ids array<int>", "decoded string"] * with_ids
    return source.mapInPandas(task, ", ".join([*fields, *types]))
