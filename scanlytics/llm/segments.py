"""Content-defined cells of sequences, the unit in which repeated passages are looked up.

Every window of ``window`` units picks an anchor: the gram of ``gram`` units inside it with the least hash, the
leftmost among equals. That choice depends on the window alone, so equal windows pick the same place in them. Windows
next to each other that share an anchor, and whose distance to it lies in the same step of ``span``, form a cell:

* ``core``  hashes what lies in every window of the cell, wherever the cell starts and ends. Two equal windows have
  equal cores; a core met once has no repeated window.
* ``whole`` hashes all units of the cell's windows and their place round the anchor. Cells with equal wholes have the
  same windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE_BITS = 24
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretches of a sequence of 64-bit units."""

    def __init__(self, units: np.ndarray):
        up, self.down = powers(len(units) + 1)
        self.sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, n: int) -> np.ndarray:
        """Of the stretch of n units from each place on."""
        if len(self.sums) <= n:
            return np.zeros(0, np.uint64)
        return mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


BYTE_UNITS = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def byte_units(data: bytes) -> np.ndarray:
    return BYTE_UNITS[np.frombuffer(data, np.uint8)]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of starts and ends of the words that white space separates."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~_SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[::2], edges[1::2]


def word_units(data: bytes) -> np.ndarray:
    """One 64-bit hash for each word."""
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    return mix(Rolling(byte_units(data)).of(starts, ends) + (ends - starts).astype(np.uint64))


@dataclass(frozen=True)
class Shape:
    window: int
    gram: int
    span: int

    @property
    def reach(self) -> int:
        """How many grams a window has."""
        return self.window - self.gram + 1


@dataclass
class Cells:
    doc: np.ndarray
    first: np.ndarray  # first window's place in its document
    count: np.ndarray  # windows in the cell
    core: np.ndarray
    whole: np.ndarray


def cells(units: list[np.ndarray], offsets: list[int], shape: Shape) -> Cells:
    """The cells of some sequences; ``offsets`` are added to the places in each."""
    lengths = np.array([len(u) for u in units], np.int64)
    ends = np.cumsum(lengths)
    rolling = Rolling(np.concatenate(units) if units else np.zeros(0, np.uint64))
    total = int(ends[-1]) if len(ends) else 0
    reach = shape.reach
    if total < shape.window:
        return Cells(*[np.zeros(0, np.int64)] * 5)
    grams = rolling.grams(shape.gram)
    places = np.arange(len(grams), dtype=np.uint64)
    least = (grams >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | places
    size = 1
    while 2 * size <= reach:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < reach:
        least = np.minimum(least[: len(least) - (reach - size)], least[reach - size :])
    starts = np.arange(len(least))
    owner = np.repeat(np.arange(len(units)), lengths)[: len(least)]
    inside = starts + shape.window <= ends[owner]
    starts, owner = starts[inside], owner[inside]
    if not len(starts):
        return Cells(*[np.zeros(0, np.int64)] * 5)
    anchor = (least[inside] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    step = (anchor - starts) // shape.span
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (step[1:] != step[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    first, anchor, step, owner = starts[at], anchor[at], step[at], owner[at]
    nearest = step * shape.span
    farthest = np.minimum(nearest + shape.span, reach) - 1
    core = mix(rolling.of(anchor - nearest, anchor - farthest + shape.window) + step.astype(np.uint64))
    last = first + count - 1
    place = (anchor - first).astype(np.uint64) << np.uint64(32) | (anchor - last).astype(np.uint64)
    whole = mix(rolling.of(first, last + shape.window) ^ mix(place))
    begin = (ends - lengths)[owner]
    return Cells(owner, first - begin + np.array(offsets, np.int64)[owner], count, core.view(np.int64), whole.view(np.int64))


def pieces(units: np.ndarray, window: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """A long sequence in overlapping pieces that together hold every window once."""
    for start in range(0, max(1, len(units) - window + 1), most):
        yield start, units[start : start + most + window - 1]


def batched(items, most: int) -> Iterator[list]:
    """(key, units, offset) triples in lists of about ``most`` units."""
    held, size = [], 0
    for item in items:
        held.append(item)
        size += len(item[1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held
