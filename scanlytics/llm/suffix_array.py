"""Linear suffix sorting by grouping, and common prefixes of neighbours."""

from __future__ import annotations

import numpy as np

from scanlytics.llm.segments import Rolling


def suffix_array(text: list[int]) -> list[int]:
    """The order of all suffixes of ``text``; its last symbol must be smaller than all others and occur once.

    First all suffixes are put into groups by their first symbol. Groups are taken in descending order. Each suffix
    of a group points to the nearest suffix before it that is in a lower group (its previous-smaller pointer); the
    suffixes pointed to move, by how many point to them, into new groups right above their own, because the group's
    common prefix continues theirs. When all groups are done, a group holds the suffixes with one Lyndon prefix, and
    groups are in order. Then, from the least suffix on, each sorted suffix hands the next place of its group to the
    suffix before it and to those that one points to. No suffix is renamed and nothing recurses.
    """
    n = len(text)
    values = np.asarray(text, np.int64)
    order = np.argsort(values, kind="stable")
    heads = np.flatnonzero(np.r_[True, values[order][1:] != values[order][:-1]])
    sizes = np.diff(np.r_[heads, n])
    size = np.zeros(n, np.int64)  # at a group's first place: how many suffixes it has
    size[heads] = sizes
    group = np.empty(n, np.int64)  # of each suffix: its group's first place
    group[order] = np.repeat(heads, sizes)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    size, group, slot, place = size.tolist(), group.tolist(), order.tolist(), rank.tolist()
    before = [-1] * n
    end = n
    while end > 0:
        head = group[slot[end - 1]]
        if end - head == 1:
            members = slot[head:end]
        else:
            members = sorted(slot[head:end])
        pointed: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= head:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if pointed:
            if len(members) == 1:
                levels = [list(pointed)]
            else:
                most = max(pointed.values())
                if most == 1:
                    levels = [list(pointed)]
                else:
                    by_count: dict[int, list[int]] = {}
                    for j, times in pointed.items():
                        by_count.setdefault(times, []).append(j)
                    levels = [by_count[k] for k in sorted(by_count, reverse=True)]
            for moved in levels:
                from_groups = set()
                for j in moved:
                    old = group[j]
                    left = size[old] - 1
                    size[old] = left
                    target, at = old + left, place[j]
                    other = slot[target]
                    slot[target], slot[at] = j, other
                    place[j], place[other] = target, at
                    from_groups.add(old)
                for j in moved:
                    old = group[j]
                    first = old + size[old]
                    if first != old:
                        group[j] = first
                for old in from_groups:
                    if size[old] == 0:  # all moved: the group stays as it is
                        size[old] = _count_from(slot, group, old, n)
                    else:
                        first = old + size[old]
                        size[first] = _count_from(slot, group, first, n)
        end = head
    return _emit(group, before, n)


def _count_from(slot: list[int], group: list[int], first: int, n: int) -> int:
    at = first
    while at < n and group[slot[at]] == first:
        at += 1
    return at - first


def _emit(group: list[int], before: list[int], n: int) -> list[int]:
    free = list(range(n))  # of each group, by its first place: the next place to give out
    done = [False] * n
    out = [-1] * n
    last = n - 1
    out[0] = last
    done[last] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            head = group[j]
            at = free[head]
            free[head] = at + 1
            out[at] = j
            done[j] = True
            j = before[j]
    return out


def common_prefixes(rolling: Rolling, starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """For stretches in sorted order: how many units each shares with the one before it, up to ``most``."""
    shared = np.zeros(len(starts), np.int64)
    if len(starts) < 2:
        return shared
    a, b = starts[:-1], starts[1:]
    high = np.minimum(np.minimum(ends[:-1] - a, ends[1:] - b), most)
    low = np.zeros(len(a), np.int64)
    while True:
        open_ = low < high
        if not open_.any():
            break
        middle = (low + high + 1) // 2
        same = rolling.of(a, a + middle) == rolling.of(b, b + middle)
        low = np.where(open_ & same, middle, low)
        high = np.where(open_ & ~same, middle - 1, high)
    shared[1:] = low
    return shared
