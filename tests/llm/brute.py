"""Plain versions of the text operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode("utf-8", "surrogatepass")).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def earlier_windows(rows, k=13):
    """(doc_id, n_words, n_removed, kept_sha256) of (doc_id, text) rows."""
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone[i : i + k] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), int(gone.sum()), sha(kept)))
    return sorted(out)


def repeated_bytes(rows, k):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    times = Counter()
    for _, t in rows:
        b = (t or "").encode()
        times.update(b[i : i + k] for i in range(len(b) - k + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - k + 1):
            if times[b[i : i + k]] > 1:
                gone[i : i + k] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return sorted(out)


def jaccard_classes(rows, n=5, threshold=0.8):
    """(doc_id, class_id, n_links)."""
    sets = {}
    for d, t in rows:
        w = words(t)
        m = min(n, len(w))
        sets[d] = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
    head = {d: d for d in sets}

    def top(d):
        while head[d] != d:
            d = head[d]
        return d

    links = Counter()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = top(a), top(b)
                head[max(x, y)] = min(x, y)
    return sorted((d, top(d), links[d]) for d in ids)


def leaks(docs, items, need=13, share=0.8):
    """Pairs (doc_id, item_id) with a stretch of ``need`` words (of all, if the item is shorter) on any diagonal of which
    ``share`` agree; items of 5 to 10 words must agree in all, shorter ones have none."""
    plain = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = set()
    for d, t in docs:
        w = plain(t)
        for i, x in items:
            v = plain(x)
            least, wanted = min(need, len(v)), 1.0 if len(v) < 11 else share
            for s in range(-len(v) + 1, len(w)) if len(v) >= 5 else ():
                sums = [0]
                for j in range(max(0, -s), min(len(v), len(w) - s)):
                    sums.append(sums[-1] + (v[j] == w[j + s]))
                for a in range(len(sums)):
                    if any(sums[b] - sums[a] >= wanted * (b - a) - 1e-9 for b in range(a + least, len(sums))):
                        found.add((d, i))
    return found
