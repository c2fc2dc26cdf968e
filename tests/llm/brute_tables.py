"""Plain versions of sharding, resampling and the manifest, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def _field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def _leaf(row, text):
    return sha("".join(map(_field, [row["doc_id"], row["source"], row["lang"], row["n_chars"], text])))


def _climb(nodes):
    """All levels of one tree, the last with its top alone."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 8])) for i in range(0, len(below), 8)])
    return levels


def _way(levels, at):
    for nodes in levels[:-1]:
        first = at // 8 * 8
        yield nodes[first:at], nodes[at + 1 : first + 8]
        at //= 8


def manifest(rows):
    """Rows as dicts -> (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified); ids must differ."""
    trees = defaultdict(list)
    for row in rows:
        trees[row["lang"]].append(row)
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    made = {}
    for name in names:
        trees[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
        made[name] = _climb([_leaf(r, r["text"]) for r in trees[name]])
    top = _climb([made[n][-1][0] for n in names])
    root, out = top[-1][0], []
    for number, name in enumerate(names):
        for at, row in enumerate(trees[name]):
            way = [*_way(made[name], at), *_way(top, number)]
            node = made[name][0][at]
            if row["doc_id"] is not None and row["text"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0:
                node = _leaf(row, re.sub("[A-Z]", lambda m: m[0].lower(), row["text"]))
            for before, after in way:
                node = sha("".join([*before, node, *after]))
            proof = sha("".join("".join(before + after) for before, after in way))
            out.append((row["doc_id"], made[name][0][at], made[name][-1][0], root, proof, node, node == root))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def shards(rows, n=16, parts=100):
    """(doc_id, text) -> (doc_id, size, crc, shard, slot); ids must differ."""
    key = lambda s: hashlib.md5(s.encode()).hexdigest()[:16]
    listed = sorted((key(t or ""), key("-" if d is None else str(d)), d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    total, group = sum(r[3] for r in listed), defaultdict(int)
    for r in listed:
        group[r[0]] += r[3]
    out, at, begins, slots = [], 0, {}, Counter()
    for g, _, d, size, crc in listed:
        begin = begins.setdefault(g, at)
        middle = 2 * begin + group[g] if group[g] * n * parts <= total else 2 * at + size
        shard = middle * n // (2 * total)
        out.append((d, size, crc, shard, slots[shard]))
        slots[shard] += 1
        at += size
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def resampled(docs, target, buckets=10_000, percent=25, least=20, seed=7):
    """(doc_id, text) and target texts -> (doc_id, n_features, weight, score, rank)."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    feats = lambda t: (lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:])])(words(t))
    spread = lambda t: [zlib.crc32(f.encode()) % buckets for f in feats(t)]
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(spread(text))
    for text in target:
        t.update(spread(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(float(t[b] + 1) * (all_s + buckets) / (float(s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows, able = [], []
    for d, text in docs:
        found = spread(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(sha(f"{seed}:{'-' if d is None else d}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(found), weight, score, None])
        if len(words(text)) >= least:
            able.append(rows[-1])
    able.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = k + 1
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
