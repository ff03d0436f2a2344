"""Plain Python versions of the text operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import string
import struct

import xxhash

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def _signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def _hash_text(s):
    return _signed(xxhash.xxh64(s.encode(), seed=42).intdigest())


def _hash_longs(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64(struct.pack("<q", v), seed=seed).intdigest()
    return _signed(seed)


def line_dedup(docs, noise=25, reach=50):
    """``{id: (text, removed)}`` for ``{id: text}`` with distinct ids; each place is laid beside every earlier place of its run."""
    blank = " \t\r\f\x0b"
    rows, prints = {}, []
    for i in sorted(docs):
        lines = (docs[i] or "").split("\n")
        numbered = [(no, x.strip(blank)) for no, x in enumerate(lines) if x.strip(blank)]
        h, w = [_hash_text(x) for _, x in numbered], [x.count(" ") + 1 for _, x in numbered]
        runs = []
        for a in range(len(h)):
            total, value, k = 0, 0, 0
            while total < noise and a + k < len(h):
                total, value, k = total + w[a + k], _hash_longs(value, h[a + k]), k + 1
            runs.append((value, k, total >= noise))
        chosen = set()
        for a, (_, k, ok) in enumerate(runs):
            window = runs[a : a + k]
            if ok and all(g[2] for g in window):
                chosen.add(-min((g[0], -(a + j)) for j, g in enumerate(window))[1])
        rows[i] = (lines, numbered, h, w)
        prints += [(i, p, runs[p]) for p in sorted(chosen)]
    gone = {i: set() for i in docs}
    for n, (i, p, (value, k, _)) in enumerate(prints):
        _, _, h, w = rows[i]
        for j, q, (other, _, _) in prints[:n]:
            if other != value:
                continue
            g = rows[j][2]
            gone[i] |= set(range(p, p + k))
            for step, at, to in ((-1, p - 1, q - 1), (1, p + k, q + k)):
                total = 0
                while total < reach and 0 <= at < len(h) and 0 <= to < len(g) and h[at] == g[to]:
                    gone[i].add(at)
                    total, at, to = total + w[at], at + step, to + step
    out = {}
    for i, (lines, numbered, _, _) in rows.items():
        drop = {numbered[p][0] for p in gone[i]}
        out[i] = ("\n".join(x for no, x in enumerate(lines) if no not in drop) if drop else docs[i], len(drop))
    return out


def grams(text, n=5):
    w = words(text)
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def jaccard_classes(docs, n=5, threshold=0.8):
    """``{id: (class_id, text_class, n_links)}`` for ``{id: text}`` by comparing all pairs of different sets."""
    sets = {i: grams(t, n) for i, t in docs.items()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i] or i, i)
    reps = sorted(i for s, i in first.items() if isinstance(s, frozenset))
    links, head = dict.fromkeys(docs, 0), {i: i for i in docs}

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    for k, a in enumerate(reps):
        for b in reps[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = top(a), top(b)
                head[max(x, y)] = min(x, y)
    own = {i: first[sets[i] or i] for i in docs}
    return {i: (top(own[i]), own[i], links[own[i]]) for i in docs}


def contamination(docs, items, window=10, slop=0):
    """``{id: (n_words, n_hit, sorted items)}`` by trying every window at every place."""
    windows = set()
    for name, text in items:
        w = words(text)
        for a in range(max(1, len(w) - window + 1)) if w else ():
            windows.add((name, tuple(w[a : a + window])))
    out = {}
    for i, text in docs.items():
        w = words(text)
        hit, found = set(), set()
        for name, terms in windows:
            for s in range(len(w) - len(terms) + 1):
                if all(t in w[max(0, s + o - slop) : s + o + slop + 1] for o, t in enumerate(terms)):
                    hit |= set(range(s, s + len(terms)))
                    found.add(name)
        out[i] = (len(w), len(hit), sorted(str(f) for f in found if f is not None))
    return out


def exact_groups(docs):
    """``[(keep_id, size)]`` per ``(id, text)`` row; ids are distinct."""
    key = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = {}
    for i, t in docs:
        groups.setdefault(key(t), []).append((-len(t or ""), i))
    return {i: (min(groups[key(t)])[1], len(groups[key(t)])) for i, t in docs}


def kneser_ney(texts, order=4):
    """A function giving log P(gram) of a 4-gram of characters, from ``texts`` already padded."""
    from collections import Counter

    level = [Counter()]
    for t in texts:
        for a in range(len(t) - order + 1):
            level[0][t[a : a + order]] += 1
    for k in range(order - 1, 0, -1):
        level.append(Counter(g[1:] for g in level[-1]))
    level.reverse()

    def discount(c):
        n1, n2 = (sum(v == k for v in c.values()) for k in (1, 2))
        return min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.1), 0.9)

    d = [discount(c) for c in level]

    def p(gram, symbols):
        value = 1 / symbols
        for k in range(1, order + 1):
            tail = gram[-k:]
            context = [v for g, v in level[k - 1].items() if g[:-1] == tail[:-1]]
            if context:
                value = max(level[k - 1][tail] - d[k - 1], 0) / sum(context) + d[k - 1] * len(context) / sum(context) * value
        return value

    return p, set(level[0])


def first_fit_decreasing(counts, capacity):
    room = []
    for length in range(capacity, 0, -1):
        for _ in range(int(counts[length])):
            k = next((k for k, r in enumerate(room) if r >= length), None)
            if k is None:
                room.append(capacity)
                k = len(room) - 1
            room[k] -= length
    return len(room)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def merkle_levels(leaves, fanout):
    """All levels of one tree, leaves first."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return levels


def merkle_path(levels, i, fanout):
    """Siblings left and right of place ``i``, level by level."""
    out = []
    for level in levels[:-1]:
        a = i - i % fanout
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + fanout])))
        i //= fanout
    return out


def merkle(rows, fanout=2):
    """``[(group, subroot, root, path)]`` beside ``rows``, a list of ``(id, group, leaf)``."""
    first = lambda v: (v is not None, v if v is not None else 0)
    groups = sorted({g for _, g, _ in rows}, key=lambda g: (g is not None, (g or "").encode()))
    placed = {g: sorted((n for n, r in enumerate(rows) if r[1] == g), key=lambda n: (*first(rows[n][0]), rows[n][2])) for g in groups}
    trees = {g: merkle_levels([rows[n][2] for n in placed[g]], fanout) for g in groups}
    top = merkle_levels([trees[g][-1][0] for g in groups], fanout)
    out = [None] * len(rows)
    for k, g in enumerate(groups):
        for i, n in enumerate(placed[g]):
            out[n] = (g, trees[g][-1][0], top[-1][0], merkle_path(trees[g], i, fanout) + merkle_path(top, k, fanout))
    return out


def hard_negatives(rows, anchor, positives=5, negatives=5, low=80, high=100, scale=256):
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for rows ``(id, vector, label)``."""
    used = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = lambda s, k: (-s, used[k][0] is None, used[k][0] or 0, k)
    out = []
    for a, (i, v, y) in enumerate(used):
        if i is None or not anchor(i):
            continue
        score = [sum(p * q for p, q in zip(v, w)) for _, w, _ in used]
        same = sorted((k for k in range(len(used)) if k != a and used[k][2] == y), key=lambda k: first(score[k], k))
        for p in same[:positives]:
            fit = [k for k in range(len(used)) if used[k][2] != y and low * score[p] <= high * score[k] <= high * score[p]]
            for rank, k in enumerate(sorted(fit, key=lambda k: first(score[k], k))[:negatives], 1):
                out.append((i, used[p][0], rank, used[k][0], score[p], score[k]))
    return out
