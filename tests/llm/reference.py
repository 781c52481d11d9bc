"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return SPACE_WORD.findall(text or "")


def alnum(text):
    return ALNUM_WORD.findall(lower(text))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


def shingles(text, size):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(len(w) - size + 1, 1)))


def jaccard(rows, size=3, threshold=90):
    """doc_id -> (set size, component) for unique ids."""
    sets = {i: shingles(t, size) for i, t in rows}
    ids = sorted(sets)
    links = []
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= threshold * len(sets[a] | sets[b]):
                    links.append((a, b))
    found = components(ids, links)
    return {i: (len(sets[i]), found[i]) for i in ids}


def quality(text):
    w = words(text)
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def contamination(text, items, window=10):
    """(n_words, n_hit, item ids) of one document."""
    w, hit, found = alnum(text), set(), set()
    for item_id, item in items:
        v = alnum(item)
        size = min(window, len(v))
        windows = {tuple(v[i:i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1):
            if size and tuple(w[i:i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(item_id)
    return len(w), len(hit), found


def katz(rows, discounts, held, order):
    """doc_id -> (score, base score), and the sums over all words and an unknown one after every context."""
    tokens = {i: [*words(lower(t)), None] for i, t in rows}
    padded = {i: [("start",)] * (order - 1) + t for i, t in tokens.items()}
    train = [i for i in tokens if not held(i)]
    one = Counter(w for i in train for w in tokens[i])
    n, v = sum(one.values()), len(one)
    followers, factors = {}, {}
    for k in range(1, order + 1):
        table = followers[k] = defaultdict(Counter)
        for i in train:
            for at in range(order - 1, len(padded[i])):
                table[tuple(padded[i][at - k + 1:at])][padded[i][at]] += 1
        every = [c for f in table.values() for c in f.values()]
        factors[k] = discounts([every.count(c) for c in range(1, 7)])
    weights = {}

    def share(h, c):
        f = followers[len(h) + 1][h]
        return (factors[len(h) + 1][c] if c <= 5 else 1) * c / (sum(f.values()) + (not any(x <= 5 for x in f.values())))

    def probability(h, w):
        f = followers[len(h) + 1].get(h)
        if f and f[w]:
            return share(h, f[w])
        if f and h not in weights:
            weights[h] = (1 - sum(share(h, c) for c in f.values())) / (1 - sum(probability(h[1:], x) for x in f if h))
        return (weights[h] if f else 1) * (probability(h[1:], w) if h else 1)

    out = {}
    for i, t in padded.items():
        score = sum(math.log10(probability(tuple(t[at - order + 1:at]), t[at])) for at in range(order - 1, len(t)))
        out[i] = score, sum(math.log10((one[w] + 1) / (n + v + 1)) for w in tokens[i])
    contexts = [h for table in followers.values() for h in list(table)[:40]]
    sums = {h: sum(probability(h, w) for w in one) + probability(h, ("never",)) for h in contexts}
    return out, sums


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
