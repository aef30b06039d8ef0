"""Plain versions of the corpus operators, for small tables."""

import hashlib
from itertools import combinations

import numpy as np


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    if len(words) < k:
        return {tuple(words)}
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def near_duplicates(docs, k, num, den):
    """docs: {id: text} -> {id: (n_shingles, component, kept)}"""
    sets = {d: shingle_set(t, k) for d, t in docs.items()}
    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    both = {}
    for ids in where.values():
        for a, b in combinations(sorted(ids), 2):
            both[a, b] = both.get((a, b), 0) + 1
    links = [p for p, n in both.items() if den * n >= num * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    comp = components(docs, links)
    return {d: (len(sets[d]), comp[d], comp[d] == d) for d in docs}


def without_repeats(docs, window):
    seen, out = {}, {}
    words = {d: (t or "").encode().split() for d, t in docs.items()}
    for d in sorted(docs):
        for i in range(len(words[d]) - window + 1):
            seen.setdefault(tuple(words[d][i : i + window]), (d, i))
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] != (d, i):
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def near_vectors(rows, threshold):
    """rows: [(id, vector or None, label)] -> {id: (n_links, component, kept)}"""
    ok = {}
    for i, v, label in rows:
        if label is None or v is None or any(c is None for c in v):
            continue
        v = np.array(v, dtype=np.float64)
        if len(v) and np.isfinite(v).all() and v.any():
            ok[i] = (v / np.linalg.norm(v), label)
    links = [(a, b) for a, b in combinations(sorted(ok), 2) if ok[a][1] == ok[b][1] and ok[a][0] @ ok[b][0] >= threshold]
    comp = components([r[0] for r in rows], links)
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], comp[i], comp[i] == i) for i in n}
