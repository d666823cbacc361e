"""Plain, slow versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import combinations


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def line_dedupe(docs, width=9, percent=80):
    """docs: (doc_id, text). Texts that are left, in the same order."""
    at = defaultdict(list)
    for i, (doc_id, text) in enumerate(docs):
        for place, line in enumerate(text.split("\n") if text is not None else ()):
            if x := " ".join(words(ascii_lower(line))):
                at[x].append(((doc_id is not None, doc_id or 0, place), i, place))
    sets = {x: {x[i : i + width] for i in range(len(x) - width + 1)} or {x} for x in at}
    holders = defaultdict(list)
    for x, s in sets.items():
        for t in s:
            holders[t].append(x)
    both = Counter()
    for x, s in sets.items():
        for y, n in Counter(y for t in s for y in holders[t] if y < x).items():
            both[y, x] = n
    links = [(x, y) for (x, y), n in both.items() if 100 * n >= percent * (len(sets[x]) + len(sets[y]) - n)]
    group = components(sorted(at), links)
    first = {}
    for x, places in at.items():
        first[group[x]] = min(first.get(group[x], places[0][0]), min(p[0] for p in places))
    gone = {(i, place) for x, places in at.items() for key, i, place in places if key != first[group[x]]}
    return [None if t is None else "\n".join(line for p, line in enumerate(t.split("\n")) if (i, p) not in gone) for i, (_, t) in enumerate(docs)]


def shingles(text, n):
    w = words(ascii_lower(text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def jaccard(docs, n=3, percent=90):
    """doc_id -> (size, component)."""
    sets = {i: shingles(t, n) for i, t in docs}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    group = components(sorted(sets), links)
    return {i: (len(s), group[i]) for i, s in sets.items()}


def substring(docs, length=50):
    """doc_id -> (words, removed, kept text)."""
    least = {}
    for i, t in sorted(docs):
        w = words(t)
        for a in range(len(w) - length + 1):
            least.setdefault(tuple(w[a : a + length]), i)
    out = {}
    for i, t in docs:
        w = words(t)
        gone = {b for a in range(len(w) - length + 1) if least[tuple(w[a : a + length])] < i for b in range(a, a + length)}
        out[i] = (len(w), len(gone), " ".join(x for b, x in enumerate(w) if b not in gone))
    return out


def decontaminate(docs, items, window=10):
    """doc_id -> (words, hit words, item ids)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
    grams = defaultdict(set)
    for item, t in items:
        w = split(t)
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[a : a + n])].add(item)
    out = {}
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(g) for g in grams}:
            for a in range(len(w) - n + 1):
                if (g := tuple(w[a : a + n])) in grams:
                    hit |= set(range(a, a + n))
                    found |= grams[g]
        out[i] = (len(w), len(hit), found)
    return out
