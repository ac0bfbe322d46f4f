"""Plain versions of the operators, to test them against."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, words):
    found = [w.translate(LOWER) for w in WORD.findall(text or "")]
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)} if len(found) >= words else {tuple(found)} if found else set()


def components(docs, words, share):
    """{key: (size of the set, least key of the component)} of (key, text) rows with distinct keys, by all pairs that share a shingle."""
    sets = {k: shingle_set(t, words) for k, t in docs}
    near = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            near[x].append(k)
    up = {k: k for k in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in {tuple(sorted(p)) for keys in near.values() for p in combinations(keys, 2)}:
        both = len(sets[a] & sets[b])
        if share[1] * both >= share[0] * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {k: (len(s), top(k)) for k, s in sets.items()}
