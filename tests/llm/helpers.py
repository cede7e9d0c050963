"""Brute-force versions that the operators are held against."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, n=5):
    words = WORD.findall(lower(text))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def components(rows):
    """doc_id -> (set size, smallest doc_id reachable), comparing all pairs that share a shingle."""
    sets, lists = {i: shingles(t) for i, t in rows}, {}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in sets.items():
        shared = Counter(j for s in own for j in lists.get(s, ()))
        for j, both in shared.items():
            if 100 * both >= 80 * (len(own) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in own:
            lists.setdefault(s, []).append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def local_alignment(item, window, match=2, mismatch=-1, gap=-1):
    table, best = [[0] * (len(window) + 1) for _ in range(len(item) + 1)], 0
    for i, a in enumerate(item, 1):
        for j, b in enumerate(window, 1):
            step = table[i - 1][j - 1] + (match if a == b else mismatch)
            table[i][j] = max(0, step, table[i - 1][j] + gap, table[i][j - 1] + gap)
            best = max(best, table[i][j])
    return best
