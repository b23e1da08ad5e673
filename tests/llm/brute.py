"""Plain-Python versions of the dedup operators."""

import hashlib
from collections import defaultdict

from cases import fold, order, words

STRIPPED = " \t\n\x0b\x0c\r"


def substrings(rows, window):
    first = {}
    for i, text in rows:
        found = words(text)
        for k in range(len(found) - window + 1):
            key = tuple(found[k:k + window])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, text in rows:
        found = words(text)
        keep = [True] * len(found)
        for k in range(len(found) - window + 1):
            if first[tuple(found[k:k + window])] < order(i):
                keep[k:k + window] = [False] * window
        kept = " ".join(w for w, y in zip(found, keep) if y)
        out.append((i, len(found), len(found) - sum(keep), hashlib.sha256(kept.encode()).hexdigest(), text if all(keep) else kept))
    return out


def lines(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = fold(line.strip(STRIPPED))
            if len(key) >= min_chars:
                holders[key].add(order(i))
    out = []
    for i, text in rows:
        parts = (text or "").split("\n")
        drop = [len(h := holders.get(fold(x.strip(STRIPPED)), ())) >= min_docs and max(h) != order(i) for x in parts]
        kept = "\n".join(x for x, y in zip(parts, drop) if not y)
        out.append((i, len(parts), sum(drop), kept if any(drop) else text))
    return out


def near_components(rows, width=5):
    sizes = []
    for i, text in rows:
        found = words(fold(text or ""))
        s = {tuple(found[k:k + width]) for k in range(len(found) - width + 1)} if len(found) >= width else {tuple(found)} if found else set()
        sizes.append((i, len(s), frozenset(s)))
    root = {order(i): order(i) for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, m, s) in enumerate(sizes):
        for j, n, t in sizes[:a]:
            both = len(s & t)
            if both and 100 * both >= 75 * (m + n - both):
                x, y = find(order(i)), find(order(j))
                root[max(x, y)] = min(x, y)
    out = set()
    for i, n, _ in sizes:
        c = find(order(i)) if n else order(i)
        out.add((i, n, None if c == order(None) else c, c == order(i)))
    return out
