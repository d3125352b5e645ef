"""Plain Python forms of the operators."""

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contamination(text, items, size=10):
    w = BENCH_WORD.findall((text or "").translate(LOWER))
    hit, names = set(), set()
    for name, body in items:
        b = BENCH_WORD.findall((body or "").translate(LOWER))
        for i in range(max(1, len(b) - size + 1) if b else 0):
            g = b[i : i + size]
            for j in range(len(w) - len(g) + 1):
                if w[j : j + len(g)] == g:
                    hit.update(range(j, j + len(g)))
                    names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def components(docs, k=3, percent=90):
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = top(a), top(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def substrings(docs, size=20):
    seen, out = set(), {}
    for i, t in sorted(docs):
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for a in range(len(w) - size + 1):
            g = tuple(w[a : a + size])
            if g in seen:
                keep[a : a + size] = [False] * size
            seen.add(g)
        kept = " ".join(x for x, y in zip(w, keep) if y)
        out[i] = (len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest())
    return out


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def lines(docs, size=3):
    seen, out = set(), {}
    for i, t in sorted(docs):
        x = [] if t is None else t.split("\n")
        gone = set()
        for a in range(len(x) - size + 1):
            g = tuple(x[a : a + size])
            if any(WORD.search(y) for y in g):
                if g in seen:
                    gone.update(range(a, a + size))
                seen.add(g)
        out[i] = (len(x), len(gone), None if t is None else "\n".join(y for j, y in enumerate(x) if j not in gone))
    return out


def crc(ids):
    import numpy as np

    return zlib.crc32(np.array(ids, "<u4").tobytes())
