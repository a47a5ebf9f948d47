"""Plain versions of the operators, row by row, for small inputs."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(a, b):
    x = len(a & b)
    return bool(a) and bool(b) and 100 * x >= 75 * len(a | b)


def near_duplicates(rows):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if linked(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats(rows, window):
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    words, first = [WORD.findall(t or "") for _, t in rows], {}
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k:k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def tiles(a, b, least):
    """Greedy string tiling, straight from the definition; words covered in a."""
    used_a, used_b, covered = [False] * len(a), [False] * len(b), 0
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best and n >= least:
                    found.append((i, j))
        if best < least:
            return covered
        for i, j in found:
            if not any(used_a[i:i + best]) and not any(used_b[j:j + best]):
                used_a[i:i + best] = used_b[j:j + best] = [True] * best
                covered += best


def top_k(vectors, queries, k):
    """[(query_id, rank, vec_id, score)]"""
    def whole(v):
        return v is not None and all(x is not None and x == x and abs(x) != float("inf") for x in v)

    def ints(v):
        return [int(float(x) * 1024 // 1) for x in v]

    rows = {(i, tuple(v)) for i, v in vectors if i is not None and whole(v)}
    best = defaultdict(set)
    for q, v in queries:
        if q is not None and whole(v):
            for i, o in rows:
                if i != q:
                    best[q].add((-sum(x * y for x, y in zip(ints(v), ints(o))), i))
    return [(q, n + 1, i, -s) for q in best for n, (s, i) in enumerate(sorted(best[q])[:k])]
