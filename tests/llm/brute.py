"""Brute-force versions of the operators for small tables."""

from __future__ import annotations

import collections
import math
import zlib


def words(text):
    return (text or "").encode().split()


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(docs, width=5, percent=75):
    """doc_id -> (set size, component)."""
    sets = {i: shingles(t, width) for i, t in docs}
    holders = collections.defaultdict(list)
    for i in sets:
        for x in sets[i]:
            holders[x].append(i)
    links = []
    for a in sets:
        common = collections.Counter(b for x in sets[a] for b in holders[x] if b < a)
        links += [(a, b) for b, both in common.items() if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)]
    found = components(sorted(sets), links)
    return {i: (len(sets[i]), found[i]) for i in sets}


def repeats(docs, width):
    """doc_id -> set of removed byte positions."""
    starts = collections.defaultdict(list)
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            starts[b[k : k + width]].append((i, k))
    gone = {i: set() for i, _ in docs}
    for places in starts.values():
        if len(places) > 1:
            for i, k in places:
                gone[i].update(range(k, k + width))
    return gone


def line_copies(docs, min_words):
    """doc_id -> numbers of deleted lines: every repeated run with enough words that has an earlier copy."""
    seqs = {}
    for i, t in sorted(docs):
        lines = [(n, x.strip(), len(words(x))) for n, x in enumerate((t or "").split("\n"))]
        seqs[i] = [x for x in lines if x[2]]
    gone = {i: set() for i in seqs}
    first = {}
    longest = max((len(s) for s in seqs.values()), default=0)
    for size in range(1, longest + 1):
        seen, again = {}, False
        for i, s in seqs.items():
            for k in range(len(s) - size + 1):
                run = tuple(x[1] for x in s[k : k + size])
                if run in seen:
                    again = True
                    if sum(x[2] for x in s[k : k + size]) >= min_words:
                        gone[i].update(x[0] for x in s[k : k + size])
                else:
                    seen[run] = (i, k)
        if not again:
            break
    for i, t in docs:
        every = (t or "").split("\n")
        for n, x in enumerate(every):
            if not words(x) and n - 1 in gone[i]:
                gone[i].add(n)
    return gone, first


def toxic_evidence(docs, labels, around, drift=0.02, least=2.5):
    """(row number -> (evidence, [(start, end)]), clean or toxic label of the training rows) from the definition, over plain dictionaries."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    known = {}
    for i, toxic in labels:
        if i is not None and toxic is not None and not held(i):
            known[i] = max(known.get(i, 0), toxic)

    def units(token):
        token = token.strip(around)
        return [token, *(token[:k] + "*" for k in (4, 5) if len(token) >= k)] if token else []

    counts = collections.defaultdict(lambda: [0, 0])
    for i, t in docs:
        if i in known:
            for u in {u for w in (t or "").lower().split() for u in units(w)}:
                counts[u][known[i]] += 1
    clean, toxic = (sum(c[k] for c in counts.values()) for k in (0, 1))
    share, rated = toxic / (clean + toxic), {}
    for u, (c, t) in counts.items():
        alpha = 0.02 * (c + t)
        top = [(x + alpha) / (n + 0.02 * (clean + toxic) - x - alpha) for x, n in ((t, toxic), (c, clean))]
        odds, chance = math.log(top[0] / top[1]), (c + t) * share
        z = (t - chance) / math.sqrt(chance * (1 - share))
        if abs(z) >= 5 and (odds < 0 or odds >= least):
            rated[u] = (max(odds, -1.0) - drift, abs(z))
    weights = [(counts[u][0] / clean, s) for u, (s, _) in rated.items()]
    weights.append((1 - sum(w for w, _ in weights), -drift))
    lo, hi = 1e-6, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if sum(w * math.exp(mid * s) for w, s in weights) > 1 else (mid, hi)

    def score(token):
        found = [rated[u] for u in units(token) if u in rated]
        return max(found, key=lambda r: r[1])[0] if found else -drift

    def maximal(x, a, b):
        """Segments by their definition: the best one, shortest first, then those on either side of it."""
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += x[j]
                if total > 1e-12 and (best is None or total > best[2] + 1e-9):
                    best = (i, j + 1, total)
        return [] if best is None else maximal(x, a, best[0]) + [best] + maximal(x, best[1], b)

    rows = []
    for i, t in docs:
        x = [score(w) for w in (t or "").lower().split()]
        rows.append((i, len(x), maximal(x, 0, len(x))))
    chance = [(n, sum(s >= least - drift for _, _, s in found)) for i, n, found in rows if known.get(i) == 0]
    k = (sum(m for _, m in chance) + 1) * math.exp(hi * (least - drift)) / sum(n for n, _ in chance)
    out = []
    for i, n, found in rows:
        rare = [(a, b, hi * s - math.log(k * n)) for a, b, s in found]
        rare = [r for r in rare if r[2] >= 0]
        out.append((sum(r[2] for r in rare), [r[:2] for r in rare]))
    return out, [known.get(i) for i, _ in docs]
