"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

The steps are the classical ones, carried out on whole arrays instead of one
position at a time:

* every suffix is S (smaller than the next one) or L; an S suffix after an L one
  is leftmost-smaller (LMS);
* LMS substrings are sorted and named by their (symbol, type) pairs, as many
  pairs to a 63-bit key as fit; where names are shared, the string of names, a
  third of the text or so, is sorted by recursion;
* the order of the LMS suffixes induces the L suffixes in one pass over the
  buckets from small to large, and these the S suffixes in one pass back.  Bytes
  fill few large buckets, and a bucket's suffixes are moved together; names fill
  many small ones, and their suffixes are moved one at a time.  Either way the
  passes are linear in the text.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last position is a sentinel and S."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])  # last position of each run of equal symbols
    smaller = t[change] < t[change + 1]
    out = np.ones(n, bool)
    lengths = np.diff(np.concatenate(([-1], change)))
    out[: change[-1] + 1 if len(change) else 0] = np.repeat(smaller, lengths)
    return out


def _name(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """Order-preserving names of the LMS substrings, in text order."""
    symbol = (t.astype(np.int64) << 1) | s_type  # 0 is left for "ended": a sentinel is S
    bits = int(symbol.max()).bit_length()
    at_once = 63 // bits
    ends = np.append(lms[1:], lms[-1]) + 1  # with the next LMS symbol
    size = np.minimum(ends - lms, depth + 1)
    names = np.zeros(len(lms), np.int64)
    for at in range(0, int(size.max()), at_once):
        some = np.flatnonzero(size > at)
        key = np.zeros(len(some), np.int64)
        for k in range(at_once):
            here = at + k
            key = (key << bits) | np.where(size[some] > here, symbol[np.minimum(lms[some] + here, len(symbol) - 1)], 0)
        if at == 0:
            names = np.unique(key, return_inverse=True)[1].astype(np.int64)
            continue
        # refine: longer substrings by their next symbols, below equal names; those that ended come first
        full = np.zeros(len(lms), np.int64)
        full[some] = np.unique(key, return_inverse=True)[1] + 1
        names = np.unique(names * (int(full.max()) + 1) + full, return_inverse=True)[1].astype(np.int64)
    return names


def _ordered(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """The LMS positions in order of the first ``depth`` symbols of their suffixes."""
    names = _name(t, s_type, lms, depth)
    if int(names.max()) + 1 == len(names):
        return lms[np.argsort(names)]
    # LMS positions are at least two apart
    reduced, depth = np.append(names + 1, 0), depth // 2 + 2
    s_type = _types(reduced)
    inner = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    return lms[_induced(reduced, s_type, _ordered(reduced, s_type, inner, depth))[1:]]


def _induced(t: np.ndarray, s_type: np.ndarray, order: np.ndarray) -> np.ndarray:
    """All suffixes of ``t``, a string of names with one sentinel, from its LMS suffixes in order."""
    n = len(t)
    ends = np.cumsum(np.bincount(t))
    seeds = order[np.argsort(t[order], kind="stable")]
    symbols = t[seeds]
    sa = np.full(n, n)
    sa[ends[symbols] - np.searchsorted(symbols, symbols, "right") + np.arange(len(seeds))] = seeds
    found = sa.tolist()
    # the bucket into which a suffix moves the one before it; -1 if that is of the other type
    into = lambda kind: np.concatenate(([-1], np.where(s_type[:-1] == kind, t[:-1], -1), [-1])).tolist()
    free, bucket = [0, *ends[:-1].tolist()], into(False)
    for p in found:  # meets what it adds further on
        if (c := bucket[p]) >= 0:
            found[free[c]] = p - 1
            free[c] += 1
    free, bucket = (ends - 1).tolist(), into(True)
    for p in reversed(found):
        if (c := bucket[p]) >= 0:
            found[free[c]] = p - 1
            free[c] -= 1
    return np.array(found)


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``t`` (small non-negative integers, 0 a sentinel, at the end too) in order of their first ``depth`` symbols."""
    n = len(t)
    s_type = _types(t)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if not len(lms):
        return np.argsort(t, kind="stable")
    order = _ordered(t, s_type, lms, depth)
    alphabet = np.flatnonzero(np.bincount(t))
    seeds = _deal(order, t)

    def split(found: np.ndarray, into: dict[int, list[np.ndarray]]) -> None:
        for c, part in _deal(found, t).items():
            into.setdefault(c, []).append(part)

    def wave(part: np.ndarray, c: int, kind: bool) -> list[np.ndarray]:
        """A bucket's members of one type, with those that they induce in the same bucket."""
        out = [part]
        while len(part):
            before = part[part > 0] - 1
            part = before[(t[before] == c) & (s_type[before] == kind)]
            if len(part):
                out.append(part)
        return out

    grow: dict[int, list[np.ndarray]] = {}
    larger: dict[int, np.ndarray] = {}
    none = np.zeros(0, np.int64)
    for c in alphabet.tolist():
        mine = np.concatenate(wave(np.concatenate(grow.pop(c, [none])), c, False))
        larger[c] = mine
        scan = np.concatenate((mine, seeds.get(c, none)))
        before = scan[scan > 0] - 1
        split(before[~s_type[before] & (t[before] > c)], grow)
    grow, out = {}, []
    last = np.array([n - 1])
    for c in alphabet[::-1].tolist():
        # from right to left; sentinels keep the order of their seeds
        start = seeds[0][::-1] if c == 0 and 0 in seeds else np.concatenate(grow.pop(c, [none]))
        mine = np.concatenate(wave(start, c, True)) if c else start
        scan = np.concatenate((mine, larger[c][::-1]))
        before = scan[scan > 0] - 1
        split(before[s_type[before] & (t[before] < c)], grow)
        out.append(np.concatenate((larger[c], mine[::-1])))
    sa = np.concatenate(out[::-1])
    return sa if len(sa) == n else np.concatenate((last, sa))[:n]


def _deal(found: np.ndarray, t: np.ndarray) -> dict[int, np.ndarray]:
    """Positions by their symbol, order kept."""
    if not len(found):
        return {}
    symbols = t[found]
    by = np.argsort(symbols, kind="stable")
    found, symbols = found[by], symbols[by]
    cut = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    return {int(symbols[a]): found[a:b] for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(found)], strict=True)}


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phi, plcp): for each position its predecessor in the suffix array (-1 for the first) and their common prefix.

    Common prefixes end at sentinels.  Where phi moves on by one together with
    the position, the common prefix is one shorter than before; only the other
    positions are compared, eight symbols at a time.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    bytes_ = np.concatenate((t.astype(np.uint8), np.zeros(16, np.uint8)))
    word = np.zeros(n + 8, np.uint64)
    for k in range(8):
        word |= bytes_[k : k + n + 8].astype(np.uint64) << np.uint64(8 * k)
    # the symbols up to the next sentinel bound every common prefix
    ends = np.flatnonzero(t == 0)
    room = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    follows = np.zeros(n, bool)
    follows[1:] = (phi[1:] == phi[:-1] + 1) & (phi[:-1] >= 0) & (t[:-1] != 0) & (t[:-1] == t[np.maximum(phi[:-1], 0)])
    heads = np.flatnonzero(~follows & (phi >= 0))
    plcp = np.zeros(n, np.int64)
    a, b = heads, phi[heads]
    limit = np.minimum(room[a], room[b])
    done = np.zeros(len(a), np.int64)
    active = np.flatnonzero(limit > 0)
    while len(active):
        x = word[a[active] + done[active]] ^ word[b[active] + done[active]]
        same = x == 0
        low = x & (~x + np.uint64(1))
        bits = np.where(same, 64, np.frexp(np.maximum(low, np.uint64(1)).astype(np.float64))[1] - 1)
        done[active] = np.minimum(done[active] + bits // 8, limit[active])
        active = active[same & (done[active] < limit[active])]
    plcp[heads] = done
    # what follows a head inherits its common prefix, less the distance
    at = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    plcp = np.where(follows, np.maximum(plcp[at] - (np.arange(n) - at), 0), plcp)
    return phi, plcp
