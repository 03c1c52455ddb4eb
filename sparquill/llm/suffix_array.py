"""Suffix arrays by induced sorting, and permuted common prefixes, on whole numpy arrays.

Suffixes are classified as S (smaller than the next) or L; leftmost S positions (LMS) cut the text into substrings. Sorting
these substrings, naming equal ones alike, sorting the string of names recursively and inducing the other suffixes from
them gives the array. The induction moves all suffixes at once that a bucket induces; where the alphabet has more than
`MANY` signs (strings of names) buckets hold few suffixes, and all that lie at the same distance from an LMS suffix move
at once instead. Both are the same induction, and recursion goes on until all names differ.
"""

from __future__ import annotations

import numpy as np

MANY = 4096


def classify(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last, a unique least sign, counts as smaller."""
    n = len(t)
    s = np.zeros(n, bool)
    s[-1] = True
    if n > 1:
        less, same = t[:-1] < t[1:], t[:-1] == t[1:]
        # a run of equal signs takes the type of its end
        at = np.where(same, n, np.arange(n - 1))
        after = np.minimum.accumulate(at[::-1])[::-1]
        s[:-1] = less[np.minimum(after, n - 2)]
        s[-2] = False
    return s


def _spread(places: np.ndarray, signs: np.ndarray, heads: np.ndarray, step: int, sa: np.ndarray) -> None:
    """Put suffixes at the heads of the buckets of their signs, keeping their order, and move the heads."""
    order = np.argsort(signs, kind="stable")
    places, signs = places[order], signs[order]
    first = np.flatnonzero(np.concatenate([[True], signs[1:] != signs[:-1]]))
    count = np.diff(np.concatenate([first, [len(signs)]]))
    inside = np.arange(len(signs)) - np.repeat(first, count)
    sa[heads[signs] + step * inside] = places
    heads[signs[first]] += step * count


def induce(t: np.ndarray, s: np.ndarray, sigma: int, lms: np.ndarray) -> np.ndarray:
    """The suffix array that follows from the order of the LMS suffixes (or, first, of anything in their place)."""
    n = len(t)
    small = t.astype(np.uint8 if sigma <= 256 else np.uint16 if sigma <= 65536 else np.int64)
    sizes = np.bincount(t, minlength=sigma)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sa = np.full(n, -1, np.int64)
    tails = (ends - 1).copy()
    _spread(lms[::-1], small[lms[::-1]], tails, -1, sa)
    heads = starts.copy()

    def left(chunk: np.ndarray) -> None:
        p = chunk[chunk > 0] - 1
        p = p[~s[p]]
        if len(p):
            _spread(p, small[p], heads, 1, sa)

    def right(chunk: np.ndarray) -> None:
        p = chunk[chunk > 0] - 1
        p = p[s[p]]
        if len(p):
            _spread(p, small[p], tails, -1, sa)

    used = np.flatnonzero(sizes).tolist()
    for c in used:
        i = starts[c]
        while i < heads[c]:
            j = heads[c]
            left(sa[i:j])
            i = j
        if tails[c] + 1 < ends[c]:
            left(sa[tails[c] + 1 : ends[c]])
    lefts = heads.copy()
    tails = (ends - 1).copy()
    for c in reversed(used):
        i = ends[c]
        while i > tails[c] + 1:
            j = tails[c] + 1
            right(sa[j:i][::-1])
            i = j
        if starts[c] < lefts[c]:
            right(sa[starts[c] : lefts[c]][::-1])
    return sa


def _levels(t: np.ndarray, rank: np.ndarray, held: np.ndarray, fixed: np.ndarray, pick, above: int) -> np.ndarray:
    """Merge suffixes into `held`, sorted suffixes with fixed keys, level by level, a level being the suffixes one step before
    those of the last. A suffix is placed by its sign and the rank of the suffix after it; `above` moves it behind the fixed ones."""
    n = len(t)
    wide = 2 * n + 2
    induced = np.zeros(n, bool)
    fresh = held
    while True:
        at = fresh[fresh > 0] - 1
        at = at[pick[at]]
        if not len(at):
            return held
        rank[held] = np.arange(len(held))
        late = induced[held]
        key = fixed[held]
        key[late] = t[held[late]] * wide + above + rank[held[late] + 1]
        mine = t[at] * wide + above + rank[at + 1]
        order = np.argsort(mine, kind="stable")
        at, mine = at[order], mine[order]
        to = np.searchsorted(key, mine) + np.arange(len(at))
        old = np.ones(len(held) + len(at), bool)
        old[to] = False
        merged = np.empty(len(old), np.int64)
        merged[to], merged[old] = at, held
        held = merged
        induced[at] = True
        fresh = at


def induce_many(t: np.ndarray, s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The same induction for an alphabet with about as many signs as suffixes, where buckets hold few suffixes: all suffixes
    at the same distance from their inducing one move at once. A suffix whose sign occurs once has its place from the start."""
    n = len(t)
    wide = 2 * n + 2
    once = np.bincount(t)[t] == 1
    rank, fixed = np.zeros(n, np.int64), np.zeros(n, np.int64)
    lms = lms[np.argsort(t[lms], kind="stable")]
    fixed[lms] = n + np.arange(len(lms))
    held = np.concatenate([lms, np.flatnonzero(once & ~s)])
    fixed[held] += t[held] * wide
    held = held[np.argsort(fixed[held], kind="stable")]
    held = _levels(t, rank, held, fixed, ~s & ~once, 0)
    large = held[~s[held]]
    fixed[:] = 0
    fixed[large] = np.arange(len(large))
    held = np.concatenate([large, np.flatnonzero(once & s)])
    fixed[held] += t[held] * wide
    held = held[np.argsort(fixed[held], kind="stable")]
    return _levels(t, rank, held, fixed, s & ~once, n)


def suffix_array(t: np.ndarray, sigma: int, apart: int = -1) -> np.ndarray:
    """Positions of the suffixes of t in order. t ends with its only 0.

    apart: a sign, less than all but 0, whose occurrences count as different from each other, in any order: the end mark of
    joined strings, past which nothing has to be compared.
    """
    n = len(t)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    s = classify(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    sa = induce(t, s, sigma, lms) if sigma <= MANY else induce_many(t, s, lms)
    if len(lms) <= 1:
        return sa
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    in_order = sa[is_lms[sa]]
    length = np.zeros(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = in_order[:-1], in_order[1:]
    same = length[a] == length[b]
    same &= ~((a == n - 1) | (b == n - 1)) & (t[a] != apart)
    live, j = np.flatnonzero(same), 0
    while len(live):
        differ = t[a[live] + j] != t[b[live] + j]
        same[live[differ]] = False
        live = live[~differ]
        j += 1
        live = live[length[a[live]] > j]
    name = np.zeros(n, np.int64)
    name[in_order] = np.concatenate([[0], np.cumsum(~same)])
    names = int(name[in_order[-1]]) + 1
    if names < len(lms):
        t1 = name[lms]
        lms_sorted = lms[suffix_array(t1, names)]
    else:
        lms_sorted = in_order
    return induce(t, s, sigma, lms_sorted) if sigma <= MANY else induce_many(t, s, lms_sorted)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int, stride: int = 16) -> np.ndarray:
    """Permuted common prefixes: for each position, the length it shares with the suffix before it in order, up to `most`.

    A position shares at least one sign less than the position before it does, so every `stride`-th position is compared
    from its first sign, and each one after these from where its neighbour leaves off. t's last sign is its only 0, so no
    comparison runs past the end.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    for r in range(min(stride, n)):
        at = np.arange(r, n, stride)
        have = np.maximum(out[at - 1] - 1, 0) if r else np.zeros(len(at), np.int64)
        live = np.flatnonzero((before[at] >= 0) & (have < most))
        while len(live):
            p, h = at[live], have[live]
            live = live[t[p + h] == t[before[p] + h]]
            have[live] += 1
            live = live[have[live] < most]
        have[before[at] < 0] = 0
        out[at] = have
    return out
