"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are of type S if smaller than the next suffix, else L. The leftmost S
suffixes (LMS) cut the text into substrings. Their order is induced from the
buckets of first letters, they are named by it, and the names are sorted
recursively where two substrings are equal; one more induction orders all
suffixes. Both inductions run bucket by bucket: what a part of a bucket induces
is appended to other buckets in one step. Deep levels with many letters and few
places for each use the same steps one by one.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(97))
#: With fewer places per letter than this, stepping one by one is faster.
SPARSE = 64


def types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S; the last one, a letter smaller than all others, is."""
    n = len(text)
    step = np.empty(n, np.int8)
    step[-1] = 1
    step[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    # A run of equal letters has the type of its last one.
    decided = np.where(step != 0, np.arange(n), n)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    return step[decided] > 0


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The order of all suffixes (or of LMS substrings) that seeds in this order induce."""
    n, letters = len(text), len(ends)
    starts = np.concatenate([[0], ends[:-1]])
    order = np.full(n, -1, np.int64)
    first = text[seeds]
    by = np.argsort(first, kind="stable")
    counts = np.bincount(first, minlength=letters)
    tails = ends - counts
    order[tails[first[by]] + np.arange(len(by)) - np.concatenate([[0], np.cumsum(counts)[:-1]])[first[by]]] = seeds[by]
    used = np.flatnonzero(ends > starts)

    def spread(batch: np.ndarray, kind: bool, at: np.ndarray, sign: int) -> None:
        before = batch[batch > 0] - 1
        before = before[small[before] == kind]
        if not len(before):
            return
        to = text[before]
        by = np.argsort(to, kind="stable")
        to = to[by]
        new = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        sizes = np.diff(np.append(new, len(to)))
        inside = np.arange(len(to)) - np.repeat(new, sizes)
        order[at[to] + sign * inside] = before[by]
        at[to[new]] += sign * sizes

    heads = starts.copy()
    for c in used:
        done = starts[c]
        while done < heads[c]:
            batch = order[done : heads[c]].copy()
            done = heads[c]
            spread(batch, False, heads, 1)
        if counts[c]:
            spread(order[tails[c] : ends[c]].copy(), False, heads, 1)
    last = ends - 1
    for c in used[::-1]:
        done = ends[c] - 1
        while done > last[c]:
            batch = order[last[c] + 1 : done + 1][::-1].copy()
            done = last[c]
            spread(batch, True, last, -1)
        if heads[c] > starts[c]:
            spread(order[starts[c] : heads[c]][::-1].copy(), True, last, -1)
    return order


def _induce_stepwise(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same, one suffix at a time, for texts whose letters have few places each."""
    letters, kind = text.tolist(), small.tolist()
    order = [-1] * len(letters)
    at = ends.tolist()
    for s in reversed(seeds.tolist()):
        c = letters[s]
        at[c] -= 1
        order[at[c]] = s
    at = [0, *ends[:-1].tolist()]
    for s in order:
        if s > 0 and not kind[s - 1]:
            c = letters[s - 1]
            order[at[c]] = s - 1
            at[c] += 1
    at = ends.tolist()
    for k in range(len(order) - 1, -1, -1):
        s = order[k]
        if s > 0 and kind[s - 1]:
            c = letters[s - 1]
            at[c] -= 1
            order[at[c]] = s - 1
    return np.array(order, np.int64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order. The last letter must be smaller than all others."""
    n = len(text)
    if n < 3:
        return np.argsort(text, kind="stable") if n < 2 or text[0] != text[1] else np.arange(n)[::-1]
    small = types(text)
    ends = np.cumsum(np.bincount(text))
    induce = _induce if n >= SPARSE * len(ends) else _induce_stepwise
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order = induce(text, small, lms, ends)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ranked = order[(order >= 0)]
    ranked = ranked[is_lms[ranked]]
    # Name the substrings: neighbours are equal if their letters up to the next LMS are.
    number = np.empty(n, np.int64)
    number[lms] = np.arange(len(lms))
    stop = np.append(lms[1:], n - 1)
    length = stop[number[ranked]] - ranked
    same = np.zeros(len(ranked), bool)
    if len(ranked) > 1:
        alike = np.flatnonzero(length[1:] == length[:-1])
        k = 0
        a, b, left = ranked[alike], ranked[alike + 1], length[alike]
        while len(alike):
            equal = text[a + k] == text[b + k]
            done = equal & (left == k)
            same[alike[done] + 1] = True
            go = equal & ~done
            alike, a, b, left = alike[go], a[go], b[go], left[go]
            k += 1
    names = np.cumsum(~same) - 1
    if names[-1] + 1 < len(lms):
        reduced = np.empty(len(lms), np.int64)
        reduced[number[ranked]] = names
        ranked = lms[suffix_array(reduced)]
    return induce(text, small, ranked, ends)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """By place in the text: how long the suffix there agrees with the one before it in order.

    Where the letters before a suffix and before its neighbour agree, the value
    is one less than at the place before. Only the others are compared.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = n
    padded = np.append(text, -1)
    place = np.arange(n)
    open_ = (place == 0) | (before == 0) | (before == n)
    fresh = open_ | (padded[place - 1] != padded[np.maximum(before - 1, 0)])
    at = np.flatnonzero(fresh & (before < n))
    value = np.zeros(n, np.int64)
    a, b, k = at, before[at], 0
    while len(at):
        go = padded[np.minimum(a + k, n)] == padded[np.minimum(b + k, n)]
        go &= (a + k < n) & (b + k < n)
        value[at[~go]] = k
        at, a, b = at[go], a[go], b[go]
        k += 1
    base = np.maximum.accumulate(np.where(fresh, place, 0))
    return np.where(fresh, value, np.maximum(value[base] - (place - base), 0))
