"""Suffix arrays by induced sorting, and permuted longest common prefixes.

Symbols are non-negative integers; the last one is zero and occurs nowhere
else. Every scan visits each suffix once, in stretches that numpy handles
whole, over the bytes as over the large alphabets of reduced strings.
"""

from __future__ import annotations

import numpy as np

SHORT = 1 << 20


def s_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it."""
    n = len(s)
    differs = np.append(s[:-1] != s[1:], True)
    nearest = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    rises = np.append(s[:-1] < s[1:], True)
    return rises[nearest]


def _placed(keys: np.ndarray, sigma: int):
    """Stable grouping of keys: order, the sorted keys, ranks within equal keys, first places and sizes of groups."""
    by = np.argsort(keys.astype(np.uint16) if sigma <= 65536 else keys, kind="stable")
    keys = keys[by]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(first, len(keys)))
    return by, keys, np.arange(len(keys)) - np.repeat(first, sizes), first, sizes


def induce(s: np.ndarray, sigma: int, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from leftmost-smaller suffixes listed in the order ``lms``.

    Both scans move over whole stretches: what a suffix induces goes to a free
    place, and all free places lie beyond the first one, so everything before
    that is ready at once.
    """
    n = len(s)
    count = np.bincount(s, minlength=sigma)
    larger = np.bincount(s[~small], minlength=sigma)
    # first scan, over larger suffixes and leftmost-smaller ones, bucket by bucket
    seeds = np.bincount(s[lms], minlength=sigma)
    begin = np.cumsum(larger + seeds) - larger - seeds
    line = np.empty(int((larger + seeds).sum()), dtype=np.int64)
    head, full = begin.copy(), begin + larger
    by, keys, rank, _, _ = _placed(s[lms], sigma)
    line[full[keys] + rank] = lms[by]
    at, bucket = 0, 0
    while at < len(line):
        while bucket < sigma:
            ahead = np.flatnonzero(head[bucket : bucket + 256] < full[bucket : bucket + 256])
            if len(ahead):
                bucket += int(ahead[0])
                break
            bucket += 256
        upto = int(head[bucket]) if bucket < sigma else len(line)
        batch = line[at:upto]
        at = upto
        j = batch[batch > 0] - 1
        j = j[~small[j]]
        if len(j):
            by, keys, rank, first, sizes = _placed(s[j], sigma)
            line[head[keys] + rank] = j[by]
            head[keys[first]] += sizes
    # second scan, from the right, over larger and smaller suffixes
    stop = np.cumsum(count)
    start = stop - count
    order = np.empty(n, dtype=np.int64)
    within = np.arange(int(larger.sum())) - np.repeat(np.cumsum(larger) - larger, larger)
    order[np.repeat(start, larger) + within] = line[np.repeat(begin, larger) + within]
    tail, empty = stop.copy(), start + larger
    order[0], tail[0] = n - 1, 0
    at, bucket = n, sigma - 1
    while at > 0:
        while bucket >= 0:
            low = max(0, bucket - 255)
            ahead = np.flatnonzero(tail[low : bucket + 1] > empty[low : bucket + 1])
            if len(ahead):
                bucket = low + int(ahead[-1])
                break
            bucket = low - 1
        downto = int(tail[bucket]) if bucket >= 0 else 0
        batch = order[downto:at][::-1]
        at = downto
        j = batch[batch > 0] - 1
        j = j[small[j]]
        if len(j):
            by, keys, rank, first, sizes = _placed(s[j], sigma)
            order[tail[keys] - 1 - rank] = j[by]
            tail[keys[first]] -= sizes
    return order


def doubled(names: np.ndarray) -> np.ndarray:
    """Suffix array of a short reduced string: ranks of twice as many names each turn."""
    n, step, rank = len(names), 1, names.astype(np.int64)
    base = max(n, int(rank.max()) + 1) + 1
    while True:
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: n - step] = rank[step:] + 1
        pair = rank * base + ahead
        order = np.argsort(pair)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.append(0, np.cumsum(np.diff(pair[order]) > 0))
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """Suffixes of s in order. The recursion ends at strings of up to ``SHORT`` symbols with large alphabets, whose
    buckets hold hardly more than one suffix: there ranks are doubled instead."""
    n = len(s)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    if n <= SHORT and sigma > 300:
        return doubled(s)
    small = s_types(s)
    lms = np.flatnonzero(small & ~np.append(True, small[:-1]))
    first = induce(s, sigma, small, lms)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    ranked = first[is_lms[first]]
    # equal neighbours among sorted substrings get the same name
    length = np.zeros(n, dtype=np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = ranked[:-1], ranked[1:]
    same = length[a] == length[b]
    at = np.flatnonzero(same)
    k = 0
    while len(at):
        at = at[length[a[at]] > k]
        differ = s[a[at] + k] != s[b[at] + k]
        same[at[differ]] = False
        at = at[~differ]
        k += 1
    names = np.zeros(n, dtype=np.int64)
    names[ranked] = np.append(0, np.cumsum(~same))
    reduced = names[lms]
    kinds = int(names[ranked[-1]]) + 1
    if kinds == len(lms):
        sorted_lms = ranked
    else:
        sorted_lms = lms[suffix_array(reduced, kinds)]
    return induce(s, sigma, small, sorted_lms)


def permuted_lcp(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position, the common prefix with the suffix before it in order.

    Only irreducible values are compared symbol by symbol; where the symbols
    before both suffixes agree, the value is that of the position before
    less one.
    """
    n = len(s)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    here = np.arange(n)
    reducible = (here > 0) & (before > 0)
    inner = np.flatnonzero(reducible)
    reducible[inner] = (s[inner - 1] == s[before[inner] - 1]) & (before[inner - 1] == before[inner] - 1)
    plain = np.flatnonzero(~reducible & (before >= 0))
    value = np.zeros(n, dtype=np.int64)
    # four symbols at a time while they agree, then one by one; the last symbol is unique and stops both
    narrow = np.append(s, [0, 0, 0]).astype(np.uint64)
    four = narrow[:n] | narrow[1 : n + 1] << np.uint64(16) | narrow[2 : n + 2] << np.uint64(32) | narrow[3 : n + 3] << np.uint64(48)
    a, b = plain, before[plain]
    grown = np.zeros(len(plain), dtype=np.int64)
    for words, step in ((four, 4), (s, 1)):
        active = np.arange(len(plain))
        while len(active):
            i, j = a[active] + grown[active], b[active] + grown[active]
            active = active[words[np.minimum(i, n - 1)] == words[np.minimum(j, n - 1)]]
            grown[active] += step
    value[plain] = grown
    origin = np.maximum.accumulate(np.where(reducible, 0, here))
    return value[origin] - (here - origin)
