"""Common prefixes of suffixes by interval expansion on a Burrows-Wheeler transform, up to a bound.

A breadth-first search extends intervals backwards: the interval of ``w`` gives those of ``cw`` for each symbol ``c`` before it.
Level by level this fixes, by increasing value, where neighbouring suffixes have a common prefix of that length, and
stops at the bound; the places still open then are those with a common prefix of the bound or more.
"""

from __future__ import annotations

import numpy as np

#: Symbols packed in one key, 9 bits each.
_PACK = 7


def order_suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` symbols or more, and the packed first symbols in that order."""
    n = len(text)
    padded = np.concatenate((text.astype(np.int64), np.zeros(_PACK, np.int64)))
    key = np.zeros(n, np.int64)
    for k in range(_PACK):
        key = (key << 9) | padded[k : k + n]
    suffixes = np.argsort(key, kind="stable")
    ordered = key[suffixes]
    rank = np.empty(n, np.int64)
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank[suffixes] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    reach = _PACK
    while reach < depth:
        ranks = rank[suffixes]
        tied = np.zeros(n, bool)
        same = ranks[1:] == ranks[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        own = suffixes[at]
        later = np.where(own + reach < n, rank[np.minimum(own + reach, n - 1)] + 1, 0)
        key = ranks[at] * (n + 1) + later
        order = np.argsort(key, kind="stable")
        suffixes[at] = own[order]
        key = key[order]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        rank[suffixes[at]] = np.maximum.accumulate(np.where(first, at, 0))
        reach *= 2
    return suffixes, ordered


def repeated_starts(text: np.ndarray, least: int) -> np.ndarray:
    """Which positions start a string of ``least`` symbols, none of them 0, that also starts elsewhere.

    ``text`` holds symbols 1 to 256 and 0 as separator.
    """
    n = len(text)
    if n < least:
        return np.zeros(n, bool)
    suffixes, packed = order_suffixes(text, least)
    before = text[suffixes - 1].astype(np.int64)  # of the first suffix the last symbol: a separator or as good as one
    before[suffixes == 0] = 0
    by_symbol = np.argsort(before, kind="stable")
    target = np.empty(n, np.int64)
    target[by_symbol] = np.arange(n)  # where the suffix one symbol longer stands
    lead = text[suffixes]

    # Common prefixes below _PACK come from the packed keys at once; the search goes on from there.
    common = np.full(n + 1, -1, np.int64)
    common[0] = common[n] = 0
    differ = packed[1:] ^ packed[:-1]
    for k in range(_PACK):
        common[1:n][(common[1:n] < 0) & (differ >> (9 * (_PACK - 1 - k)) != 0)] = k
    edges = np.flatnonzero(common >= 0)
    last = np.flatnonzero((common[edges[1:]] == _PACK - 1) | (edges[1:] == n))
    left, right = edges[:-1][last], edges[1:][last] - 1
    tag = np.full(n + 2, -1, np.int64)
    base = 0
    for level in range(_PACK, least):
        if not len(left):
            break
        sizes = right - left + 1
        group = np.repeat(np.arange(len(left)), sizes)
        rows = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + left[group]
        real = before[rows] != 0
        spot, owner = target[rows[real]], group[real] + base
        tag[spot + 1] = owner
        symbol = lead[spot]
        starts = (tag[spot] != owner) | (lead[spot - 1] != symbol)
        after = np.minimum(spot + 1, n - 1)
        ends = (tag[spot + 2 - (spot + 2 > n + 1)] != owner) | (lead[after] != symbol) | (spot == n - 1)
        tag[spot + 1] = -1
        i, j = np.sort(spot[starts]), np.sort(spot[ends])
        new = common[j + 1] < 0
        common[j[new] + 1] = level
        left, right = i[new], j[new]
        base += len(sizes)
    deep = common < 0
    # A start counts if its string has no separator: the distance to the next one is known.
    gap = np.where(text == 0, np.arange(n), n)
    reach = np.minimum.accumulate(gap[::-1])[::-1] - np.arange(n)
    found = np.zeros(n, bool)
    found[suffixes] = deep[:n] | deep[1:]
    return found & (reach >= least)
