"""Suffix arrays in numpy: Larsson-Sadakane refinement, lane-wise Kasai, and binary search.

All three work on whole arrays: a round of refinement sorts only the suffixes that still tie, by
the rank of the suffix that starts `h` further on; Kasai's scan runs in many stretches of the text
at once; and a search narrows the ranges of all searched suffixes together, one token at a time.
"""

from __future__ import annotations

import numpy as np


def suffix_array(keys: np.ndarray, width: int, depth: int) -> np.ndarray:
    """Order of the suffixes of a sequence by their first `depth` tokens (or more; ties in any order).

    keys[i] must order suffix i by its first `width` tokens, and must tell a suffix that ends
    within them from one that goes on.
    """
    n = len(keys)
    order = np.argsort(keys).astype(np.int64)
    if n < 2:
        return order
    inner = keys[order]
    new = np.empty(n, bool)
    new[0], new[1:] = True, inner[1:] != inner[:-1]
    # A group of ties has the index of its first member + 1 as rank; 0 is "past the end".
    rank = np.zeros(n + 1, np.int64)
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, n))
    rank[order] = np.repeat(heads + 1, counts)
    tied = np.repeat(counts > 1, counts)
    slots = np.flatnonzero(tied)
    h = width
    while len(slots) and h < depth:
        at = order[slots]
        key = rank[at] * np.int64(n + 1) + rank[np.minimum(at + h, n)]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        new = np.empty(len(slots), bool)
        new[0], new[1:] = True, key[1:] != key[:-1]
        heads = np.flatnonzero(new)
        counts = np.diff(np.append(heads, len(slots)))
        rank[at] = np.repeat(slots[heads] + 1, counts)
        slots = slots[np.repeat(counts > 1, counts)]
        h *= 2
    return order


def packed_bytes(data: np.ndarray) -> np.ndarray:
    """The next eight bytes at every position as one big-endian number; past the end counts as 0.

    A zero byte looks like the end here; callers put bytes behind the last text that no text has, so no end is near.
    """
    padded = np.zeros(len(data) + 8, np.uint64)
    padded[: len(data)] = data
    out = padded[: len(data)] << np.uint64(56)
    for j in range(1, 8):
        out |= padded[j : len(data) + j] << np.uint64(56 - 8 * j)
    return out


def common_prefixes(packed: np.ndarray, order: np.ndarray, most: int, lanes: int = 16_384) -> np.ndarray:
    """Kasai: length of the common prefix of each suffix in `order` with the one before, up to `most`.

    The text is cut into lanes, each scanned from left to right with Kasai's rule that the length
    falls by one at most from one position to the next; a step of the scan works on all lanes, and
    compares eight bytes at a time.
    """
    n = len(order)
    if not n:
        return np.zeros(0, np.int64)
    before = np.empty(n, np.int64)
    before[order[0]], before[order[1:]] = -1, order[:-1]
    length = np.zeros(n, np.int64)
    stretch = -(-n // min(lanes, n))
    base = np.arange(0, n, stretch)
    known = np.zeros(len(base), np.int64)
    for step in range(stretch):
        at = base + step
        if at[-1] >= n:
            base, known, at = base[:-1], known[:-1], at[:-1]
            if not len(at):
                break
        other = before[at]
        known = np.where(other < 0, 0, np.maximum(known - 1, 0))
        go = np.flatnonzero((other >= 0) & (known < most))
        while len(go):
            i, j = at[go] + known[go], other[go] + known[go]
            inside = np.maximum(i, j) < n
            go, i, j = go[inside], i[inside], j[inside]
            differ = packed[i] ^ packed[j]
            # Leading equal bytes: from the number of bits; exact, for a float keeps the exponent.
            bits = np.frexp((differ >> np.uint64(11)).astype(np.float64))[1] + 11
            bits = np.where(differ >> np.uint64(11) == 0, np.frexp(differ.astype(np.float64))[1], bits)
            same = np.where(differ == 0, 8, (64 - bits) // 8)
            known[go] = np.minimum(known[go] + np.minimum(same, n - np.maximum(i, j)), most)
            go = go[(same == 8) & (known[go] < most)]
        length[at] = known
    return length[order]


def search(tokens: np.ndarray, order: np.ndarray, tests: np.ndarray, at: int, starts: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Narrow the ranges [lo, hi) of `order`, whose suffixes agree with the searched ones up to token
    `at`, to those that agree with tests[starts + at] too."""
    n = len(tokens)
    wanted = tests[starts + at]

    def bound(right: bool) -> np.ndarray:
        a, b = lo.copy(), hi.copy()
        while (open_ := np.flatnonzero(a < b)).size:
            middle = (a[open_] + b[open_]) >> 1
            place = order[middle] + at
            there = np.where(place < n, tokens[np.minimum(place, n - 1)], 0)
            less = (there <= wanted[open_]) if right else (there < wanted[open_])
            a[open_] = np.where(less, middle + 1, a[open_])
            b[open_] = np.where(less, b[open_], middle)
        return a

    return bound(False), bound(True)
