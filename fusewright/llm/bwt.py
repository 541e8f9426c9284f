"""Longest common prefixes from a Burrows-Wheeler transform, in increasing order and only up to a bound."""

from __future__ import annotations

import numpy as np

SEPARATOR = 0xFF  # no UTF-8 text holds it, and it sorts after every byte that one holds


def bounded_suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` sorted by the ``depth`` bytes from each on (ties in any order)."""
    n = len(text)
    padded = np.concatenate([text, np.full(depth + 8, SEPARATOR, np.uint8)])
    key = np.ndarray((n,), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)
    have = min(8, depth)
    if depth < 8:
        key >>= np.uint64(8 * (8 - depth))
    while True:
        order = np.argsort(key)
        if have >= depth:
            return order
        sorted_key = key[order]
        new = np.empty(n, np.uint64)
        new[0] = 1
        np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:], casting="unsafe")
        rank = np.empty(n + depth, np.uint64)
        rank[n:] = 0xFFFFFFFF
        rank[order] = np.cumsum(new)
        step = min(have, depth - have)
        key = (rank[:n] << np.uint64(32)) | rank[step : step + n]
        have += step


def bounded_common_prefixes(transform: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix length of each sorted suffix with the one before; ``depth`` stands for that or more.

    Breadth first over intervals of the sorted suffixes: the interval of every string of length l is
    extended backwards by each byte that precedes it.  A right end met for the first time separates
    suffixes whose common prefix is exactly l; an interval with a known right end is not followed again.
    Levels stop at ``depth``.
    """
    n = len(transform)
    order = np.argsort(transform, kind="stable").astype(np.int32)
    ranked = transform[order]
    to = np.empty(n, np.int32)  # where a suffix goes when its preceding byte is put before it
    to[order] = np.arange(n, dtype=np.int32)
    after = np.full(n, n, np.int32)  # next and previous suffix with the same preceding byte
    before = np.full(n, -1, np.int32)
    same = ranked[1:] == ranked[:-1]
    after[order[:-1][same]] = order[1:][same]
    before[order[1:][same]] = order[:-1][same]
    usable = transform != SEPARATOR
    prefix = np.full(n + 1, depth, np.int32)
    prefix[0] = prefix[n] = 0
    left, right = np.array([0], np.int32), np.array([n], np.int32)
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    for level in range(depth):
        if not len(left):
            break
        size = right - left
        at = np.repeat(left - (np.cumsum(size, dtype=np.int32) - size), size) + np.arange(size.sum(), dtype=np.int32)
        at_right = np.repeat(right, size)
        at_left = np.repeat(left, size)
        inside = usable[at]
        ends = to[at[inside & (after[at] >= at_right)]] + 1
        begins = to[at[inside & (before[at] < at_left)]]
        ends.sort()  # extensions of different strings or bytes never overlap: sorting pairs both ends
        begins.sort()
        fresh = ~known[ends]
        left, right = begins[fresh], ends[fresh]
        known[right] = True
        prefix[right] = level
    return prefix[:n]


def repeat_groups(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted positions, first rank of each group): suffixes of one group share ``depth`` bytes."""
    order = bounded_suffix_order(text, depth)
    transform = text[order - 1]
    prefix = bounded_common_prefixes(transform, depth)
    return order, np.flatnonzero(prefix < depth)
