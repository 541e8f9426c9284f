"""Content anchors: the least hash of the grams inside a window, the same wherever the window recurs.

Every window of ``window`` units has one anchor, so windows of equal content meet under one anchor and a
run of neighbouring windows shares it.  Shards are equal ranges of hashes: equal windows never part.  All of
this is arithmetic on arrays, so the work of a block follows its text, whatever the number of shards.
"""

from __future__ import annotations

import numpy as np

_M1, _M2, _M3, _M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
CHUNK = 1 << 15  # positions hashed at once, so that intermediate arrays stay small


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _M4
    h ^= h >> np.uint64(29)
    h *= _M1
    h ^= h >> np.uint64(32)
    return h


def loads(body: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one little-endian integer."""
    if len(body) < 8:
        return np.empty(0, np.uint64)
    body = np.ascontiguousarray(body)
    return np.ndarray((len(body) - 7,), dtype="<u8", buffer=body, strides=(1,))


def byte_grams(u: np.ndarray) -> np.ndarray:
    """Hash of the 24 bytes from each position on, given ``loads``."""
    n = len(u) - 16
    if n < 1:
        return np.empty(0, np.uint64)
    return mix(u[:n] * _M1 + u[8 : 8 + n] * _M2 + (u[16:] ^ (u[:n] >> np.uint64(7))) * _M3)


def sequence_grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values (64-bit hashes) from each position on."""
    n = len(values) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * _M2 + values[i : i + n]
    return mix(h)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        h = np.minimum(h[:-step], h[step:]) if len(h) > step else h[:0]
        have += step
    return h


def byte_anchors(body: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` neighbouring 24-byte grams from each position on, chunk by chunk."""
    u = loads(body)
    low = np.empty(max(0, len(u) - 16 - width + 1), np.uint64)
    for at in range(0, len(low), CHUNK):
        low[at : at + CHUNK] = sliding_min(byte_grams(u[at : at + CHUNK + width - 1 + 16]), width)[:CHUNK]
    return low


def runs(low: np.ndarray, window: int, starts: np.ndarray, ends: np.ndarray):
    """(anchor, first window, last window, document) of each run of windows that share an anchor.

    low: anchor of the window from each unit on; starts, ends: unit ranges of the documents in the
    concatenation; windows cross no document.
    """
    some = np.flatnonzero(ends - starts >= window)
    if not len(some):
        z = np.empty(0, np.int64)
        return np.empty(0, np.uint64), z, z, z
    begin, end = starts[some], ends[some] - window + 1  # of the windows of each document that has one
    step = np.zeros(len(low) + 1, np.int8)
    step[begin] += 1
    step[end] -= 1  # units between documents of full windows stay outside: end < the next begin
    inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    new = inside.copy()
    new[1:] &= low[1:] != low[:-1]
    new[begin] = True
    first = np.flatnonzero(new)
    doc = np.searchsorted(begin, first, side="right") - 1
    last = np.minimum(np.append(first[1:], len(low)), end[doc]) - 1
    return low[first], first, last, some[doc]


def distinct(anchor: np.ndarray, doc: np.ndarray, look: np.ndarray, busy: int = 16):
    """(sorted distinct anchors, whether each lies in two documents at least, [(place, number of different looks)]).

    The last tells only of anchors of ``busy`` runs and more; a look stands for what a run holds.
    """
    if not len(anchor):
        return anchor, np.empty(0, bool), np.empty((0, 2), np.uint32)
    order = np.argsort(anchor, kind="stable")
    a, d = anchor[order], doc[order]
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    size = np.diff(np.append(first, len(a)))
    many = np.flatnonzero(size >= busy)
    looks = [(i, len(np.unique(look[order[first[i] : first[i] + size[i]]]))) for i in many.tolist()]
    return a[first], np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first), np.array(looks, np.uint32).reshape(-1, 2)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are equal ranges of the upper 32 bits."""
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def slices(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, begin, end) of each stretch of equal values."""
    if not len(ordered):
        z = np.empty(0, np.int64)
        return ordered, z, z
    begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return ordered[begin], begin, np.append(begin[1:], len(ordered))
