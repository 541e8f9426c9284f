"""Words of packed blocks as arrays: runs of bytes other than ASCII white space, never across documents."""

from __future__ import annotations

import numpy as np

from .anchors import _M2, mix

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def word_spans(body: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after its last."""
    if not len(body):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    solid = ~_SPACE[body]
    fresh = np.zeros(len(body) + 1, bool)  # a document begins here, or the text ends
    fresh[doc_starts] = True
    fresh[-1] = True
    begins, ends = solid.copy(), np.zeros(len(body), bool)
    begins[1:] &= ~solid[:-1] | fresh[1:-1]
    ends[:-1] = ~solid[1:]
    ends = solid & (ends | fresh[1:])
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(body),), dtype="<u8", buffer=padded, strides=(1,))
    sizes = ends - starts
    h = eight[starts] & _MASK[np.minimum(sizes, 8)]
    h = mix(h * _M2 + sizes.astype(np.uint64))
    more, at = np.flatnonzero(sizes > 8), 8
    while len(more):
        h[more] = mix(h[more] * _M2 + (eight[starts[more] + at] & _MASK[np.minimum(sizes[more] - at, 8)]))
        at += 8
        more = more[sizes[more] > at]
    return h


def doc_ranges(starts: np.ndarray, doc_starts: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each document, and the word after its last."""
    return np.searchsorted(starts, doc_starts), np.searchsorted(starts, doc_ends)


def lower_ascii(body: np.ndarray) -> np.ndarray:
    return np.where((body >= 65) & (body <= 90), body + np.uint8(32), body)
