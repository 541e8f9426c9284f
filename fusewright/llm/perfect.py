"""A minimal perfect hash of pairs of 64-bit hashes, in levels of bits; all of it is arithmetic on arrays.

Every level hashes the keys that are left to twice as many bits as they are; a key alone on its bit is placed there, the others go
to the next level.  A key's slot is the number of set bits before its own.  A pair that is no key may get any slot, so callers keep the keys
by slot and compare.
"""

from __future__ import annotations

import numpy as np

from .anchors import _M1, _M3, mix

ROOM = 2  # bits a key on its level


def _spot(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    h = mix((a ^ mix(b + np.uint64(level * int(_M1) & 0xFFFFFFFFFFFFFFFF))) + _M3)
    return (((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    """Slots 0 to n - 1 of n different pairs."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.bits, self.sizes = bits, sizes
        self.starts = np.cumsum(sizes) - sizes
        self.before = np.cumsum(bits, dtype=np.int64) - bits

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels = []
        while len(a):
            size = max(8, ROOM * len(a))
            at = _spot(a, b, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = ~alone[at]
            a, b = a[left], b[left]
        return cls(np.concatenate(levels) if levels else np.zeros(0, bool), np.array([len(x) for x in levels], np.int64))

    def slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of pairs; -1 where no level has a bit for it."""
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (start, size) in enumerate(zip(self.starts.tolist(), self.sizes.tolist())):
            at = start + _spot(a[left], b[left], level, size)
            here = self.bits[at]
            out[left[here]] = self.before[at[here]]
            left = left[~here]
        return out

    def pack(self) -> bytes:
        return np.array([len(self.sizes), *self.sizes], np.int64).tobytes() + np.packbits(self.bits).tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> PerfectHash:
        levels = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, levels, 8)
        return cls(np.unpackbits(np.frombuffer(data, np.uint8, offset=8 * (levels + 1)), count=int(sizes.sum())).astype(bool), sizes)
