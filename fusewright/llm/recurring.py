"""What recurs between documents: marked anchors, and the stretches of windows under them.

Blocks ask shards which of their anchors lie in two documents.  Only the stretches under those go on.  An
anchor with more than ``HOT`` different stretches (a common phrase in ever different company) is told to
be hot: its windows then go one by one, each to the shard of its own hash, so no shard gathers them.  Hashes
route; what is equal is decided on the content.
"""

from __future__ import annotations

import numpy as np

from . import anchors as A
from .common import open_blocks
from .exchange import by_shard, messages

HOT = 1 << 13


class Marks:
    """Protocol: (keys of 47 bits in order, in two documents, number of different stretches) of anchors; 0, 1 or 2 (hot) is told."""

    @staticmethod
    def pack(message):
        key, several, weight = message
        more = np.flatnonzero(weight > 1)
        six = ((key << np.uint64(1)) | several).view(np.uint8).reshape(-1, 8)[:, :6]
        return np.uint32(len(key)).tobytes() + six.tobytes() + np.stack([more, weight[more]]).astype(np.uint32).tobytes()

    @staticmethod
    def unpack(data):
        n = int(np.frombuffer(data, np.uint32, 1)[0])
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :6] = np.frombuffer(data, np.uint8, 6 * n, 4).reshape(-1, 6)
        packed, weight = wide.view(np.uint64).ravel(), np.ones(n, np.uint32)
        more = np.frombuffer(data, np.uint8, offset=4 + 6 * n).copy().view(np.uint32).reshape(2, -1)
        weight[more[0]] = more[1]
        return packed >> np.uint64(1), (packed & np.uint64(1)).astype(bool), weight

    @staticmethod
    def merge(said):
        key, place = np.unique(np.concatenate([m[0] for m in said]), return_inverse=True)
        several = np.bincount(place, minlength=len(key)) > 1
        several |= np.bincount(place, np.concatenate([m[1] for m in said]), len(key)) > 0
        weight = np.minimum(np.bincount(place, np.concatenate([m[2] for m in said]), len(key)), 0xFFFFFFFF).astype(np.uint32)
        return (key, several, weight), np.split(place, np.cumsum([len(m[0]) for m in said])[:-1])

    def __init__(self, hot: int = HOT):
        self.hot = hot

    def resolve(self, message):
        _, several, weight = message
        return several.astype(np.uint8) + (several & (weight > self.hot)), None

    @staticmethod
    def pick(told, places, message):
        code = told[places]
        hot = code > 1
        return bytes([int(hot.any())]) + np.packbits(code > 0).tobytes() + (np.packbits(hot).tobytes() if hot.any() else b"")

    @staticmethod
    def read(data, message):
        n = len(message[0])
        bits = lambda at: np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n)
        return bits(1) + (bits(1 + -(-n // 8)) if data[0] else 0)


def send_anchors(units, shards: int, window: int):
    """units(block, window): see ``ByteUnits``."""

    def run(batches):
        for batch in batches:
            for _, block in open_blocks(batch):
                u = units(block, window)
                anchor, first, last, doc = u.runs()
                known, several, busy = A.distinct(anchor, block.ids[doc], u.looks(first, last))
                weight = np.ones(len(known), np.uint32)
                weight[busy[:, 0]] = busy[:, 1]
                key = known >> np.uint64(17)
                yield messages(block.block_id, *by_shard(known, shards), lambda a, b: Marks.pack((key[a:b], several[a:b], weight[a:b])))  # noqa: B023

    return run


class Stretches:
    """The block's runs under marked anchors, and the distinct contents of them in order of their routing hash.

    first, last, doc: of each run (a window of a hot anchor is a run of its own); which: its content.
    texts, route: contents and their routing hashes, in order; shard, begin, end: stretches of contents.
    """

    def __init__(self, units, block, said, shards: int, window: int):
        u = units(block, window)
        anchor, first, last, doc = u.runs()
        known = np.unique(anchor)
        code = np.zeros(len(known), np.uint8)
        told = {x["shard"]: x["data"] for x in said or ()}
        for s, a, b in zip(*(x.tolist() for x in by_shard(known, shards))):
            if s in told:
                code[a:b] = Marks.read(told[s], (known[a:b],))
        code = code[np.searchsorted(known, anchor)] if len(known) else code
        live, hot = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
        route, first, last, doc, lone = anchor[live], first[live], last[live], doc[live], (first[hot], last[hot], doc[hot])
        if len(hot):
            n = lone[1] - lone[0] + 1
            at = np.repeat(lone[0], n) + within(n)
            route, first, last = np.concatenate([route, u.window_hashes(at)]), np.concatenate([first, at]), np.concatenate([last, at])
            doc = np.concatenate([doc, np.repeat(lone[2], n)])
        seen: dict[bytes, int] = {}
        which = np.fromiter((seen.setdefault(t, len(seen)) for t in u.contents(first, last)), np.int64, len(first))
        of = np.empty(len(seen), np.uint64)
        of[which] = route
        order = np.argsort(of, kind="stable")
        rank = np.empty(len(seen), np.int64)
        rank[order] = np.arange(len(seen))
        texts = list(seen)
        self.units, self.first, self.last, self.doc, self.which = u, first, last, doc, rank[which] if len(seen) else which
        self.texts, self.route = [texts[i] for i in order.tolist()], of[order]
        self.shard, self.begin, self.end = by_shard(self.route, shards)

    def extreme(self, ids: np.ndarray, ufunc, start) -> np.ndarray:
        """The smallest or greatest document of each content."""
        out = np.full(len(self.texts), start, np.int64)
        ufunc.at(out, self.which, ids[self.doc])
        return out


def within(counts: np.ndarray) -> np.ndarray:
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
