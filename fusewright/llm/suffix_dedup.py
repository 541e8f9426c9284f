"""Exact substring removal: threshold-bounded interval expansion on sharded Burrows-Wheeler transforms.

Every 50-byte string that also starts in a document with a smaller ``doc_id`` is removed.

1. Blocks of documents ask hash shards which of their anchors (see ``anchors``) lie in two documents, or in
   so much different company that their windows have to go one by one (see ``recurring``).
2. Blocks send the distinct stretches of text under marked anchors, with the smallest ``doc_id`` that
   holds each.  All windows of equal content have one anchor, so they meet in one shard.
3. A shard concatenates the stretches of anchors that have several, builds their Burrows-Wheeler transform, derives
   common prefixes in increasing order up to 50 and so gets the groups of windows with equal content, each with
   the smallest document.  Bytes decide; hashes only route.
4. Blocks remove what a smaller document has.

A task reads one block or one shard; both have a bounded size.  A stretch comes from a block once however
many copies that block holds, and from a team of blocks once (see ``exchange``), so large groups of copies
stay small in every shard.

Defined cases: a null text is empty; texts shorter than the window lose nothing; a null ``doc_id`` counts
as later than all others; rows with equal ``doc_id`` do not remove one another; an empty table gives an
empty result.  Other columns pass through whatever their names; a very long text is a block of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from .bwt import repeat_groups
from .common import NULL_ID, as_before, batchwise, block_rows, discard, id_column, let_go, open_blocks, pack_blocks, pack_rows, rows_of, rows_schema, shard_count, squeeze, store, unsqueeze
from .exchange import FAN, SENT_SQL, ask, by_block, messages
from .recurring import HOT, Marks, Stretches, send_anchors, within

GRAM = 24
SHARD_BYTES = 2 << 20  # text in the corpus for each shard
BATCH_BYTES = 1 << 20  # text of one transform; a shard works through its anchors in such batches
PART = 1 << 19  # windows looked at together when bytes are removed


class ByteUnits:
    """Windows of bytes of a block."""

    def __init__(self, block, window: int):
        self.block, self.window = block, window

    def runs(self):
        return A.runs(A.byte_anchors(self.block.bytes, self.window - GRAM + 1), self.window, self.block.starts, self.block.ends)

    def looks(self, first, last):
        """One number for the content of each stretch; equal content looks the same."""
        u = A.loads(self.block.bytes)
        return A.mix(u[first] * A._M1 + u[last + self.window - 8] * A._M2 + (last - first).astype(np.uint64)) if len(first) else np.empty(0, np.uint64)

    def window_hashes(self, at):
        u = A.loads(self.block.bytes)
        h = np.zeros(len(at), np.uint64)
        for k in (*range(0, self.window - 8, 8), self.window - 8):
            h = h * A._M2 + A.mix(u[at + k])
        return A.mix(h)

    def contents(self, first, last):
        body, window = self.block.body, self.window
        return (body[a : b + window] for a, b in zip(first.tolist(), last.tolist()))


class Owners:
    """Protocol: (texts, smallest document of each, 32 bits of its anchor) of stretches; the smallest document of every window is told."""

    def __init__(self, window: int):
        self.window = window

    @staticmethod
    def pack(message):
        texts, least, sub = message
        sizes = np.fromiter(map(len, texts), np.int32, len(texts))
        return squeeze(np.int64(len(texts)).tobytes() + sizes.tobytes() + least.tobytes() + sub.tobytes() + b"".join(texts))

    @staticmethod
    def unpack(data):
        data = unsqueeze(data)
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes, least, sub = np.frombuffer(data, np.int32, n, 8), np.frombuffer(data, np.int64, n, 8 + 4 * n), np.frombuffer(data, np.uint32, n, 8 + 12 * n)
        ends = np.cumsum(sizes) + 8 + 16 * n
        return [data[e - k : e] for e, k in zip(ends.tolist(), sizes.tolist())], least, sub

    @staticmethod
    def merge(said):
        known: dict[bytes, int] = {}
        places = [np.fromiter((known.setdefault(t, len(known)) for t in texts), np.int64, len(texts)) for texts, _, _ in said]
        least, sub = np.full(len(known), NULL_ID), np.empty(len(known), np.uint32)
        for at, (_, mine, bits) in zip(places, said):
            np.minimum.at(least, at, mine)
            sub[at] = bits
        return (list(known), least, sub), places

    def _windows(self, texts):
        windows = np.fromiter(map(len, texts), np.int64, len(texts)) - self.window + 1
        return windows, np.cumsum(windows) - windows

    def resolve(self, message):
        texts, owner, sub = message
        windows, begun = self._windows(texts)
        sizes = windows + self.window - 1
        found = np.repeat(owner, windows)  # right where an anchor has one stretch only: equal windows have one anchor
        order = np.argsort(sub, kind="stable")
        of = sub[order]
        near = np.append(of[1:] == of[:-1], False)
        near[1:] |= near[:-1].copy()
        order = order[near]
        in_order, room = sub[order], np.cumsum(sizes[order] + 1)
        at = 0
        while at < len(order):  # batches end between anchors
            to = max(at + 1, int(np.searchsorted(room, (room[at - 1] if at else 0) + BATCH_BYTES)))
            to = int(np.searchsorted(in_order, in_order[to - 1], side="right"))
            part = order[at:to]
            text = np.frombuffer(b"\xff".join([texts[i] for i in part.tolist()] + [b""]), np.uint8)
            start = np.repeat(np.cumsum(sizes[part] + 1) - sizes[part] - 1, windows[part]) + within(windows[part])
            holder = np.full(len(text), NULL_ID)
            holder[start] = np.repeat(owner[part], windows[part])
            ranks, groups = repeat_groups(text, self.window)
            least = np.minimum.reduceat(holder[ranks], groups)
            holder[ranks] = np.repeat(least, np.diff(np.append(groups, len(ranks))))
            found[np.repeat(begun[part], windows[part]) + within(windows[part])] = holder[start]
            at = to
        return (found, windows, begun), None

    @staticmethod
    def pick(answers, places, message):
        found, windows, begun = answers
        n = windows[places]
        v = found[np.repeat(begun[places], n) + within(n)]
        change = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.empty(0, np.int64)
        return squeeze(np.int64(len(v)).tobytes() + change.astype(np.int32).tobytes() + v[change].tobytes())

    def read(self, data, message):
        return owners(data), *self._windows(message[0])


def owners(data: bytes) -> np.ndarray:
    data = unsqueeze(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    k = (len(data) - 8) // 12
    change = np.frombuffer(data, np.int32, k, 8)
    return np.repeat(np.frombuffer(data, np.int64, k, 8 + 4 * k), np.diff(np.append(change, n)))


def _send_stretches(shards, window):
    def run(batches):
        for batch in batches:
            said = batch.column("said")
            for i, block in open_blocks(batch):
                s = Stretches(ByteUnits, block, said[i].as_py(), shards, window)
                least, sub = s.extreme(block.ids, np.minimum, NULL_ID), s.route.astype(np.uint32)
                yield messages(block.block_id, s.shard, s.begin, s.end, lambda a, b: Owners.pack((s.texts[a:b], least[a:b], sub[a:b])))  # noqa: B023

    return run


def _removed(block, said, owned, shards, window) -> np.ndarray:
    """Which bytes of the block go."""
    s = Stretches(ByteUnits, block, said, shards, window)
    start = np.zeros(len(block.bytes), bool)
    told = {x["shard"]: x["data"] for x in owned or ()}
    least = np.concatenate([owners(told[k]) for k in s.shard.tolist()]) if len(s.shard) else np.empty(0, np.int64)
    windows = np.fromiter(map(len, s.texts), np.int64, len(s.texts)) - window + 1
    begun = np.cumsum(windows) - windows
    n = s.last - s.first + 1
    edges = np.append(0, np.cumsum(n))
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + PART, side="right")) - 1)
        k = within(n[at:to])
        gone = least[np.repeat(begun[s.which[at:to]], n[at:to]) + k] < np.repeat(block.ids[s.doc[at:to]], n[at:to])
        start[np.repeat(s.first[at:to], n[at:to]) + k] = gone
        at = to
    total = np.cumsum(start, dtype=np.int32)
    total[window:] -= total[:-window].copy()
    return total > 0


def _kept(block, said, owned, shards, window):
    gone = _removed(block, said, owned, shards, window)
    for a, b in zip(block.starts.tolist(), block.ends.tolist()):
        g = gone[a:b]
        yield block.bytes[a:b][~g].tobytes(), int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _finish(shards, window, digest):
    def run(batches):
        schema = pa.schema(list(_RESULT)[:5]) if digest else _RESULT
        for batch in batches:
            said, owned = batch.column("said"), batch.column("owned")
            for i, block in open_blocks(batch):
                kept, n_gone, n_spans = zip(*_kept(block, said[i].as_py(), owned[i].as_py(), shards, window))
                columns = [id_column(block.ids), block.sizes, n_gone, n_spans, [hashlib.sha256(k).hexdigest() for k in kept]]
                yield rows_of(schema, columns if digest else [*columns, kept])

    return run


def _finish_rows(shards, window, names):
    def run(batches):
        for batch in batches:
            said, owned = batch.column("said"), batch.column("owned")
            for i, block in open_blocks(batch):
                yield block_rows(block, names, texts=[k.decode("utf-8", "ignore") for k, _, _ in _kept(block, said[i].as_py(), owned[i].as_py(), shards, window)])

    return run


def _prepare(blocks: DataFrame, window: int, hot: int, fan: int):
    if window < GRAM + 1:
        raise ValueError(f"the window must be longer than {GRAM} bytes")
    lean = blocks.drop("rest")
    n_blocks, shards = shard_count(blocks, SHARD_BYTES)
    sent = lean.mapInArrow(batchwise(send_anchors(ByteUnits, shards, window)), SENT_SQL)
    marks = store(by_block(ask(sent, n_blocks, shards, Marks(hot), fan), "said"), "marks")
    stretches = lean.join(marks, "block_id", "left").mapInArrow(batchwise(_send_stretches(shards, window)), SENT_SQL)
    answers = store(marks.join(by_block(ask(stretches, n_blocks, shards, Owners(window), fan), "owned"), "block_id", "left"), "owners")
    discard(marks)
    del sent, stretches
    let_go(blocks.sparkSession)
    return blocks.join(answers, "block_id", "left"), shards


def remove_repeats(docs: DataFrame, window: int = 50, digest: bool = False, hot: int = HOT, fan: int = FAN) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, unless ``digest``, the kept bytes."""
    ready, shards = _prepare(pack_blocks(docs), window, hot, fan)
    names = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ("" if digest else ", kept binary")
    return ready.mapInArrow(batchwise(_finish(shards, window, digest)), names)


def edited(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` with the repeats cut out of ``text`` and n_chars counted anew.

    Where a cut goes through a character, the bytes left of it are no text and go too; null texts stay null.
    """
    ready, shards = _prepare(pack_rows(docs), window, HOT, FAN)
    return as_before(ready.mapInArrow(batchwise(_finish_rows(shards, window, docs.columns)), rows_schema(docs)), docs)
