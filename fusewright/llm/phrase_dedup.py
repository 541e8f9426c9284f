"""Repeated-phrase removal: recurring passages are confirmed, compiled into Aho-Corasick automata, and
every document is streamed through the automata that can concern it.

Each word is removed that is covered by a window of 13 words which also starts in a document with a
smaller ``doc_id``.

1. Blocks of documents ask hash shards which of their anchors (least hash of five words within a window) lie in
   two documents, or in so much different company that windows have to go one by one (see ``recurring``).
2. Blocks send the distinct stretches of words under marked anchors.  A shard compares their windows word
   by word and confirms the recurring ones with the smallest document of each.  Neighbouring windows with
   one smallest document form a passage.  Each block is told the passages which its own stretches hold and
   a smaller document owns: an automaton is a shard of all passages, namely those that can occur in its block,
   so its size follows a block and not the corpus.
3. A block compiles its passages into automata of a bounded number of passages, a word being one symbol,
   and streams all of its documents through each; an occurrence in a later document than the owner goes.

Defined cases: a null text has no words; a null ``doc_id`` counts as later than all others and owns
nothing; rows of equal ``doc_id`` do not remove one another; an empty table gives an empty result; other
columns are not read; a very long text is a block of its own.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchors as A
from .common import NULL_ID, batchwise, discard, id_column, let_go, open_blocks, pack_blocks, rows_of, shard_count, squeeze, store, unsqueeze
from .exchange import FAN, SENT_SQL, ask, by_block, messages
from .recurring import HOT, Marks, Stretches, send_anchors
from .words import doc_ranges, word_hashes, word_spans

GRAM = 5
SHARD_BYTES = 2 << 20  # text in the corpus for each shard
PASSAGES_EACH = 50_000  # passages in one automaton


class WordUnits:
    """Windows of words of a block."""

    def __init__(self, block, window: int):
        self.block, self.window = block, window
        self.starts, self.ends = word_spans(block.bytes, block.starts[block.sizes > 0])
        self.hashes = word_hashes(block.bytes, self.starts, self.ends)

    def runs(self):
        low = A.sliding_min(A.sequence_grams(self.hashes, GRAM), self.window - GRAM + 1)
        return A.runs(low, self.window, *doc_ranges(self.starts, self.block.starts, self.block.ends))

    def looks(self, first, last):
        h = self.hashes
        return A.mix(h[first] * A._M1 + h[last + self.window - 1] * A._M2 + (last - first).astype(np.uint64)) if len(first) else np.empty(0, np.uint64)

    def window_hashes(self, at):
        return A.sequence_grams(self.hashes, self.window)[at]

    def contents(self, first, last):
        words = [w for d in split_words(self.block) for w in d]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        begins, line = np.append(0, ends), b" ".join(words)
        return (line[a:b] for a, b in zip(begins[first].tolist(), (ends[last + self.window - 1] - 1).tolist()))


def split_words(block) -> list[list[bytes]]:
    return [block.body[a:b].split() for a, b in zip(block.starts.tolist(), block.ends.tolist())]


class Passages:
    """Protocol: (stretches of words, smallest document of each, greatest one); of each the passages (owner, words) are told."""

    def __init__(self, window: int):
        self.window = window

    @staticmethod
    def pack(message):
        texts, least, most = message
        return squeeze(np.int64(len(texts)).tobytes() + least.tobytes() + most.tobytes() + b"\n".join(texts))

    @staticmethod
    def unpack(data):
        data = unsqueeze(data)
        n = int(np.frombuffer(data, np.int64, 1)[0])
        return data[8 + 16 * n :].split(b"\n"), np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.int64, n, 8 + 8 * n)

    @staticmethod
    def merge(said):
        known: dict[bytes, int] = {}
        places = [np.fromiter((known.setdefault(t, len(known)) for t in texts), np.int64, len(texts)) for texts, _, _ in said]
        least, most = np.full(len(known), NULL_ID), np.full(len(known), -NULL_ID)
        for at, (_, low, high) in zip(places, said):
            np.minimum.at(least, at, low)
            np.maximum.at(most, at, high)
        return (list(known), least, most), places

    def resolve(self, message):
        texts, owner, _ = message
        window = self.window
        first: dict[bytes, int] = {}
        parts: list[tuple[list[bytes], list[bytes]]] = []
        for t, d in zip(texts, owner.tolist()):
            w = t.split(b" ")
            keys = [b" ".join(w[k : k + window]) for k in range(len(w) - window + 1)] if len(w) > window else [t]
            parts.append((w, keys))
            for key in keys:
                if d < first.get(key, NULL_ID + 1):
                    first[key] = d
        passages = []
        for w, keys in parts:
            found, at, owners = [], 0, [first[k] for k in keys]
            for k in range(1, len(keys) + 1):
                if k == len(keys) or owners[k] != owners[at]:
                    found.append((owners[at], b" ".join(w[at : k - 1 + window])))
                    at = k
            passages.append(found)
        return passages, None

    @staticmethod
    def pick(answers, places, message):
        told = [[p for p in answers[k] if p[0] < m] for k, m in zip(places.tolist(), message[2].tolist())]
        flat = [p for x in told for p in x]
        sizes = np.fromiter(map(len, told), np.int32, len(told))
        return squeeze(np.array([len(told), len(flat)], np.int64).tobytes() + sizes.tobytes() + np.array([o for o, _ in flat], np.int64).tobytes() + b"\n".join([p for _, p in flat]))

    @staticmethod
    def read(data, message=None):
        data = unsqueeze(data)
        n, m = np.frombuffer(data, np.int64, 2).tolist()
        flat = list(zip(np.frombuffer(data, np.int64, m, 16 + 4 * n).tolist(), data[16 + 4 * n + 8 * m :].split(b"\n"))) if m else []
        ends = np.cumsum(np.frombuffer(data, np.int32, n, 16)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


def _send_stretches(shards, window):
    def run(batches):
        for batch in batches:
            said = batch.column("said")
            for i, block in open_blocks(batch):
                s = Stretches(WordUnits, block, said[i].as_py(), shards, window)
                least, most = s.extreme(block.ids, np.minimum, NULL_ID), s.extreme(block.ids, np.maximum, -NULL_ID)
                yield messages(block.block_id, s.shard, s.begin, s.end, lambda a, b: Passages.pack((s.texts[a:b], least[a:b], most[a:b])))  # noqa: B023

    return run


def _passages(told):
    """(passage, owner) of a block, each once."""
    return list({p: o for x in told or () for found in Passages.read(x["data"]) for o, p in found}.items())


def _symbol(k: int) -> str:
    """A word as two characters of disjoint ranges: a state then has few children, which it keeps in a list."""
    return chr(1 + (k >> 8)) + chr(0x4000 + (k & 255))


def mark_occurrences(docs: list[list[bytes]], ids: list[int], passages: list[tuple[bytes, int]], window: int) -> list[bytearray]:
    """Streams the documents through automata of the passages; 1 for every word that goes.

    A word of no passage takes every automaton back to its root, so stretches between such words are
    streamed one by one, and those too short for a window not at all.
    """
    gone = [bytearray(len(d)) for d in docs]
    for at in range(0, len(passages), PASSAGES_EACH):
        symbols: dict[bytes, str] = {}
        automaton = ahocorasick.Automaton()
        for text, owner in passages[at : at + PASSAGES_EACH]:
            words = text.split(b" ")
            automaton.add_word("".join([symbols.get(w) or symbols.setdefault(w, _symbol(len(symbols))) for w in words]), (owner, len(words)))
        automaton.make_automaton()
        for words, doc_id, mark in zip(docs, ids, gone):
            start = 0
            for piece in "".join(map(symbols.get, words, repeat("\0"))).split("\0"):
                if len(piece) >= 2 * window:
                    for end, (owner, n) in automaton.iter(piece):
                        if owner < doc_id:
                            to = start + (end >> 1) + 1
                            mark[to - n : to] = b"\1" * n
                start += (len(piece) >> 1) + 1
    return gone


def _finish(window, digest):
    def run(batches):
        types = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
        schema = pa.schema(types if digest else [*types, ("kept", pa.string())])
        for batch in batches:
            told = batch.column("told")
            for i, block in open_blocks(batch):
                docs = split_words(block)
                gone = mark_occurrences(docs, block.ids.tolist(), _passages(told[i].as_py()), window)
                kept = [b" ".join([w for w, g in zip(d, m) if not g]) if 1 in m else b" ".join(d) for d, m in zip(docs, gone)]
                columns = [id_column(block.ids), [len(d) for d in docs], [sum(m) for m in gone], [hashlib.sha256(k).hexdigest() for k in kept]]
                yield rows_of(schema, columns if digest else [*columns, [k.decode() for k in kept]])

    return run


def remove_phrases(docs: DataFrame, window: int = 13, digest: bool = False, hot: int = HOT, fan: int = FAN) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and, unless ``digest``, the kept words."""
    if window < GRAM + 1:
        raise ValueError(f"the window must be longer than {GRAM} words")
    blocks = pack_blocks(docs)
    n_blocks, shards = shard_count(blocks, SHARD_BYTES)
    sent = blocks.mapInArrow(batchwise(send_anchors(WordUnits, shards, window)), SENT_SQL)
    marks = store(by_block(ask(sent, n_blocks, shards, Marks(hot), fan), "said"), "marks")
    stretches = blocks.join(marks, "block_id", "left").mapInArrow(batchwise(_send_stretches(shards, window)), SENT_SQL)
    told = store(by_block(ask(stretches, n_blocks, shards, Passages(window), fan), "told"), "passages")
    discard(marks)
    del sent, stretches
    let_go(docs.sparkSession)
    names = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ("" if digest else ", kept string")
    return blocks.join(told, "block_id", "left").mapInArrow(batchwise(_finish(window, digest)), names)
