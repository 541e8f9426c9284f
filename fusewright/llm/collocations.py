"""Phrase collocations: phrases of two to four words whose parts seldom stand without each other.

Tasks read slices of text and count the distinct phrases of each; the counts go to hash shards, one message for each slice and shard.
A shard first adds all it was sent into hashed buckets: only phrases whose bucket reaches the least count can reach it themselves, so the
others go at once (safe: a bucket never has less than its phrase).  A minimal perfect hash over these candidates, with the candidates
stored by slot and compared, turns every message into an array by ``bincount``, and the arrays are summed pairwise.  Phrases of three and
four words are only counted where all their word pairs are frequent (a bit map of fixed size at most tells; it errs to the safe side).  A third
reading gives the texts of what turned out frequent; the shards then tell the counts of every phrase and of its parts by slot.

Shards follow the amount of text, so what one gathers stays bounded; a phrase that all slices have is one item of each message.  Phrases are told apart
by 126 bits of two hashes.  Products are decimals of 38 digits.

Defined cases: a null text is empty; a null lang is ``und``, together with a lang that is so called; rows of equal ``doc_id`` all count, also with a null
one (the id is not read); without frequent phrases, or on an empty table, the result is empty; other columns are not read; a very long text is a slice of its own;
phrases of equal score and count are ranked by their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import anchors as A
from .common import batchwise, column, discard, groupwise, picked, rows_of, store, utf8_parts
from .exchange import by_shard
from .perfect import PerfectHash
from .words import lower_ascii, word_hashes, word_spans

SLICE_BYTES, SHARD_BYTES = 8 << 20, 16 << 20
MOST_BITS = 28  # 32 MB of bit map, whatever the input
SALTS = 64
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_TAG = np.uint64(3)


class Words:
    """Words of texts: two hashes each (the language is part of both), and whether the next word follows in the same piece."""

    def __init__(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray, marks: np.ndarray):
        """marks: two hashes of each text's language."""
        low = lower_ascii(body)
        broken = _BREAK[low]
        text = np.where(broken, np.uint8(32), low)
        some = ends > starts
        self.first, self.end = word_spans(text, starts[some])
        doc = np.searchsorted(ends, self.first, side="right")
        piece = np.cumsum(broken, dtype=np.int32)[self.first] if len(self.first) else np.empty(0, np.int32)
        self.body, self.doc = text, doc
        self.next = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1]) if len(doc) else np.empty(0, bool)
        one = word_hashes(text, self.first, self.end) ^ marks[0][doc]
        two = word_hashes(text ^ np.uint8(0xA5), self.first, self.end) ^ marks[1][doc]
        self.hashes = A.mix(one), A.mix(two)

    def phrases(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, the two hashes) of every phrase of k words; the lowest two bits of the first hash are k - 1."""
        at = np.arange(len(self.first) - k + 1)
        for i in range(k - 1):
            at = at[self.next[at + i]] if len(at) else at
        return at, *self.key(at, k)

    def key(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for values in self.hashes:
            h = np.zeros(len(at), np.uint64)
            for i in range(k):
                h = h * A._M2 + values[at + i]
            out.append(A.mix(h))
        return (out[0] & ~_TAG) | np.uint64(k - 1), out[1]

    def texts(self, at: np.ndarray, k: int) -> pa.Array:
        """Words joined by single spaces."""
        word = (at[:, None] + np.arange(k)).ravel()
        size = self.end[word] - self.first[word] + 1
        ends = np.cumsum(size)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[word] - (ends - size), size)
        data = self.body[np.minimum(where, len(self.body) - 1)]
        data[ends - 1] = 32
        bounds = np.append(0, ends[k - 1 :: k])
        keep = np.ones(len(data), bool)
        keep[bounds[1:] - 1] = False
        offsets = bounds - np.arange(len(bounds))
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data[keep].tobytes())).cast(pa.string())


def _marks(langs: list[str]) -> np.ndarray:
    digests = [hashlib.blake2b(x.encode(), digest_size=16).digest() for x in langs]
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2).T


def _coded(langs: list[str]) -> tuple[list[str], np.ndarray]:
    names = sorted(set(langs))
    place = {x: i for i, x in enumerate(names)}
    return names, np.array([place[x] for x in langs], np.int64)


def _slices(batches, limit=SLICE_BYTES):
    """(Words, languages, language of each text) of some megabytes of text at a time, from columns text and lang."""
    held, size = [], 0

    def give():
        body, sizes, langs = (np.concatenate([h[i] for h in held]) for i in range(3))
        names, code = _coded(langs.tolist())
        ends = np.cumsum(sizes)
        return Words(body, ends - sizes, ends, _marks(names)[:, code]), names, code

    for batch in batches:
        body, sizes, _ = utf8_parts(column(batch, "text"))
        langs = np.array(batch.column("lang").to_pylist(), object)
        ends, at = np.cumsum(sizes), 0
        while at < len(sizes):
            begun = ends[at] - sizes[at]
            to = max(at + 1, int(np.searchsorted(ends, begun + limit - size, side="right")))
            held.append((body[begun : ends[to - 1]], sizes[at:to], langs[at:to]))
            size += int(ends[to - 1] - begun)
            at = to
            if size >= limit or at < len(sizes):
                yield give()
                held, size = [], 0
    if held:
        yield give()


def _distinct(a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None):
    """(sorted distinct pairs, first place of each, sum of ``n`` or their number)."""
    order = np.argsort(a, kind="stable")
    same = a[order][1:] == a[order][:-1]
    if (same & (b[order][1:] != b[order][:-1])).any():  # equal in one hash only
        order = np.lexsort((b, a))
        same = a[order][1:] == a[order][:-1]
    begin = np.flatnonzero(np.append(True, ~(same & (b[order][1:] == b[order][:-1])))) if len(a) else np.empty(0, np.int64)
    first = order[begin]
    count = np.diff(np.append(begin, len(a))) if n is None else np.add.reduceat(n[order], begin) if len(a) else n
    return a[first], b[first], first, count


def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    """Unsigned numbers in as few bytes each as the largest needs."""
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return width, np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(data: bytes, n: int, width: int, offset: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, offset).reshape(-1, width)
    return out.view(np.uint64).ravel()


def pack(a, b, n) -> bytes:
    """A message: sorted first hashes as gaps, second hashes, counts."""
    wa, gaps = _narrow(np.diff(a, prepend=a[:1]))
    wn, counts = _narrow(n)
    return np.array([len(a), wa, wn], np.int64).tobytes() + a[:1].tobytes() + gaps + b.tobytes() + counts


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, wa, wn = np.frombuffer(data, np.int64, 3).tolist()
    at = 32
    a = np.cumsum(_wide(data, n, wa, at), dtype=np.uint64) + np.frombuffer(data, np.uint64, 1, 24)
    at += n * wa
    b = np.frombuffer(data, np.uint64, n, at)
    return a, b, _wide(data, n, wn, at + 8 * n).astype(np.int64)


class BitMap:
    """A bit for every range of first hashes that holds a wanted one."""

    def __init__(self, bits: int):
        self.bits, self.data = bits, np.zeros(1 << max(0, bits - 3), np.uint8)

    @staticmethod
    def spots(a: np.ndarray, bits: int) -> np.ndarray:
        return (a >> np.uint64(64 - bits)).astype(np.int64)

    def has(self, a: np.ndarray) -> np.ndarray:
        at = self.spots(a, self.bits)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) != 0


def _tree_sum(arrays: list[np.ndarray]) -> np.ndarray:
    while len(arrays) > 1:
        arrays = [sum(arrays[i + 1 : i + 2], arrays[i]) for i in range(0, len(arrays), 2)]
    return arrays[0]


_SENT, _SENT_SQL = pa.schema([("shard", pa.int64()), ("data", pa.binary())]), "shard long, data binary"
_COUNTED = pa.schema([("shard", pa.int64()), ("n_frequent", pa.int64()), ("slots", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("counts", pa.binary())])
_COUNTED_SQL = "shard long, n_frequent long, slots binary, a binary, b binary, counts binary"


def _send(sizes, shards, filter_):
    """Messages about phrases of these sizes; with a filter only of those whose word pairs it has."""

    def run(batches):
        for words, _, _ in _slices(batches):
            keys = []
            if filter_ is not None:
                at, a, _ = words.phrases(2)
                pair = np.zeros(len(words.first) + 1, bool)
                pair[at] = filter_.value.has(a)
            for k in sizes:
                if filter_ is None:
                    keys.append(words.phrases(k)[1:])
                else:
                    here = np.flatnonzero(pair)
                    for i in range(1, k - 1):
                        here = here[pair[here + i]]
                    keys.append(words.key(here, k))
            a, b, _, n = _distinct(*(np.concatenate(x) for x in zip(*keys)))
            del keys, words
            shard, begin, end = by_shard(a, shards)
            yield rows_of(_SENT, [shard, [pack(a[i:j], b[i:j], n[i:j]) for i, j in zip(begin.tolist(), end.tolist())]])

    return run


def count_shard(said: list, least: int):
    """(perfect hash, candidates by slot, their counts) of a shard's messages."""
    total = sum(len(a) for a, _, _ in said)
    room = np.uint64((1 << max(10, total.bit_length())) - 1)
    bucket = np.zeros(int(room) + 1)
    for a, _, n in said:
        np.add.at(bucket, ((a >> np.uint64(2)) & room).astype(np.int64), n.astype(np.float64))  # exact: integers below 2^53
    kept = []
    for a, b, n in said:
        maybe = bucket[((a >> np.uint64(2)) & room).astype(np.int64)] >= least
        kept.append((a[maybe], b[maybe], n[maybe]))
    del bucket
    a, b, _, _ = _distinct(*(np.concatenate([m[i] for m in kept]) for i in range(2)))
    slots = PerfectHash.of(a, b)
    at = slots.slot(a, b)
    stored = np.zeros((2, len(a)), np.uint64)
    stored[0, at], stored[1, at] = a, b
    arrays = []
    for a, b, n in kept:
        at = slots.slot(a, b)
        known = (at >= 0) & (stored[0, at] == a) & (stored[1, at] == b)
        arrays.append(np.bincount(at[known], n[known], minlength=stored.shape[1]).astype(np.int64))
        if len(arrays) == 64:
            arrays = [_tree_sum(arrays)]
    return slots, stored, _tree_sum(arrays)


def _count(least):
    def run(table: pa.Table) -> pa.Table:
        slots, stored, counts = count_shard([unpack(x.as_py()) for x in table.column("data")], least)
        row = [table.column("shard")[0].as_py(), int((counts >= least).sum()), slots.pack(), stored[0].tobytes(), stored[1].tobytes(), counts.tobytes()]
        return pa.table([[x] for x in row], schema=_COUNTED)

    return run


def _bit_map(counted: DataFrame, least: int, sizes: tuple[int, ...]) -> BitMap:
    """Of the frequent phrases of these sizes; every shard sets the bits of its own range."""
    frequent = counted.agg(F.coalesce(F.sum("n_frequent"), F.lit(0))).first()[0]
    bits = min(MOST_BITS, max(16, (16 * frequent).bit_length()))

    def run(batches):
        schema = pa.schema([("at", pa.int64()), ("data", pa.binary())])
        for batch in batches:
            for a, n in zip(batch.column("a"), batch.column("counts")):
                a, n = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(n.as_py(), np.int64)
                spots = BitMap.spots(a[(n >= least) & np.isin(a & _TAG, np.array(sizes, np.uint64) - np.uint64(1))], bits)
                if len(spots):
                    low = int(spots.min()) >> 3
                    out = np.zeros((int(spots.max()) >> 3) - low + 1, np.uint8)
                    np.bitwise_or.at(out, (spots >> 3) - low, (1 << (spots & 7)).astype(np.uint8))
                    yield rows_of(schema, [[low], [out.tobytes()]])

    out = BitMap(bits)
    for r in counted.select("a", "counts").mapInArrow(run, "at long, data binary").toLocalIterator():  # together as long as the map
        part = np.frombuffer(r["data"], np.uint8)
        out.data[r["at"] : r["at"] + len(part)] |= part
    return out


_TEXTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def _texts(filter_):
    """Distinct (language, phrase) of each slice as far as the filter has them, and its words by language under a null phrase."""

    def run(batches):
        for words, langs, code in _slices(batches):
            n = np.bincount(code[words.doc], minlength=len(langs))
            yield rows_of(_TEXTS, [langs, [None] * len(langs), n])
            for k in (2, 3, 4):
                at, a, b = words.phrases(k)
                some = filter_.value.has(a)
                at, a, b = at[some], a[some], b[some]
                _, _, first, _ = _distinct(a, b)
                for i in range(0, len(first), 1 << 16):
                    here = at[first[i : i + (1 << 16)]]
                    yield rows_of(_TEXTS, [pa.array(langs).take(pa.array(code[words.doc[here]])), words.texts(here, k), pa.nulls(len(here), pa.int64())])

    return run


_ASKED = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("part", pa.string()), ("a", pa.int64()), ("b", pa.int64())])


def _ask(shards):
    def run(batches):
        for batch in batches:
            langs, phrases = column(batch, "lang"), column(batch, "part")
            body, sizes, _ = utf8_parts(phrases)
            ends = np.cumsum(sizes)
            names, code = _coded(langs.to_pylist())
            words = Words(body, ends - sizes, ends, _marks(names)[:, code])
            begin = np.searchsorted(words.doc, np.arange(len(sizes)))
            size = np.diff(np.append(begin, len(words.doc)))
            a, b = np.zeros((2, len(sizes)), np.uint64)
            for k in (1, 2, 3, 4):
                here = np.flatnonzero(size == k)
                a[here], b[here] = words.key(begin[here], k)
            yield rows_of(_ASKED, [A.shard_of(a, shards), langs, phrases, a.view(np.int64), b.view(np.int64)])

    return run


_KNOWN = pa.schema([("lang", pa.string()), ("part", pa.string()), ("f", pa.int64())])


def _tell(asked: pa.Table, counted: pa.Table) -> pa.Table:
    """Counts of the asked phrases, read at their slots; those that are no candidates have none."""
    a, b = (column(asked, c).to_numpy().view(np.uint64) for c in ("a", "b"))
    out = np.zeros(len(a), np.int64)
    for row in counted.to_pylist():
        stored, other, counts = np.frombuffer(row["a"], np.uint64), np.frombuffer(row["b"], np.uint64), np.frombuffer(row["counts"], np.int64)
        if len(stored):
            at = PerfectHash.unpack(row["slots"]).slot(a, b)
            known = (at >= 0) & (stored[at] == a) & (other[at] == b)
            out[known] = counts[at[known]]
    some = pa.array(out > 0)
    return pa.table([asked.column("lang"), asked.column("part"), pa.array(out)], schema=_KNOWN).filter(some)


def collocations(docs: DataFrame, least: int = 30, most: int = 2000, scale: int = 2_000_000, share: int = 80, slice_bytes: int = SLICE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``most`` collocations.

    A phrase of two to four words found ``least`` times or more counts a; its worst cut has l and r of the parts and the score scale * a / (l + r), floored.
    A phrase within a longer one that has ``share`` of a hundred of its occurrences goes.
    """
    spark = docs.sparkSession
    rows = picked(docs, text="string", lang="string").select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(12, -(-total // shard_bytes))

    def counted(sizes, filter_):
        sent = rows.mapInArrow(batchwise(_send(sizes, shards, filter_)), _SENT_SQL)
        return store(sent.repartition(shards, "shard").groupBy("shard").applyInArrow(groupwise(_count(least)), _COUNTED_SQL), "counted")

    short = counted((1, 2), None)
    pairs = _bit_map(short, least, (2,))
    long = counted((3, 4), spark.sparkContext.broadcast(pairs))
    both = short.unionByName(long)
    texts = store(rows.mapInArrow(batchwise(_texts(spark.sparkContext.broadcast(_bit_map(both, least, (2, 3, 4))))), "lang string, phrase string, n long"), "phrases")
    n = texts.where("phrase is null").groupBy("lang").agg(F.sum("n").alias("n"))
    phrases = texts.where("phrase is not null").select("lang", F.col("phrase").alias("part")).distinct()
    parts = phrases.unionByName(phrases.select("lang", F.explode(F.split("part", " ")).alias("part"))).distinct()
    asked = parts.mapInArrow(batchwise(_ask(shards)), "shard long, lang string, part string, a long, b long")
    known = store(asked.groupBy("shard").cogroup(both.groupBy("shard")).applyInArrow(_tell, "lang string, part string, f long").where(F.col("f") >= least), "known")
    discard(short)
    discard(long)
    words = F.split("part", " ")
    found = known.withColumn("words", words).where(F.size("words") > 1)
    piece = lambda i, k: F.array_join(F.slice("words", i, k), " ")
    size = F.size("words")
    cut = found.select("lang", "part", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.select("lang", "part", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("words", F.col("k") + 1, size - F.col("k")), " ").alias("tail"))
    side = lambda name, f: known.select("lang", F.col("part").alias(name), F.col("f").alias(f))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    scored = cut.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"])
    scored = scored.withColumn("score", F.expr(f"(cast(a as decimal(20,0)) * cast({scale} as decimal(10,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    worst = scored.groupBy("lang", "part").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x")).select("lang", "part", "x.*")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: piece(i, k))))
    longer = found.where(size > 2).select("lang", "f", F.explode(inner).alias("part")).groupBy("lang", "part").agg(F.max("f").alias("longer"))
    left = worst.join(longer, ["lang", "part"], "left").where(F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * share))
    best_first = [F.desc("score"), F.desc("a"), F.asc("part")]
    salt = F.pmod(F.xxhash64("part"), F.lit(SALTS))
    some = left.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best_first))).where(F.col("rank") <= most)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best_first))).where(F.col("rank") <= most)
    return top.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), F.col("part").alias("phrase"), "a", "l", "r", "n", "score")
