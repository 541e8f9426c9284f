"""Packing of tokenised documents into training windows by lexical retrieval.

1. Documents are tokenised, a closing id is added, and the ids are stored.  Document frequencies of all ids
   and the mean length come from all documents; a vocabulary bounds their number.
2. A document is routed by its heaviest term under these statistics, so documents about the same thing meet
   wherever they were stored.  A term that may be the heaviest of very many documents is dealt over several routes.
3. Stretches of about half a million tokens of neighbouring routes get a BM25 inverted index.  A window starts
   with the rest of the document cut by the window before, or else with the first unused document; the unused
   neighbours of that seed by all of its terms, best first, fill it, then unused documents in order.  What does not fit is cut
   and opens the next window, so windows are full; the last tokens of a stretch become windows of powers of two,
   which need no padding.

Defined cases: a null or empty text has only the closing id; documents longer than a window fill several;
equal scores go to the earlier document; null ``doc_id`` stays null; rows of equal ``doc_id`` are packed one by one; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import mix
from .bpe import byte_letters
from .common import batchwise, picked, rows_of, store

SHARD_TOKENS = 1 << 19  # of one inverted index
PART_TOKENS = 1 << 22  # of one task, and of one route
K1, B = 1.2, 0.75
RARE = 64  # a term in fewer documents routes no better than one in so many: few could follow it
CACHED = 400_000  # a worker remembers the last so many chunks and words, up to twice that

# How the vocabulary splits lower-cased text, for text below U+0180 where letters can be listed.
LATIN_WORDS = r"[a-zªµºß-öø-ſ]+|'(?:[stmd]|re|ve|ll)|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ſ0-9²³¹¼-¾]+"


class _Cache(dict):
    """Remembers what ``make`` gave for the last keys, up to twice ``CACHED``."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= CACHED:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class WordTokens:
    """Ids of whole texts by the tokenizers library, as bytes of integers of a kind; chunks between white space, and words in them, are looked up once."""

    def __init__(self, file: bytes, kind: str):
        from tokenizers import Tokenizer

        self.code = {"<u2": "H", "<u4": "I"}[kind]

        self.library = Tokenizer.from_str(file.decode())
        self.library.no_truncation()
        self.library.no_padding()
        tokenize = self.library.model.tokenize
        # anything else (other scripts, combining marks, odd white space, special tokens) goes to the library whole
        self.unusual = re.compile("[\x1c-\x1f\x85İƀ-\U0010ffff]").search
        letters = {b: c for c, b in byte_letters().items()}
        spelling = {b: c for b, c in letters.items() if chr(b) != c}

        def word(w: str) -> bytes:
            spelt = w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(spelling)
            return array(self.code, [t.id for t in tokenize(spelt)]).tobytes()

        find, words = re.compile(LATIN_WORDS).findall, _Cache(word)
        self.chunks = _Cache(lambda chunk: b"".join([words[w] for w in find(chunk)]))

    def ids(self, text: str) -> bytes:
        if "<|" in text or self.unusual(text):
            return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.chunks.__getitem__, text.lower().split()))  # no word goes over white space


class Statistics:
    """Document frequencies of all ids, number of documents and their mean length."""

    def __init__(self, frequency: np.ndarray, n_docs: int, n_tokens: int):
        self.n_docs, self.mean = n_docs, max(1.0, n_tokens / max(1, n_docs))
        self.idf = np.log1p((n_docs - frequency + 0.5) / (frequency + 0.5))
        common = np.maximum(frequency, RARE)
        self.routing = np.maximum(np.log1p(np.maximum(n_docs - common, 0) / (common + 0.5)), 1e-6)
        self.routes = np.maximum(1, np.ceil(frequency * self.mean / PART_TOKENS)).astype(np.int64)

    def norm(self, sizes: np.ndarray) -> np.ndarray:
        return K1 * (1 - B + B * sizes / self.mean)


def _joined(docs: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all documents, number of each one's)"""
    width = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(docs), kind), np.fromiter(map(len, docs), np.int64, len(docs)) // width


def _term_counts(ids: np.ndarray, sizes: np.ndarray):
    """(document, term, count) of each distinct term of each document."""
    half, wide = (16, np.uint32) if ids.dtype.itemsize == 2 and len(sizes) <= 1 << 16 else (32, np.uint64)
    key = ids.astype(wide) | np.repeat(np.arange(len(sizes), dtype=wide), sizes) << wide(half)
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    pair = key[first].astype(np.int64)
    return pair >> half, pair & ((1 << half) - 1), np.diff(np.append(first, len(key)))


def heaviest_terms(ids: np.ndarray, sizes: np.ndarray, known: Statistics) -> np.ndarray:
    """The term of greatest weight of each document (the smallest of equal ones)."""
    doc, term, count = _term_counts(ids, sizes)
    weight = known.routing[term] * count * (K1 + 1) / (count + known.norm(sizes)[doc])
    begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    best = np.flatnonzero(weight == np.repeat(np.maximum.reduceat(weight, begin), np.diff(np.append(begin, len(doc)))))
    _, first = np.unique(doc[best], return_index=True)
    return term[best[first]]


class Index:
    """BM25 inverted index of one stretch, with the statistics of all documents."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, known: Statistics):
        self.n = len(sizes)
        doc, term, count = _term_counts(ids, sizes)
        order = np.argsort(term, kind="stable")
        self.doc, posted = doc[order], term[order]
        begin = np.flatnonzero(np.append(True, posted[1:] != posted[:-1]))
        self.begin, self.size = begin, np.diff(np.append(begin, len(posted)))
        weight = known.idf[term] * count * (K1 + 1) / (count + known.norm(sizes)[doc])
        self.weight = weight[order]
        # the terms of each document, as places in the index
        self.mine = np.searchsorted(posted[begin], term)
        self.from_ = np.searchsorted(doc, np.arange(self.n + 1))
        # long posting lists also as rows over all documents: adding whole rows is faster than looking entries up
        long = np.flatnonzero(self.size > self.n // 8)
        self.row = np.full(len(begin), -1)
        self.row[long] = np.arange(len(long))
        self.rows = np.zeros((len(long), self.n))
        held = np.repeat(self.row, self.size)
        self.rows[held[held >= 0], self.doc[held >= 0]] = self.weight[held >= 0]

    def scores(self, doc: int) -> np.ndarray:
        at = self.mine[self.from_[doc] : self.from_[doc + 1]]
        row = self.row[at]
        whole = self.rows[row[row >= 0]].sum(axis=0)
        at = at[row < 0]
        size = self.size[at]
        entry = np.repeat(self.begin[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return whole + np.bincount(self.doc[entry], self.weight[entry], minlength=self.n)


def pack_shard(ids: np.ndarray, sizes: np.ndarray, window: int, known: Statistics) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a stretch's documents."""
    index = Index(ids, sizes, known)
    length = sizes.tolist()
    used = np.zeros(len(length), bool)
    left = sum(length)
    pieces, sequence, fresh = [], 0, 0
    cut: tuple[int, int] | None = None  # document and start of what is left of it
    while left:
        room = window if left >= window else 1 << (left.bit_length() - 1)
        left -= room
        offset = 0
        order, at = None, 0
        seed = -1
        while offset < room:
            if cut is not None:
                d, start = cut
            else:
                if seed >= 0 and order is None:
                    score = np.where(used, 0.0, index.scores(seed))
                    near = np.flatnonzero(score > 0)
                    order = near[np.argsort(-score[near], kind="stable")].tolist()
                while order is not None and at < len(order) and used[order[at]]:
                    at += 1
                if order is not None and at < len(order):
                    d = order[at]
                else:
                    while used[fresh]:
                        fresh += 1
                    d = fresh
                start, used[d] = 0, True
            if seed < 0:
                seed = d
            take = min(room - offset, length[d] - start)
            pieces.append((d, start, take, sequence, offset))
            offset += take
            cut = (d, start + take) if start + take < length[d] else None
        sequence += 1
    return pieces


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_PIECE_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_made: dict[str, WordTokens] = {}


def _tokens(docs: DataFrame, file, closing: int, kind: str) -> DataFrame:
    """Stored (doc_id, n, ids) of each row, and for each task a row without ids: n documents with the term ``doc_id``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        key = hashlib.sha256(file.value).hexdigest()
        if key not in _made:
            _made.clear()
            _made[key] = WordTokens(file.value, kind)
        tokens, end = _made[key], np.array([closing], kind).tobytes()
        frequency = np.zeros(0, np.int64)
        for batch in batches:
            said = [tokens.ids(t.as_py() or "") + end for t in batch.column("text")]
            if said:
                ids, sizes = _joined(said, kind)
                _, term, _ = _term_counts(ids, sizes)
                found = np.bincount(term)
                if len(found) > len(frequency):
                    frequency, found = found, frequency
                frequency[: len(found)] += found
                yield rows_of(schema, [batch.column("doc_id"), sizes, said])
        term = np.flatnonzero(frequency)
        yield rows_of(schema, [term, frequency[term], [None] * len(term)])

    return store(picked(docs, doc_id="long", text="string").mapInArrow(batchwise(run), "doc_id long, n long, ids binary"), "tokens", "lz4")


def _statistics(tokens: DataFrame, size: int) -> Statistics:
    n_docs, n_tokens = tokens.where("ids is not null").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    sums = tokens.where("ids is null").groupBy("doc_id").agg(F.sum("n").alias("n")).toPandas()  # a vocabulary's length at most
    frequency = np.zeros(size, np.int64)
    frequency[sums["doc_id"].to_numpy(np.int64)] = sums["n"]
    return Statistics(frequency, n_docs, n_tokens)


def _routed(tokens: DataFrame, known, kind: str) -> DataFrame:
    schema = pa.schema([("route", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 32  # of the stored table, so the same whenever a task is run again
        for batch in batches:
            if batch.num_rows:
                term = heaviest_terms(*_joined(batch.column("ids").to_pylist(), kind), known.value)
                share = mix(np.arange(row, row + len(term)).astype(np.uint64)) % known.value.routes[term].astype(np.uint64)
                row += len(term)
                yield rows_of(schema, [term << 32 | share.astype(np.int64), batch.column("doc_id"), batch.column("ids")])

    return tokens.where("ids is not null").select("doc_id", "ids").mapInArrow(batchwise(run), "route long, doc_id long, ids binary")


def pack_documents(docs: DataFrame, path: str, window: int = 4096, closing: int = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` if asked."""
    if window < 1 or window & (window - 1):
        raise ValueError("the window must be a power of two")
    from tokenizers import Tokenizer

    with open(path, "rb") as f:  # on the driver; a vocabulary is a file of a few MB whatever the input
        content = f.read()
    context = docs.sparkSession.sparkContext
    size = max(Tokenizer.from_str(content.decode()).get_vocab_size(), closing + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    tokens = _tokens(docs, context.broadcast(content), closing, kind)
    statistics = _statistics(tokens, size)
    known = context.broadcast(statistics)  # three numbers for each id of the vocabulary
    parts = max(1, -(-int(statistics.n_docs * statistics.mean) // PART_TOKENS))
    schema = pa.schema([*_PIECE, ("ids", pa.binary())]) if with_ids else _PIECE

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        names: list = []
        shard: list[bytes] = []
        held, width = 0, np.dtype(kind).itemsize

        def emit():
            nonlocal base, names, shard, held
            ids, sizes = _joined(shard, kind)
            d, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pack_shard(ids, sizes, window, known.value)))
            begin = (np.cumsum(sizes) - sizes)[d] + start
            whole = ids.astype("<u4").tobytes()
            cuts = [whole[4 * a : 4 * (a + n)] for a, n in zip(begin.tolist(), length.tolist())]
            columns = [pa.array([names[i] for i in d.tolist()], pa.int64()), start, length, list(map(zlib.crc32, cuts)), sizes[d], base + sequence, offset]
            base += int(sequence[-1]) + 1
            names, shard, held = [], [], 0
            return rows_of(schema, [*columns, cuts] if with_ids else columns)

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                names.append(doc_id)
                shard.append(ids)
                held += len(ids) // width
                if held >= SHARD_TOKENS:
                    yield emit()
        if shard:
            yield emit()

    ready = _routed(tokens, known, kind).repartition(parts, "route").sortWithinPartitions("route", "doc_id", F.xxhash64("ids"))
    return ready.select("doc_id", "ids").mapInArrow(batchwise(run), _PIECE_SQL + (", ids binary" if with_ids else ""))
