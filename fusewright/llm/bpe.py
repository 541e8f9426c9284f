"""Byte-level BPE by dynamic programming over prefixes, and its decoding.

For each prefix of a piece exactly one vocabulary token can come last in its encoding.  An automaton
lists the tokens that end at a position; of these, the one that is compatible with the last token of the
prefix before it is stored.  Following the stored tokens from the end gives the ids, in linear time and
without a merge queue.

Two tokens are compatible if merging the bytes of both together gives back just these two: no token on
the right edge of the first one's merge tree and token on the left edge of the second one's can merge before
either is absorbed into its own parent.

Defined cases: a null or empty text has no ids; special tokens that a text spells out get their own id;
pieces may be of any length, and a very long text is coded piece by piece; a null ``doc_id`` stays null; rows of equal
``doc_id`` or text are coded one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, picked, rows_of

# How byte-level vocabularies split text and spell bytes.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for text below U+02B0, where the classes can be listed; several times faster.
LATIN_PIECES = r" ?[A-Za-zªµºÀ-ÖØ-öø-ʯ]+| ?[0-9²³¹¼-¾]+|'(?:[stmd]|re|ve|ll)| ?[^\sA-Za-zªµºÀ-ÖØ-öø-ʯ0-9²³¹¼-¾]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

CACHED_PIECES = 200_000  # a worker remembers the last so many, up to twice that, so its memory is bounded


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file."""
    other = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(other)}


class PrefixBPE:
    """Encoder and decoder of one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        spell = lambda s: bytes(letters[c] for c in s)
        self.bytes_of = {i: spell(s) for s, i in vocab.items() if s not in self.special} | {i: s.encode() for s, i in self.special.items()}
        self.rank, self.halves = {}, {}
        for r, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.rank.setdefault(a << 32 | b, r)
            self.halves.setdefault(whole, (a, b, r))
        single = {vocab[c] for c in letters if c in vocab}
        self.ending = ahocorasick.Automaton()
        for i in single | set(self.halves):
            self.ending.add_word(self.bytes_of[i].decode("latin-1"), (i, len(self.bytes_of[i])))
        self.ending.make_automaton()
        self.edges: tuple[dict, dict] = ({}, {})
        self.pieces, self.latin, self.beyond = regex.compile(PIECES), re.compile(LATIN_PIECES), re.compile("[\x1c-\x1f\u02b0-\U0010ffff]")
        self.digits = {i: str(i) for i in self.bytes_of}
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fits: dict[int, bool] = {}
        self.cache: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens down one edge of a merge tree, each with the rank of the merge that absorbs it."""
        out, absorbed = [(token, float("inf"))], None
        while token in self.halves:
            absorbed = self.halves[token][2]
            token = self.halves[token][side]
            out.append((token, absorbed))
        return out

    def compatible(self, a: int, b: int) -> bool:
        left, right = self.edges[1].get(a), self.edges[0].get(b)
        left = left or self.edges[1].setdefault(a, self._edge(a, 1))
        right = right or self.edges[0].setdefault(b, self._edge(b, 0))
        rank = self.rank.get
        for x, x_until in left:
            x <<= 32
            for y, y_until in right:
                r = rank(x | y)
                if r is not None and r < x_until and r <= y_until:  # merges of one rank go from left to right
                    return False
        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        size = len(piece)
        last, width = [0] + [-1] * size, [0] * (size + 1)  # by length of the prefix
        fits, done = self.fits, 0
        for end, (token, n) in self.ending.iter(piece.decode("latin-1")):
            end += 1
            if end == done:
                continue  # the one token that can come last is known
            before = last[end - n]
            if before < 0:
                continue
            if end != n:
                pair = before << 32 | token
                ok = fits.get(pair)
                if ok is None:
                    ok = self.compatible(before, token)
                    if len(fits) > 5 * CACHED_PIECES:
                        fits.clear()
                    fits[pair] = ok
                if not ok:
                    continue
            last[end], width[end], done = token, n, end
        ids = []
        while size:
            if not width[size]:
                raise ValueError("the vocabulary lacks a byte")
            ids.append(last[size])
            size -= width[size]
        ids.reverse()
        return ids

    def known(self, piece: str):
        """(number of ids, decimal ids, decoded bytes) of a piece; those used lately are remembered."""
        found = self.older.get(piece)
        if found is None:
            ids = self.encode_piece(piece.encode())
            found = (len(ids), ",".join([self.digits[i] for i in ids]), b"".join([self.bytes_of[i] for i in ids]))
        if len(self.cache) >= CACHED_PIECES:
            self.older = dict(self.cache)
            self.cache.clear()
        self.cache[piece] = found
        return found

    def split(self, text: str) -> list[str]:
        return (self.pieces if self.beyond.search(text) else self.latin).findall(text)

    def parts(self, text: str) -> list[tuple[int, str, bytes]]:
        get, known = self.cache.get, self.known
        if not self.splitter or not any(s in text for s in self.special):
            return [get(p) or known(p) for p in self.split(text)]
        out = []
        for k, span in enumerate(self.splitter.split(text)):
            out += [(1, str(self.special[span]), span.encode())] if k % 2 else [get(p) or known(p) for p in self.split(span)]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.parts(text) for i in p[1].split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_made: dict[str, PrefixBPE] = {}


def _coder(file) -> PrefixBPE:
    """One coder in each worker for each file."""
    key = hashlib.sha256(file.value).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = PrefixBPE(file.value)
    return _made[key]


def _vocabulary(docs: DataFrame, path: str):
    with open(path, "rb") as f:  # on the driver; a vocabulary is a file of a few MB whatever the input
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _plain(docs: DataFrame) -> DataFrame:
    return picked(docs, doc_id="long", text="string")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of each row."""
    file = _vocabulary(docs, path)

    def run(batches):
        coder = _coder(file)
        for batch in batches:
            ids = [coder.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _plain(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of each row of (doc_id, ids)."""
    file = _vocabulary(encoded, path)

    def run(batches):
        coder = _coder(file)
        for batch in batches:
            texts = [coder.decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return picked(encoded, doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, text string")


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: every row encoded and decoded again, in one pass."""
    file = _vocabulary(docs, path)

    def run(batches):
        coder = _coder(file)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in column(batch, "text"):
                parts = coder.parts(text.as_py() or "")
                counts.append(sum([p[0] for p in parts]))
                ids.append(hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([p[2] for p in parts]).decode("utf-8", "replace").encode()).hexdigest())
            yield rows_of(_DIGEST, [batch.column("doc_id"), counts, ids, decoded])

    return _plain(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
