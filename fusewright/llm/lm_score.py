"""Cross-entropy difference: every token under a target and a background bigram model of one vocabulary.

The background model counts all documents; the target model counts those labelled good (quality 1, not
toxic).  Both have the same order, vocabulary (every word of the corpus) and smoothing:
p(w) = (c(w) + 1) / (N + V) and p(w | v) = (c(v, w) + MU p(w)) / (c(v) + MU).  A document's score is the
mean over its tokens of the background's log-probability less the target's, so low scores are like the target.

Both models count all the text they have: the background is not cut down to the target's size, because what it
has gathered has to grow with the input.  A document is scored by models that did not count it: its own counts are taken off the
background's, and off the target's if it is labelled good, so labelled documents do not look good by construction.

Blocks of documents ask hash shards for the totals of their distinct words and word pairs (see ``exchange``), so
the model, which grows with the corpus, is never in one place.  Words and pairs are told apart by
hashes of 63 bits.

Defined cases: without words the entropies and the score are null; labels that are null, or of no document,
are ignored, and repeated labels of one document count once (good if any of them says so); a null
``doc_id`` is no target; rows of one ``doc_id`` are documents of their own, and all of them targets; without target
documents the target model is the uniform one; an empty table gives an empty result; other columns are not read; a very
long text is a block of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from .common import BLOCK_DOCS, NULL_ID, batchwise, id_column, let_go, open_blocks, pack_blocks, picked, rows_of, shard_count, squeeze, store, unsqueeze
from .exchange import FAN, NOTE, SENT_SQL, ask, by_block, by_shard, messages
from .words import doc_ranges, word_hashes, word_spans

MU = 2.0


def _grams(block):
    """(word hashes, pair hashes, pair is inside a document, first word and end of each document)."""
    starts, ends = word_spans(block.bytes, block.starts[block.sizes > 0])
    words = word_hashes(block.bytes, starts, ends) | np.uint64(1)  # odd: words; even: pairs
    lo, hi = doc_ranges(starts, block.starts, block.ends)
    pairs = A.sequence_grams(words, 2) & ~np.uint64(1)
    inside = np.ones(len(pairs), bool)
    cuts = lo[(lo > 0) & (lo < len(words))]
    inside[cuts - 1] = False
    return words, pairs, inside, lo, hi


def _distinct(block):
    """Sorted distinct hashes of the block, and the places of words and inside pairs among them."""
    words, pairs, inside, lo, hi = _grams(block)
    known, place = np.unique(np.concatenate([words, pairs[inside]]), return_inverse=True)
    return known, place[: len(words)], place[len(words) :], inside, lo, hi


def _planes(counts: np.ndarray) -> bytes:
    """Two rows of counts by byte planes, so that the empty high bytes vanish when compressed."""
    return squeeze(np.ascontiguousarray(counts.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes())


def _from_planes(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unsqueeze(data), np.uint8).reshape(8, -1).T).view("<i8").reshape(2, n)


class Counts:
    """Protocol: (sorted hashes, counts in background and target); what the others have is told, own counts taken off."""

    @staticmethod
    def pack(message):
        """Hashes as gaps in as few bytes as the largest gap needs, then the counts."""
        known, counts = message
        gaps = np.diff(known, prepend=np.uint64(0))
        width = max(1, -(-int(gaps[1:].max() if len(gaps) > 1 else 0).bit_length() // 8))
        body = np.ascontiguousarray(gaps[1:]).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        return np.array([len(known), width], np.int64).tobytes() + known[:1].tobytes() + body + _planes(counts)

    @staticmethod
    def unpack(data):
        n, width = np.frombuffer(data, np.int64, 2).tolist()
        gaps = np.zeros((n, 8), np.uint8)
        gaps[0] = np.frombuffer(data, np.uint8, 8, 16)
        gaps[1:, :width] = np.frombuffer(data, np.uint8, (n - 1) * width, 24).reshape(-1, width)
        known = np.cumsum(gaps.view(np.uint64).ravel(), dtype=np.uint64)
        return known, _from_planes(data[24 + (n - 1) * width :], n)

    @staticmethod
    def merge(said):
        known, place = np.unique(np.concatenate([m[0] for m in said]), return_inverse=True)
        total, places = np.zeros((2, len(known)), np.int64), np.split(place, np.cumsum([len(m[0]) for m in said])[:-1])
        for at, (_, counts) in zip(places, said):
            total[:, at] += counts  # the hashes of one message are distinct
        return (known, total), places

    @staticmethod
    def resolve(message):
        known, total = message
        words = (known & np.uint64(1)).astype(bool)
        return total, np.array([*total[:, words].sum(axis=1), words.sum()], np.int64).tobytes()  # N, N of the target, V

    @staticmethod
    def pick(total, places, message):
        return _planes(total[:, places] - message[1])  # most pairs are in one block only

    @staticmethod
    def read(data, message):
        return _from_planes(data, len(message[0])) + message[1]


def _own_counts(block, good):
    known, word, pair, inside, lo, hi = _distinct(block)
    weight = np.repeat(good, hi - lo)
    both = np.concatenate([word, pair])
    target = np.bincount(both, np.concatenate([weight, weight[:-1][inside] if len(inside) else weight[:0]]), minlength=len(known))
    return np.stack([np.bincount(both, minlength=len(known)), target.astype(np.int64)]), (known, word, pair, inside, lo, hi)


def _good(block, places):
    good = np.zeros(len(block), np.int64)
    good[places or []] = 1
    return good


def _send_counts(shards):
    def run(batches):
        for batch in batches:
            said = batch.column("good")
            for i, block in open_blocks(batch):
                counts, (known, *_) = _own_counts(block, _good(block, said[i].as_py()))
                yield messages(block.block_id, *by_shard(known, shards), lambda a, b: Counts.pack((known[a:b], counts[:, a:b])))  # noqa: B023

    return run


def _earlier(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each token how often its document has the same item."""
    key = doc * (int(place.max()) + 1 if len(place) else 1) + place
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[back]


_SCORE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("target_entropy", pa.float64()), ("background_entropy", pa.float64()), ("difference", pa.float64())])


def _score(shards, sums):
    def run(batches):
        n, n_target, v = sums
        for batch in batches:
            said, labelled = batch.column("said"), batch.column("good")
            for i, block in open_blocks(batch):
                good = _good(block, labelled[i].as_py())
                total, (known, word, pair, inside, lo, hi) = _own_counts(block, good)
                told = {x["shard"]: x["data"] for x in said[i].as_py() or ()}
                for s, a, b in zip(*(x.tolist() for x in by_shard(known, shards))):
                    total[:, a:b] += _from_planes(told[s], b - a)
                doc = np.repeat(np.arange(len(block)), hi - lo)
                length = (hi - lo)[doc]
                after = np.flatnonzero(inside) + 1
                own_word, own_pair = _earlier(doc, word), _earlier(doc[after], pair)
                # a word that ends its document starts no pair, but stands in front of none either: c(v) counts all of v
                entropy = []
                for k, size in ((1, n_target), (0, n)):
                    took = good[doc] if k else np.ones(len(doc), np.int64)
                    count = total[k, word] - took * own_word
                    single = (count + 1) / (size - took * length + v)
                    p = single.copy()
                    p[after] = (total[k, pair] - took[after] * own_pair + MU * single[after]) / (count[after - 1] + MU)
                    sums_ = np.append(0.0, np.cumsum(-np.log(p)))
                    entropy.append((sums_[hi] - sums_[lo]) / np.maximum(hi - lo, 1))
                none = hi == lo
                real = [pa.array(e, pa.float64(), mask=none) for e in (*entropy, entropy[0] - entropy[1])]
                yield rows_of(_SCORE, [id_column(block.ids), hi - lo, *real])

    return run


def _places(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64())])
    for batch in batches:
        for block_id, ids in zip(batch.column("block_id").to_pylist(), batch.column("ids").to_pylist()):
            ids = np.frombuffer(ids, np.int64)
            yield rows_of(schema, [ids, block_id * BLOCK_DOCS + np.arange(len(ids))])


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, fan: int = FAN) -> DataFrame:
    """doc_id, n_words, target_entropy, background_entropy and difference of each row."""
    blocks = pack_blocks(docs)
    n_blocks, shards = shard_count(blocks)
    target = picked(labels, doc_id="long", quality="long", toxic="long").where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").where(F.col("doc_id") != NULL_ID).distinct()
    rows = blocks.select("block_id", "ids").mapInArrow(_places, "doc_id long, row long").join(target, "doc_id", "left_semi")
    good = store(rows.groupBy(F.expr(f"row div {BLOCK_DOCS}").alias("block_id")).agg(F.collect_list(F.expr(f"row % {BLOCK_DOCS}")).alias("good")), "good")
    ready = blocks.join(good, "block_id", "left")
    answers = store(by_block(ask(ready.mapInArrow(batchwise(_send_counts(shards)), SENT_SQL), n_blocks, shards, Counts(), fan), "said"), "counts")
    sums = np.zeros(3, np.int64)
    for x in answers.where(F.col("block_id") == NOTE).select(F.explode("said.data").alias("d")).toLocalIterator():  # three numbers a shard
        sums += np.frombuffer(x[0], np.int64)
    let_go(docs.sparkSession)
    return ready.join(answers, "block_id", "left").mapInArrow(batchwise(_score(shards, sums.tolist())), "doc_id long, n_words long, target_entropy double, background_entropy double, difference double")
