"""Languages of documents as mixtures: proportions by expectation-maximisation over n-gram likelihoods.

Training counts byte trigrams of words (with a space on both sides, ASCII lower case), hashed into 2^16
bins, for each language over all training rows.  For a document every word has a likelihood in every
language; expectation-maximisation estimates the languages' proportions, and the set of languages is the
one of the best penalised likelihood among the most probable one, two, three and so on.

The model has 2^16 numbers for each language whatever the input, so it can go to the driver and be
broadcast; more than ``MOST_LANGUAGES`` languages are an error.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every text if there is
nothing to learn from; ties go to the language first in alphabetical order; rows whose lang or ``doc_id``
is null are not learnt from, but predicted; rows of equal ``doc_id`` are predicted one by one; very long texts are read
whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_before, batchwise, column, picked, rows_of, utf8_parts
from .words import lower_ascii, word_spans

BINS, SMOOTHING = 1 << 16, 0.1
FULL_ROUNDS, LESS_ROUNDS = 12, 6
MOST_LANGUAGES = 400  # a hundred MB of model
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = regex.compile(r"\p{L}")


def _trigrams(body: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of the trigram around every byte, first byte and end of every word)."""
    first, end = word_spans(body, starts)
    low = lower_ascii(body)
    left, right = np.append(np.uint8(32), low[:-1]), np.append(low[1:], np.uint8(32))
    left[first] = 32
    right[end - 1] = 32
    key = (left.astype(np.uint32) << np.uint32(16)) | (low.astype(np.uint32) << np.uint32(8)) | right
    return ((key * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), first, end


def _held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


_COUNT = pa.schema([("lang", pa.string()), ("bin", pa.int32()), ("n", pa.int64())])


def _count(batches):
    table: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = column(batch, "lang").dictionary_encode()
        codes = langs.indices.to_numpy(zero_copy_only=False)
        body, sizes, _ = utf8_parts(column(batch, "text"))
        ends = np.cumsum(sizes)
        for i, (lang, a, b) in enumerate(zip(codes.tolist(), (ends - sizes).tolist(), ends.tolist())):
            if a < b:
                part = body[a:b]
                bins, _, _ = _trigrams(part, np.zeros(1, np.int64))
                name = langs.dictionary[lang].as_py()
                counts = table.setdefault(name, np.zeros(BINS, np.int64))
                counts += np.bincount(bins[~_SPACE[part]], minlength=BINS)
    for lang, counts in table.items():
        some = np.flatnonzero(counts)
        yield rows_of(_COUNT, [[lang] * len(some), some.astype(np.int32), counts[some]])


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood of every bin in every language) from the rows that are not held out."""
    rows = picked(docs, doc_id="long", text="string", lang="string").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out())
    n_langs = rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if n_langs > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn: the model would not fit a broadcast")
    counted = rows.select("text", "lang").mapInArrow(batchwise(_count), "lang string, bin int, n long")
    sums = counted.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()  # BINS rows a language at most
    langs = sorted(sums["lang"].unique())
    counts = np.zeros((BINS, len(langs)))
    counts[sums["bin"], sums["lang"].map({name: k for k, name in enumerate(langs)})] = sums["n"]
    counts += SMOOTHING
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def mixtures(likelihood: np.ndarray, first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, chosen) by document and language.

    likelihood: words by languages, each row scaled to a maximum of 1; documents have ``counts`` words each
    from row ``first`` on, one at least.
    """
    m, k = len(first), likelihood.shape[1]
    doc = np.repeat(np.arange(m), counts)

    def fit(pi, rounds):
        for _ in range(rounds):
            part = likelihood * pi[doc]
            part /= part.sum(axis=1, keepdims=True) + 1e-30
            pi = np.add.reduceat(part, first, axis=0) / counts[:, None]
        return pi.astype(np.float32)

    def fitness(pi):
        return np.add.reduceat(np.log((likelihood * pi[doc]).sum(axis=1) + 1e-30), first)

    full = fit(np.full((m, k), 1 / k, np.float32), FULL_ROUNDS)
    place = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
    best, best_pi = np.full(m, -np.inf), np.zeros((m, k), np.float32)
    for size in range(1, k + 1):
        pi = np.where(place < size, full, 0)
        pi /= pi.sum(axis=1, keepdims=True)
        if 1 < size < k:
            pi = fit(pi, LESS_ROUNDS)
        value = fitness(pi) - 0.5 * (size - 1) * np.log(counts)
        better = value > best
        best[better], best_pi[better] = value[better], pi[better]
    return best_pi, best_pi > 0


def predict_block(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, langs: list[str], model: np.ndarray):
    """(predictions, scores, proportions) of a block's documents."""
    n = len(starts)
    pi = np.zeros((n, max(1, len(langs))), np.float32)
    bins, first, end = _trigrams(body, starts[ends > starts])
    if len(first) and langs:
        word = np.stack([np.add.reduceat(np.where(_SPACE[body], np.float32(0), model[bins, j]), first) for j in range(len(langs))], axis=1)
        word = np.exp(word - word.max(axis=1, keepdims=True))
        from_ = np.searchsorted(first, starts)
        counts = np.searchsorted(first, ends) - from_
        some = counts > 0
        pi[some], _ = mixtures(word, from_[some], counts[some])
    raw = body.tobytes()
    letters = np.array([bool(_LETTER.search(raw[a:b].decode())) for a, b in zip(starts.tolist(), ends.tolist())], bool)
    known = letters & (pi.sum(axis=1) > 0)
    top = pi.argmax(axis=1)
    pred = [langs[t] if ok else "und" for t, ok in zip(top.tolist(), known.tolist())]
    score = np.where(known, np.minimum(1.0, pi[np.arange(n), top].astype(np.float64)), 0.0)
    return pred, score, pi


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("proportions", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))])
PART_BYTES = 1 << 20


def _parts(sizes: np.ndarray):
    """Ranges of documents of about ``PART_BYTES`` each."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        begun = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, begun + PART_BYTES)))
        yield at, to, begun, ends[to - 1]
        at = to


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of that language) and proportions of the chosen set, for each row."""
    langs, model = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            body, sizes, _ = utf8_parts(column(batch, "text"))
            ends = np.cumsum(sizes)
            for at, to, a, b in _parts(sizes):
                pred, score, pi = predict_block(body[a:b], ends[at:to] - sizes[at:to] - a, ends[at:to] - a, langs, shared.value)
                shares = [[{"lang": langs[j], "share": float(x)} for j, x in enumerate(p) if x > 0] if q != "und" else [] for p, q in zip(pi, pred)]
                part = batch.slice(at, to - at)
                yield rows_of(_OUT, [part.column("doc_id"), part.column("held_out"), pred, score, shares])

    plain = picked(docs, doc_id="long", text="string").select("doc_id", _held_out().alias("held_out"), "text")
    return plain.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, proportions array<struct<lang:string,share:double>>")


def with_language(docs: DataFrame, least_share: float = 0.4) -> DataFrame:
    """The rows of ``docs`` that have a language with at least that share of the words; all columns unchanged."""
    langs, model = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            body, sizes, _ = utf8_parts(batch.column(place))
            ends = np.cumsum(sizes)
            for at, to, a, b in _parts(sizes):
                pred, score, _ = predict_block(body[a:b], ends[at:to] - sizes[at:to] - a, ends[at:to] - a, langs, shared.value)
                keep = [p != "und" and s >= least_share for p, s in zip(pred, score)]
                yield batch.slice(at, to - at).filter(pa.array(keep, pa.bool_()))

    flat = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return as_before(flat.mapInArrow(batchwise(run), flat.schema), docs)
