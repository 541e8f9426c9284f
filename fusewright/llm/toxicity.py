"""Toxicity: a subsequence string kernel support vector machine with Nyström landmarks.

The kernel compares words by their subsequences of three symbols: k(x, y) = sum over u of f_u(x) f_u(y) / (m(x) m(y)), where f_u(x)
adds ``DECAY`` to the power of the spanned length over all ways to find u in x within ``SPAN`` symbols, and m(x) is the root of the sum of
squared weights of all ways in a word as long as x (of x itself, if half of its symbols are repetitions).  Symbols left out between the three, such as marks put between the letters of an insult, cost decay only, and so
does a letter put in.  Words carry a boundary symbol at both ends; single letters in a row ("i d i o t") are one more word.

Labels mark whole documents, so a document is a bag of sentences and these of words, and it is toxic if one of its words is (the greatest
decision value counts).  Learning:

1. of a sample of ``FIT_ROWS`` labelled documents each distinct sentence has its documents' label, 0 if one of them has; words that are in toxic
   sentences significantly too often, and are the most telling word of ``LEAST_WITNESS`` toxic documents, are positive, words of other sentences negative;
2. landmarks are the most telling positive and negative words that are not much alike under the kernel; Nyström features are k(x, landmarks) K^(-1/2);
3. a linear machine with squared hinge loss is fitted on them, also on copies of the positive words with marks and letters put in; the
   negative words of the whole sample it is most wrong about are added and it is fitted again, ``ROUNDS`` times;
4. a logistic curve turns the greatest value of a document into its score, fitted on the sample's documents.

The decision value is linear in the f_u, so the machine is one table of weights of 64^3 subsequences (a MB, whatever the input), which tasks look up: scoring
a word costs no landmark.

Defined cases: a null or empty text, or one without a letter or digit, scores as a document without words: below every word's score; labels that are null,
or of no document, do not count, and of repeated labels of one document the toxic one counts; without labels of both kinds every score is 0; a null
``doc_id`` is not learnt from, but scored; rows of equal ``doc_id`` are scored one by one, and learnt from each; an empty table gives an empty result; other columns are not
read; words longer than ``LONGEST`` are read in overlapping windows, so very long texts are scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batchwise, column, picked, release, rows_of, store
from .words import word_hashes

DECAY, SPAN = 0.75, 6
LONGEST, STEP = 24, 12
FIT_ROWS = 32768
LANDMARKS, ALIKE, CANDIDATES, MOST_POSITIVE, MOST_NEGATIVE, HARD, ROUNDS = 512, 0.85, 2048, 1500, 4000, 1000, 4
LEAST_WITNESS = 2  # toxic documents that a positive word alone explains, or explains best
SIGNIFICANT = 8.0  # log-likelihood ratio of a word's counts
COST, SEED = 10000.0, 11
PART_CHARS = 1 << 20
BINS, REACH = 4096, 8.0  # of decision values from -REACH to REACH
NO_WORD = -REACH
SYMBOLS = 64
OFFSETS = [(i, d) for d in range(2, SPAN) for i in range(1, d)]  # second and third symbol after the first


def _tables():
    """(symbol, is letter or digit, is white space) of the code points of the basic plane."""
    symbol, solid, space = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
    for i in range(1 << 16):
        c = chr(i)
        solid[i], space[i] = c.isalnum(), c.isspace()
        symbol[i] = i - 96 if 97 <= i <= 122 else 27 + (i * 2654435761 >> 7) % 36 if solid[i] else 63
    return symbol, solid, space


_known: list = []


def tables():
    if not _known:
        _known.append(_tables())
    return _known[0]


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, first and end of each word in them, its text), in order of the texts."""
    symbol, solid, space = tables()
    low = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(low).encode("utf-32-le"), np.uint32)
    plane = np.where(points < 1 << 16, points, ord("x")).astype(np.int64)  # rarer ones count as letters
    ends = np.cumsum([len(t) + 1 for t in low])
    sym = symbol[plane]
    full = ~space[plane]
    begin = full.copy()
    begin[1:] &= ~full[:-1]
    run = np.cumsum(begin, dtype=np.int64)
    at = np.flatnonzero(solid[plane])
    if not len(at):
        z = np.empty(0, np.int64)
        return sym, z, z, z
    new = np.append(True, run[at][1:] != run[at][:-1])
    first = at[new]
    end = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] + 1
    doc = np.searchsorted(ends, first, side="right")
    # single letters in a row once more, as one word behind the others
    single = np.flatnonzero(end - first == 1)
    if len(single):
        fresh = np.append(True, (np.diff(single) != 1) | (doc[single][1:] != doc[single][:-1]))
        a = np.flatnonzero(fresh)
        b = np.append(a[1:], len(single))
        long = b - a > 2
        sym = np.concatenate([sym, sym[first[single]]])
        first = np.concatenate([first, len(points) + a[long]])
        end = np.concatenate([end, len(points) + b[long]])
        doc = np.concatenate([doc, doc[single][a[long]]])
    many = np.maximum(0, -(-(end - first - LONGEST) // STEP)) + 1
    if many.max() > 1:
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        first, end, doc = np.repeat(first, many) + k * STEP, np.repeat(end, many), np.repeat(doc, many)
        end = np.minimum(end, first + LONGEST)
    order = np.argsort(doc, kind="stable")
    return sym, first[order], end[order], doc[order]


def padded(sym: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of the words one after the other with boundaries, start of each, how many symbols follow each within its word)."""
    size = end - first + 2
    stop = np.cumsum(size)
    start = stop - size
    word = np.repeat(np.arange(len(size)), size)
    inner = np.arange(len(word)) - start[word]
    out = np.where((inner == 0) | (inner == size[word] - 1), 0, sym[np.minimum(np.maximum(first[word] + inner - 1, 0), len(sym) - 1)])
    return out.astype(np.int32), start, (size[word] - 1 - inner).astype(np.int8)


def measure(symbols: np.ndarray, follow: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """m of padded words: by their sizes, or exactly, by their own subsequences, where half of the symbols are repetitions."""
    total = sum(np.maximum(0, sizes - d) * DECAY ** (2 * (d + 1)) for _, d in OFFSETS)
    word = np.repeat(np.arange(len(sizes)), sizes)
    kinds = (np.bincount(word * SYMBOLS + symbols, minlength=len(sizes) * SYMBOLS).reshape(-1, SYMBOLS) > 0).sum(axis=1)
    some = np.flatnonzero(2 * kinds <= sizes)
    if len(some):
        place = np.full(len(sizes), -1)
        place[some] = np.arange(len(some))
        here = place[word] >= 0
        own, parts = place[word][here], list(_ways(symbols[here], follow[here]))
        key = np.concatenate([own[at] * SYMBOLS**3 + k for at, k, _ in parts])
        known, back = np.unique(key, return_inverse=True)
        ways = np.bincount(back, np.repeat([w for _, _, w in parts], [len(at) for at, _, _ in parts]))
        total[some] = np.bincount(known // SYMBOLS**3, ways**2, minlength=len(some))
    return np.sqrt(np.maximum(total, 1e-12))


def _ways(symbols: np.ndarray, follow: np.ndarray):
    """(place, subsequence, weight) of all ways, for each pair of offsets."""
    for i, d in OFFSETS:
        at = np.flatnonzero(follow[:-d] >= d) if len(symbols) > d else np.empty(0, np.int64)
        yield at, (symbols[at] * SYMBOLS + symbols[at + i]) * SYMBOLS + symbols[at + d], DECAY ** (d + 1)


def decision(table: np.ndarray, bias: float, sym: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Decision values of words under a table of weights."""
    if not len(first):
        return np.empty(0)
    symbols, start, follow = padded(sym, first, end)
    total = np.zeros(len(symbols), np.float32)
    n = len(symbols)
    for i, d in OFFSETS:
        key = (symbols[: n - d] << 12) + (symbols[i : n - d + i] << 6) + symbols[d:]
        total[: n - d] += np.where(follow[: n - d] >= d, table[key], np.float32(0)) * np.float32(DECAY ** (d + 1))
    return np.add.reduceat(total, start).astype(np.float64) / measure(symbols, follow, end - first + 2) + bias


def distinct(sym: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place of each distinct word, which of them each word is)."""
    _, place, back = np.unique(word_hashes(sym, first, end), return_index=True, return_inverse=True)
    return place, back


class Spelling:
    """Words as weighted subsequences over those of some landmark words."""

    def __init__(self, words: list[bytes]):
        self.rows, self.keys = self._raw(words)
        self.known = np.unique(self.keys)
        self.matrix = self._dense(self.rows, self.keys, self.weights, len(words))

    def _raw(self, words):
        sym = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        symbols, start, follow = padded(sym, ends - sizes, ends)
        word = np.repeat(np.arange(len(words)), sizes + 2)
        scale = 1 / measure(symbols, follow, sizes + 2)
        rows, keys, weights = [], [], []
        for at, key, weight in _ways(symbols, follow):
            rows.append(word[at])
            keys.append(key)
            weights.append(weight * scale[word[at]])
        self.weights = np.concatenate(weights)
        return np.concatenate(rows), np.concatenate(keys)

    def _dense(self, rows, keys, weights, n):
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        ok = self.known[at] == keys
        flat = np.bincount(rows[ok] * len(self.known) + at[ok], weights[ok], minlength=n * len(self.known))
        return flat.reshape(n, len(self.known))

    def kernel(self, words: list[bytes]) -> np.ndarray:
        """k(word, landmark)."""
        out = []
        for i in range(0, len(words), 512):
            part = words[i : i + 512]
            rows, keys = self._raw(part)
            out.append(self._dense(rows, keys, self.weights, len(part)) @ self.matrix.T)
        return np.concatenate(out) if out else np.empty((0, len(self.matrix)))


def _leaders(words: list[bytes], most: int) -> list[bytes]:
    """The first words, without those that are much like an earlier one."""
    same = Spelling(words).kernel(words)
    chosen: list[int] = []
    for i in range(len(words)):
        if len(chosen) < most and (not chosen or same[i, chosen].max() < ALIKE):
            chosen.append(i)
    return [words[i] for i in chosen]


def fit_machine(features: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights and bias (last) of the least squared hinge loss, by Newton steps over the rows that violate the margin."""
    x = np.column_stack([features, np.ones(len(features))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    loss = lambda v: 0.5 * v @ ridge @ v + 0.5 * (weight * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
    for _ in range(60):
        bad = y * (x @ w) < 1
        xb, cb = x[bad], weight[bad]
        target = np.linalg.solve(ridge + (xb * cb[:, None]).T @ xb, (xb * cb[:, None]).T @ y[bad])
        step, now = 1.0, loss(w)
        while step > 1e-4 and loss(w + step * (target - w)) > now:
            step /= 2
        moved = step * (target - w)
        w = w + moved
        if np.abs(moved).max() < 1e-7:
            break
    return w


def disguised(words: list[bytes], strength: list[float], rng) -> tuple[list[bytes], list[float]]:
    """Copies with a mark between all symbols, and with one symbol put in; each counts half as much."""
    out, weights = [], []
    for w, s in zip(words, strength):
        if 3 < len(w) <= LONGEST // 2:
            out.append(bytes([63]).join(w[i : i + 1] for i in range(len(w))))
            i = int(rng.integers(1, len(w)))
            out.append(w[:i] + bytes([int(rng.choice([63, int(rng.integers(1, 27))]))]) + w[i:])
            weights += [s / 2, s / 2]
    return out, weights


def train_machine(positive: list[bytes], strength: list[float], negative: list[bytes], common: list[float]) -> tuple[np.ndarray, float]:
    """(table of weights, bias).  strength, common: how much a word counts; first words become landmarks first."""
    rng = np.random.default_rng(SEED)
    more, weights = disguised(positive, strength, rng)
    marks = _leaders((positive + more)[:CANDIDATES], LANDMARKS // 2)
    marks += _leaders(negative[:CANDIDATES], LANDMARKS - len(marks))
    spelling = Spelling(marks)
    values, vectors = np.linalg.eigh(spelling.matrix @ spelling.matrix.T)
    some = values > 1e-6 * values.max()
    root = vectors[:, some] / np.sqrt(values[some])
    words = positive + more + negative
    n = len(positive) + len(more)
    y = np.repeat([1.0, -1.0], [n, len(negative)])
    up, down = np.array(strength + weights), np.array(common)
    w = fit_machine(spelling.kernel(words) @ root, y, COST * np.concatenate([up / up.sum(), down / down.sum()]))
    table = np.zeros(SYMBOLS**3)
    table[spelling.known] = (root @ w[:-1]) @ spelling.matrix
    return table.astype(np.float32), float(w[-1])


def _held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def _parts(batch: pa.RecordBatch):
    """(from, to, texts) of some of a batch's rows at a time."""
    texts, at = column(batch, "text"), 0
    sizes = [len(x) for x in (t.as_py() or "" for t in texts)]
    while at < len(sizes):
        to, size = at + 1, sizes[at]
        while to < len(sizes) and size + sizes[to] <= PART_CHARS:
            size += sizes[to]
            to += 1
        yield at, to, [t.as_py() or "" for t in texts.slice(at, to - at)]
        at = to


_SENTENCE = r"[.!?\n]+"
_COUNT = pa.schema([("word", pa.binary()), ("n_toxic", pa.int64()), ("n_other", pa.int64())])


def _count(batches):
    for batch in batches:
        labels = np.array(batch.column("toxic").to_pylist(), np.int64)
        for at, to, texts in _parts(batch):
            sym, first, end, doc = words_of(texts)
            place, back = distinct(sym, first, end)
            if len(place):
                pair = np.unique(back * (to - at) + doc)  # a word counts once a sentence
                word, toxic = pair // (to - at), labels[at:to][pair % (to - at)]
                n = np.bincount(word, minlength=len(place))
                bad = np.bincount(word, toxic, minlength=len(place)).astype(np.int64)
                raw = sym.tobytes()
                yield rows_of(_COUNT, [[raw[a:b] for a, b in zip(first[place].tolist(), end[place].tolist())], bad, n - bad])


def _greatest(texts: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """The greatest decision value of each text's words."""
    sym, first, end, doc = words_of(texts)
    out = np.full(len(texts), NO_WORD)
    if len(first):
        place, back = distinct(sym, first, end)
        value = np.maximum(decision(table, bias, sym, first[place], end[place])[back], NO_WORD)
        begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        out[doc[begin]] = np.maximum.reduceat(value, begin)
    return out


def platt(toxic: np.ndarray, other: np.ndarray, values: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of the logistic curve, from numbers of documents by value."""
    n1, n0 = toxic.sum(), other.sum()
    hi, lo = (n1 + 1) / (n1 + 2), 1 / (n0 + 2)  # targets that no curve can pass
    x, n = np.concatenate([values, values]), np.concatenate([toxic, other])
    t = np.concatenate([np.full(len(values), hi), np.full(len(values), lo)])
    x, n, t = x[n > 0], n[n > 0], t[n > 0]
    v = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])

    def loss(v):
        z = v[0] * x + v[1]
        return (n * (np.logaddexp(0, z) - t * z)).sum() + 0.5e-6 * v @ v

    for _ in range(100):
        z = v[0] * x + v[1]
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        d, c = n * (p - t), n * p * (1 - p)
        hess = np.array([[(c * x * x).sum(), (c * x).sum()], [(c * x).sum(), c.sum()]]) + 1e-6 * np.eye(2)
        way, step = np.linalg.solve(hess, np.array([(d * x).sum(), d.sum()]) + 1e-6 * v), 1.0
        while step > 1e-6 and loss(v - step * way) > loss(v):
            step /= 2
        v = v - step * way
        if np.abs(step * way).max() < 1e-9:
            break
    return float(v[0]), float(v[1])


class Model:
    """Table of weights, bias, logistic curve; ``table`` is None if there was nothing to learn from."""

    def __init__(self, table=None, bias=0.0, slope=1.0, intercept=0.0):
        self.table, self.bias, self.slope, self.intercept = table, bias, slope, intercept

    def score(self, texts: list[str]) -> np.ndarray:
        if self.table is None:
            return np.zeros(len(texts))
        z = self.slope * _greatest(texts, self.table, self.bias) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _witnesses(sample: DataFrame, words: list[bytes]) -> tuple[list[bytes], list[float]]:
    """(words, roots of their numbers of toxic documents): of several words that would explain a document, best first, only the first counts."""
    ends = np.cumsum([len(w) for w in words])
    hashes = word_hashes(np.frombuffer(b"".join(words), np.uint8), np.append(0, ends[:-1]), ends) if words else np.empty(0, np.uint64)
    order = np.argsort(hashes)
    shared = sample.sparkSession.sparkContext.broadcast((hashes[order], order))

    def run(batches):
        known, rank = shared.value
        for batch in batches:
            for _, _, texts in _parts(batch):
                sym, first, end, doc = words_of(texts)
                here = word_hashes(sym, first, end)
                at = np.minimum(np.searchsorted(known, here), len(known) - 1)
                hit = known[at] == here
                best = np.full(len(texts), len(rank))
                np.minimum.at(best, doc[hit], rank[at[hit]])
                which, n = np.unique(best[best < len(rank)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(n, pa.int64())], names=["rank", "n"])

    if not words:
        return [], []
    counted = sample.where("toxic = 1").mapInArrow(batchwise(run), "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_WITNESS)
    some = sorted((r["rank"], r["n"]) for r in counted.collect())  # MOST_POSITIVE rows at most
    return [words[i] for i, _ in some], [float(n) ** 0.5 for _, n in some]


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The model, from about ``fit_rows`` labelled documents that are not held out."""
    spark = docs.sparkSession
    known = picked(labels, doc_id="long", toxic="long").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~_held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, fit_rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))  # about fit_rows of them
    sample = store(picked(docs, doc_id="long", text="string").where(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id").select("text", "toxic"), "labelled")
    of_kind = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(of_kind) < 2:
        return Model()
    # copies repeat sentences: each counts once, and one that a document of label 0 has is no toxic one
    sentences = sample.select(F.explode(F.split("text", _SENTENCE)).alias("text"), "toxic").where(F.col("text") != "").groupBy("text").agg(F.min("toxic").alias("toxic"))
    counts = sentences.mapInArrow(batchwise(_count), "word binary, n_toxic long, n_other long").groupBy("word").agg(F.sum("n_toxic").alias("p"), F.sum("n_other").alias("q"))
    counts = store(counts, "words")
    n_p, n_q = counts.agg(F.sum("p"), F.sum("q")).first()
    if not n_p or not n_q:
        return Model()
    base, n = n_p / (n_p + n_q), F.col("p") + F.col("q")
    term = lambda c, rate: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * rate))).otherwise(0.0)
    ratio = F.when(F.col("p") > n * (1 + base) / 2, term("p", base) + term("q", 1 - base)).otherwise(0.0)
    counts = counts.withColumn("ratio", ratio)
    words = lambda df: {bytes(r["word"]): r["q"] ** 0.25 for r in df.select("word", "q").collect()}  # noqa: E731  of a bounded number of rows
    found = counts.where((F.col("ratio") >= SIGNIFICANT) & (F.length("word") > 2)).orderBy(F.desc("ratio"), "word").limit(MOST_POSITIVE).collect()
    positive, strength = _witnesses(sample, [bytes(r["word"]) for r in found])
    others = counts.where((F.col("q") > 0) & (F.col("ratio") < SIGNIFICANT))
    negative = words(others.orderBy(F.desc("q"), "word").limit(MOST_NEGATIVE // 4)) | words(others.orderBy(F.xxhash64("word"), "word").limit(MOST_NEGATIVE))
    if not positive or not negative:
        return Model()
    for k in range(ROUNDS + 1):
        table, bias = train_machine(positive, strength, list(negative), list(negative.values()))
        if k < ROUNDS:
            shared = spark.sparkContext.broadcast((table, bias))

            def value(batches):
                for batch in batches:
                    raw = batch.column(0).to_pylist()
                    sizes = np.array([len(w) for w in raw], np.int64)
                    ends = np.cumsum(sizes)
                    f = decision(*shared.value, np.frombuffer(b"".join(raw), np.uint8), ends - sizes, ends)  # noqa: B023
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(f)], names=["word", "q", "value"])

            # the worst first, so that they become landmarks
            negative = words(others.select("word", "q").mapInArrow(value, "word binary, q long, value double").orderBy(F.desc("value"), "word").limit(HARD)) | negative
    shared = spark.sparkContext.broadcast((table, bias))

    def bins(batches):
        for batch in batches:
            toxic = np.array(batch.column("toxic").to_pylist(), np.int64)
            for at, to, texts in _parts(batch):
                f = np.clip(_greatest(texts, *shared.value), -REACH, REACH)
                where = np.minimum(BINS - 1, ((f + REACH) * (BINS / (2 * REACH))).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(toxic[at:to]), pa.array(where)], names=["toxic", "bin"])

    hist = np.zeros((2, BINS))
    for r in sample.mapInArrow(batchwise(bins), "toxic long, bin long").groupBy("toxic", "bin").agg(F.count(F.lit(1)).alias("n")).collect():  # two rows a bin at most
        hist[r["toxic"], r["bin"]] = r["n"]
    slope, intercept = platt(hist[1], hist[0], (np.arange(BINS) + 0.5) * (2 * REACH / BINS) - REACH)
    return Model(table, bias, slope, intercept)


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fit_rows))

    def run(batches):
        for batch in batches:
            for at, to, texts in _parts(batch):
                score = shared.value.score(texts)
                part = batch.slice(at, to - at)
                yield rows_of(_OUT, [part.column("doc_id"), part.column("held_out"), score, (score >= threshold).astype(np.int32)])
                release()

    plain = picked(docs, doc_id="long", text="string").select("doc_id", _held_out().alias("held_out"), "text")
    return plain.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
