"""Quality rules with an isolation forest on their statistics.

Every whole text gets rule statistics; fixed rules reject first, and an isolation forest on the statistics' ratios,
on a logarithmic scale, finds documents that random splits isolate early.  Trees are grown on samples of 256 of
at most ``FIT_ROWS`` documents labelled good, and cut anywhere in the box that holds the ratios of all documents: what
lies where no good document lies is cut off by few splits and has a short path.  The threshold on the anomaly
score comes from all labelled rows: the one that rejects most rows of quality 0 among those which reject at
most 0.5 % of quality 1, and of equal ones the highest.

Defined cases: a null text has no words and fails the base rule; labels whose quality is null, or whose
document does not exist, do not count, and a label that is repeated counts once (a document with both labels counts for both);
without labels of both kinds among the documents that pass the base rule only that rule rejects; a null ``doc_id`` is kept as null and
has no label.  Rows of equal ``doc_id`` are judged one by one; an empty table gives an empty result; other columns are not read; very long texts
are measured whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import _M2, mix, sequence_grams
from .common import as_before, batchwise, column, discard, picked, rows_of, store, utf8_parts
from .words import doc_ranges, word_hashes, word_spans

TREES, SAMPLE, FIT_ROWS, SEED = 200, 256, 8192, 7
LEAST_RATIO = 0.001  # ratios below are about the same
BINS, GOOD_LOSS = 10_000, 0.005
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_digits", "n_marks"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _per_doc(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return total[ends] - total[starts]


def _duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def statistics(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Rule statistics of documents, given their byte ranges."""
    first, end = word_spans(body, starts[ends > starts])
    lo, hi = doc_ranges(first, starts, ends)
    hashes = word_hashes(body, first, end)
    doc = np.repeat(np.arange(len(starts)), hi - lo)
    own = mix(doc.astype(np.uint64) * _M2 + np.uint64(1))
    solid = ~_SPACE[body]
    grams = sequence_grams(hashes, 3)
    repeated = np.zeros(len(hashes), bool)
    if len(grams):
        inside = doc[: len(grams)] == doc[2:]  # windows within one document
        key = grams[inside] ^ own[: len(grams)][inside]
        order = np.argsort(key)
        same = np.zeros(len(key), bool)
        if len(key) > 1:
            equal = key[order][1:] == key[order][:-1]
            same[order[1:][equal]] = same[order[:-1][equal]] = True
        at = np.flatnonzero(inside)[same]
        for k in range(3):
            repeated[at + k] = True
    text = body.tobytes()
    return {
        "n_words": hi - lo,
        "word_chars": _per_doc(solid & ((body & 0xC0) != 0x80), starts, ends),
        "n_symbols": _per_doc(_SYMBOL[body], starts, ends),
        "n_dup_lines": np.array([_duplicate_lines(text[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], np.int64),
        "n_repeat_words": _per_doc(repeated, lo, hi),
        "n_lines": _per_doc(body == 0x0A, starts, ends) + (ends > starts),
        "n_upper": _per_doc((body >= 65) & (body <= 90), starts, ends),
        "n_digits": _per_doc((body >= 48) & (body <= 57), starts, ends),
        "n_marks": _per_doc((body > 32) & (body < 127) & ~((body >= 48) & (body <= 57)) & ~((body | 32) >= 97) | (body == 0x5F), starts, ends),
    }


#: What the forest looks at, as numerator and denominator of ratios.
RATIOS = [("n_symbols", "word_chars"), ("n_marks", "word_chars"), ("n_upper", "word_chars"), ("n_digits", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("word_chars", "n_words")]


def log_ratios(c: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([np.log(LEAST_RATIO + c[a] / np.maximum(c[b], 1)) for a, b in RATIOS], axis=1)


class IsolationForest:
    """Random axis splits in a box; a point that few splits isolate is anomalous.  Scores are 0 to 1."""

    def __init__(self, points: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size = min(sample, len(points))
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.size)))))
        nodes = 2 ** (self.depth + 1) - 1
        self.axis = np.full((trees, nodes), -1, np.int16)
        self.split, self.path = np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for t in range(trees):
            chosen = points[rng.choice(len(points), self.size, replace=False)] if len(points) else points
            work = [(0, 0, chosen, low, high)]
            while work:
                node, level, rows, lo, hi = work.pop()
                wide = np.flatnonzero(hi > lo) if len(rows) > 1 else []
                if level == self.depth or not len(wide):
                    self.path[t, node] = level + self.expected(len(rows))
                    continue
                a = rng.choice(wide)
                cut = rng.uniform(lo[a], hi[a])
                self.axis[t, node], self.split[t, node] = a, cut
                left, here = rows[:, a] <= cut, np.arange(len(lo)) == a
                work += [(2 * node + 1, level + 1, rows[left], lo, np.where(here, cut, hi)), (2 * node + 2, level + 1, rows[~left], np.where(here, cut, lo), hi)]

    @staticmethod
    def expected(n: int) -> float:
        """Mean path length of an unsuccessful search in a tree of n points."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def score(self, points: np.ndarray) -> np.ndarray:
        total = np.zeros(len(points))
        rows = np.arange(len(points))
        for axis, split, path in zip(self.axis, self.split, self.path):
            node = np.zeros(len(points), np.int64)
            for _ in range(self.depth):
                a = axis[node]
                down = 2 * node + 1 + (points[rows, np.maximum(a, 0)] > split[node])
                node = np.where(a < 0, node, down)
            total += path[node]
        return 2.0 ** (-total / (len(self.path) * max(self.expected(self.size), 1e-9)))


_STATS = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in COUNTS + MORE)])


def _stats_of(texts):
    """Statistics of texts, some megabytes at a time."""
    body, sizes, _ = utf8_parts(texts)
    ends, at, out = np.cumsum(sizes), 0, []
    while at < len(sizes):
        begun = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, begun + (1 << 20))))
        out.append(statistics(body[begun : ends[to - 1]], ends[at:to] - sizes[at:to] - begun, ends[at:to] - begun))
        at = to
    return {k: np.concatenate([o[k] for o in out]) for k in COUNTS + MORE} if out else {k: np.empty(0, np.int64) for k in COUNTS + MORE}


def _measure(batches):
    for batch in batches:
        c = _stats_of(column(batch, "text"))
        yield rows_of(_STATS, [batch.column("doc_id"), *(c[k] for k in COUNTS + MORE)])


def _base_failed(c):
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def rule_statistics(docs: DataFrame) -> DataFrame:
    plain = picked(docs, doc_id="long", text="string")
    return plain.mapInArrow(batchwise(_measure), "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS + MORE))


def fit(stats: DataFrame, labels: DataFrame) -> tuple[IsolationForest, float]:
    """Forest and threshold from statistics of all documents and (doc_id, quality) labels."""
    spark = stats.sparkSession
    passed = stats.where("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words")
    known = picked(labels, doc_id="long", quality="long").where("quality in (0, 1) and doc_id is not null").distinct()
    judged = passed.join(known, "doc_id")
    ratio = lambda a, b: F.log(LEAST_RATIO + F.col(a) / F.greatest(F.col(b), F.lit(1)))
    box = passed.agg(*(f(ratio(a, b)) for f in (F.min, F.max) for a, b in RATIOS)).first()
    good = judged.where("quality = 1").select("doc_id", *COUNTS, *MORE).distinct()
    n_good = good.count()
    share = min(1.0, FIT_ROWS / max(1, n_good))  # about FIT_ROWS of them reach the driver, whatever their number
    drawn = good.where(F.pmod(F.xxhash64(*good.columns), F.lit(1 << 30)) < int(share * (1 << 30))).sort(*good.columns).toPandas()
    low, high = (np.array([0.0 if x is None else x for x in part]) for part in (box[: len(RATIOS)], box[len(RATIOS) :]))
    forest = IsolationForest(log_ratios({k: drawn[k].to_numpy() for k in COUNTS + MORE}), low, high)
    shared = spark.sparkContext.broadcast(forest)

    def score(batches):
        for batch in batches:
            c = {k: batch.column(k).to_numpy() for k in COUNTS + MORE}
            where = np.minimum(BINS - 1, (shared.value.score(log_ratios(c)) * BINS).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(where)], names=["quality", "bin"])

    binned = judged.select("quality", *COUNTS, *MORE).mapInArrow(score, "quality long, bin long")
    hist = np.zeros((2, BINS + 1))
    for quality, b, n in binned.groupBy("quality", "bin").agg(F.count(F.lit(1))).collect():  # two rows a bin at most
        hist[quality, b] = n
    if not hist.sum(axis=1).all():
        return forest, 2.0
    above = hist[:, ::-1].cumsum(axis=1)[:, ::-1]  # rows in this bin or above
    allowed = np.flatnonzero(above[1] <= GOOD_LOSS * above[1, 0])
    best = allowed[above[0, allowed] == above[0, allowed].max()].max()
    return forest, float(best) / BINS if above[0, best] > 0 else 2.0


_VERDICT = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in COUNTS), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("anomaly", pa.float64())])


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly of each row."""
    stats = store(rule_statistics(docs), "statistics")
    forest, threshold = fit(stats, labels)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            c = {k: batch.column(k).to_numpy() for k in COUNTS + MORE}
            failed, score = _base_failed(c), shared.value.score(log_ratios(c))
            yield rows_of(_VERDICT, [batch.column("doc_id"), *(c[k] for k in COUNTS), failed, ~failed & (score < threshold), score])

    return stats.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, kept boolean, anomaly double")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules and the forest keep; all columns unchanged."""
    stats = store(rule_statistics(docs), "statistics")
    forest, threshold = fit(stats, labels)
    discard(stats)
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            c = _stats_of(batch.column(place))
            keep = ~_base_failed(c) & (shared.value.score(log_ratios(c)) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    flat = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return as_before(flat.mapInArrow(batchwise(run), flat.schema), docs)
