import hashlib
import re

import numpy as np
import pytest

from fusewright.llm import bwt
from fusewright.llm.bpe import round_trip
from fusewright.llm.jaccard_join import first_of_each, jaccard_components
from fusewright.llm.langid import identify, with_language
from fusewright.llm.lm_score import cross_entropy_difference
from fusewright.llm.packing import pack_documents
from fusewright.llm.phrase_dedup import remove_phrases
from fusewright.llm.quality_rules import accepted, judge
from fusewright.llm.suffix_dedup import edited, remove_repeats
from fusewright.llm.vector_neardup import near_duplicates
from fusewright.llm.warc_fixity import audit, damaged, raw_records, replica_root, warc_records

P = pytest.importorskip("public_tokenizers")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, block_id string, row long"
PASSAGE = " ".join(f"passage{i} été" for i in range(40))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    words = [f"w{i}ord" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words, n))
    long = text(6000)
    texts = [text(80), text(120) + " " + PASSAGE, PASSAGE + "\n" + text(90), long, long, "", None, "one two", "One TWO", "été " * 60, long + " more", " \t\n", "<|endoftext|> it's 12 x"]
    return [(i + 1, t, "en" if i % 2 else None, None, len(t or ""), "b", 7) for i, t in enumerate(texts)] + [(3, PASSAGE, None, "s", 1, None, None), (None, PASSAGE, "fr", "s", 1, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def _order(i):
    return float("inf") if i is None else i


def _brute(rows, units, window, join):
    first = {}
    for i, t, *_ in rows:
        u = units(t)
        for k in range(len(u) - window + 1):
            w = tuple(u[k : k + window])
            first[w] = min(first.get(w, float("inf")), _order(i))
    out = []
    for i, t, *_ in rows:
        u = units(t)
        gone = [False] * len(u)
        for k in range(len(u) - window + 1):
            if first[tuple(u[k : k + window])] < _order(i):
                gone[k : k + window] = [True] * window
        out.append((i, len(u), gone, hashlib.sha256(join([x for x, g in zip(u, gone) if not g])).hexdigest()))
    return out


# the plain way; every anchor hot, so that windows go one by one; blocks in teams, so that messages merge
WAYS = [{}, {"hot": 0}, {"fan": 3}, {"hot": 0, "fan": 2}]


def _spans(gone):
    return sum(g and not before for g, before in zip(gone, [False, *gone]))


@pytest.mark.parametrize("way", WAYS, ids=str)
def test_phrases(docs, rows, way):
    got = [tuple(r)[:4] for r in remove_phrases(docs.repartition(5), **way).collect()]
    want = _brute(rows, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or ""), 13, lambda w: " ".join(w).encode())
    assert sorted(got, key=repr) == sorted(((i, n, sum(gone), sha) for i, n, gone, sha in want), key=repr)


@pytest.mark.parametrize("way", WAYS, ids=str)
def test_suffix(docs, rows, way):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs.repartition(5), **way).collect()]
    want = _brute(rows, lambda t: list((t or "").encode()), 50, bytes)
    assert sorted(got, key=repr) == sorted(((i, n, sum(gone), _spans(gone), sha) for i, n, gone, sha in want), key=repr)


def test_edited(docs, rows):
    want = _brute(rows, lambda t: list((t or "").encode()), 50, bytes)
    left = {}
    for (i, t, *_), (_, _, gone, _) in zip(rows, want):
        left.setdefault(i, []).append(None if t is None else bytes(x for x, g in zip(t.encode(), gone) if not g).decode("utf-8", "ignore"))
    out = edited(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r.text)
        assert r.n_chars == (None if r.text is None else len(r.text)) and r.block_id in ("b", None)
    assert {k: sorted(map(repr, v)) for k, v in got.items()} == {k: sorted(map(repr, v)) for k, v in left.items()}


def test_common_prefixes():
    text = np.frombuffer(b"banana\xffbandana\xffananas\xff", np.uint8)
    order = bwt.bounded_suffix_order(text, 4)
    prefix = bwt.bounded_common_prefixes(text[order - 1], 4)
    pad = text.tobytes() + b"\xff" * 4
    for a, b, n in zip(order[:-1], order[1:], prefix[1:]):
        x, y = pad[a : a + 4], pad[b : b + 4]
        if b"\xff" not in x + y:
            assert n == next((i for i in range(4) if x[i] != y[i]), 4)


def test_components(spark):
    """A long path, a star, a cycle, and pairs, in shuffled numbers."""
    from fusewright.llm.common import components

    rng = np.random.default_rng(5)
    names = rng.permutation(400).tolist()
    groups = [names[:120], names[120:300], names[300:340], *([names[k], names[k + 1]] for k in range(340, 380, 2)), *([x] for x in names[380:])]
    links = list(zip(groups[0], groups[0][1:])) + [(groups[1][0], x) for x in groups[1][1:]] + list(zip(groups[2], [*groups[2][1:], groups[2][0]])) + [tuple(g) for g in groups[3:] if len(g) == 2] + [(names[0], names[0])]
    got = components(spark.createDataFrame([(x,) for x in names], "id long"), spark.createDataFrame(links, "a long, b long"))
    assert {tuple(r) for r in got.collect()} == {(x, min(g)) for g in groups for x in g}


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def _components(rows):
    sets = [_shingles(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), float("inf")), _order(i))
    return sorted(((i, len(s), None if least[find(k)] == float("inf") else least[find(k)]) for k, ((i, *_), s) in enumerate(zip(rows, sets))), key=repr)


@pytest.fixture(scope="module")
def near_rows(rows):
    """Chains of near copies, pairs at the very threshold and just below, and a crowd of different sizes around one phrase."""
    rng = np.random.default_rng(3)
    words = [f"t{i}" for i in range(3000)]
    out = [r[:2] for r in rows]
    for k in range(12):
        text = list(rng.choice(words, 60 + 40 * k))
        for step in range(4):
            out.append((1000 + 10 * k + step, " ".join(text)))
            for at in rng.integers(0, len(text), 1 + k // 3):
                text[at] = f"edit{k}{step}{at}"
    base = [f"b{i}" for i in range(94)]  # 90 shingles
    out += [(2000, " ".join(base)), (2001, " ".join(base[:76])), (2002, " ".join(base[:75]))]  # 72 and 71 of 90
    phrase = " ".join(f"p{i}" for i in range(30))
    out += [(3000 + k, phrase + " " + " ".join(rng.choice(words, 4 + 2 * k))) for k in range(60)]
    return out


@pytest.mark.parametrize("way", [{}, {"tokens": None}, {"meet": 4}, {"tokens": None, "meet": 7}], ids=str)
def test_jaccard(spark, near_rows, way):
    docs = spark.createDataFrame(near_rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in jaccard_components(docs, **way).collect()), key=repr) == _components(near_rows)


def test_rules(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (99, 0, 0)], "doc_id long, quality long, toxic long")
    got = judge(docs, labels)
    assert got.count() == docs.count() and not got.where("base_failed and kept").count()
    assert accepted(docs, labels).columns == docs.columns


def test_language(docs):
    got = identify(docs).collect()
    assert {r.lang_pred for r in got if r.doc_id in (6, 7, 12)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert with_language(docs).columns == docs.columns


def test_bpe(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, round_trip(docs, P.path("byte_bpe_50k.json")).collect()), key=repr) == sorted(want, key=repr)


def test_packing(docs):
    from collections import defaultdict

    pieces = pack_documents(docs, P.path("word_bpe_49k.json")).collect()
    windows = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append((p.offset, p.length))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 4096
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)


@pytest.mark.parametrize("fan", [1 << 16, 2])
def test_lm_score(spark, docs, rows, fan):
    from collections import Counter
    from math import isclose, log

    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, 1, None), (2, 0, 1), (5, 1, 1), (None, 1, 0)], "doc_id long, quality long, toxic long")
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    good = [i in (1, 4) for i, *_ in rows]
    count = lambda docs: (Counter(w for d in docs for w in d), Counter(p for d in docs for p in zip(d, d[1:])))
    models = [count([d for d, g in zip(words, good) if g]), count(words)]
    v = len(models[1][0])
    want = []
    for (i, *_), d, g in zip(rows, words, good):
        own, out = count([d]), []
        for k, (one, two) in enumerate(models):
            took = 1 if k or g else 0
            c1, c2 = one - own[0] if took else one, two - own[1] if took else two
            p = lambda w: (c1[w] + 1) / (c1.total() + v)  # noqa: B023, E731
            loss = [-log(p(w) if not j else (c2[d[j - 1], w] + 2 * p(w)) / (c1[d[j - 1]] + 2)) for j, w in enumerate(d)]
            out.append(sum(loss) / len(d) if d else None)
        want.append((i, len(d), *out))
    got = sorted(((r.doc_id, r.n_words, r.target_entropy, r.background_entropy) for r in cross_entropy_difference(docs.repartition(5), labels, fan=fan).collect()), key=repr)
    for a, b in zip(got, sorted(want, key=repr), strict=True):
        assert a[:2] == b[:2] and all(x is y is None or isclose(x, y, rel_tol=1e-9) for x, y in zip(a[2:], b[2:])), (a, b)


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    rows = [(i, (base + 0.05 * rng.standard_normal(16)).tolist(), 1) for i in range(30)] + [(100 + i, rng.standard_normal(16).tolist(), 1) for i in range(40)]
    rows += [(200, rows[0][1], 2), (201, rows[0][1], 1), (202, None, 1), (203, [0.0] * 16, 1), (204, [None] + [1.0] * 15, 1), (205, [float("nan")] * 16, 1), (206, rows[0][1], None), (207, [1.0], 1)]
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    ok = [r for r in rows if r[0] not in (202, 203, 204, 205, 206)]
    unit = {i: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for i, v, _ in ok}
    for i, v, label in ok:
        assert got[i].n_links == sum(1 for j, w, other in ok if j != i and other == label and len(w) == len(v) and unit[i] @ unit[j] >= 0.93)
    assert got[201].component_id == 0 and not got[201].kept and got[203].kept and len(got) == len(rows)


def test_warc(spark):
    rows = [(i, f"http://a/{i}", "<p>é</p>" * i) for i in range(120)] + [(None, None, None), (None, "http://n", "x"), (7, "http://b", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    records = raw_records(pages, archive_pages=20)
    laid = warc_records(pages, archive_pages=20).orderBy("archive", "place").collect()
    for x, y in zip(laid, laid[1:]):
        assert y.record_offset == (x.record_offset + len(x.record.encode()) if x.archive == y.archive else 0)
    assert audit(records, records).count() == 0 and replica_root(records) == replica_root(records.repartition(3))
    assert len({replica_root(records), replica_root(damaged(records)), replica_root(records.where("archive > 0")), None}) == 4
    assert replica_root(records.where("page_id = -5")) is None and audit(records.limit(0), records.limit(0)).count() == 0
    found = audit(records, damaged(records)).collect()
    lost = [(5, "corrupt"), (102, "corrupt"), (6, "missing"), (103, "missing"), (7, "extra"), (7, "extra"), (104, "extra")]
    assert sorted((r.page_id, r.status) for r in found) == sorted(lost)


@pytest.mark.parametrize("run", [remove_phrases, remove_repeats, jaccard_components, identify, lambda d: pack_documents(d, P.path("word_bpe_49k.json"))])
def test_empty(spark, run):
    assert run(spark.createDataFrame([], COLUMNS)).count() == 0


def test_first_of_each_keeps_every_component(spark):
    rng = np.random.default_rng(7)
    a, b, c, d, e = (" ".join(f"{k}{x}" for x in rng.integers(0, 500, 60)) for k in "abcde")
    rows = [(None, a), (None, b), (None, a), (3, c), (3, d), (3, d), (9, c), (2, e), (None, e), (2, e), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, None, None, 1, "b", k) for k, (i, t) in enumerate(rows)], COLUMNS).coalesce(1)
    kept = sorted(((r.doc_id, r.text) for r in first_of_each(docs).collect()), key=repr)
    assert kept == sorted([(None, a), (None, b), (3, c), (3, d), (2, e), (None, None), (None, "")], key=repr)


def test_packing_neighbours(spark):
    """Documents of one topic meet in windows though they come from different partitions; scores are BM25's over all documents."""
    from fusewright.llm.packing import B, K1, Index, Statistics

    rng = np.random.default_rng(8)
    topics = [[f"{a}{b}" for b in ("lex", "mor", "tan", "vid", "quo", "zer")] for a in ("al", "be", "cu", "do", "en", "fi", "gu", "ho")]
    common = [f"w{i}" for i in range(50)]
    rows = [(k, " ".join([*rng.choice(topics[k % 8], 40), *rng.choice(common, 60)])) for k in range(320)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    pieces = pack_documents(docs, P.path("word_bpe_49k.json"), window=2048).collect()
    topic_of = {}
    for p in pieces:
        topic_of.setdefault(p.sequence_id, []).append((p.doc_id % 8, p.length))
    same = sum(max(sum(n for t, n in w if t == k) for k in range(8)) for w in topic_of.values())
    assert same >= 0.8 * sum(p.length for p in pieces)

    ids = [rng.integers(0, 40, n) for n in (30, 50, 1, 80)]
    frequency = np.bincount(np.concatenate([np.unique(d) for d in ids]), minlength=40)
    known = Statistics(frequency, 4, 161)
    for d, mine in enumerate(ids):
        want = []
        for other in ids:
            tf = np.bincount(other, minlength=40)
            idf = np.log1p((4 - frequency + 0.5) / (frequency + 0.5))
            want.append(sum(idf[t] * tf[t] * (K1 + 1) / (tf[t] + K1 * (1 - B + B * len(other) / (161 / 4))) for t in set(mine.tolist())))
        assert np.allclose(Index(np.concatenate(ids).astype("<u2"), np.array([len(x) for x in ids]), known).scores(d), want)


def _pair(rng, cosine, size=32):
    a, b = rng.standard_normal((2, size))
    a /= np.linalg.norm(a)
    b -= a * (a @ b)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b)


def test_vectors_of_small_labels_beside_a_large_one(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(rng.standard_normal((1500, 32)))]
    rows += [(10000 + 2 * k + j, v.tolist(), 1 + k) for k in range(80) for j, v in enumerate(_pair(rng, 0.932))]
    # two tight groups, linked with one another, that fill each other's lists
    rows += [(20000 + 20 * j + i, (v + 0.002 * rng.standard_normal(32)).tolist(), 200) for j, v in enumerate(_pair(rng, 0.95)) for i in range(20)]
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [k for k in range(80) if got[10000 + 2 * k].n_links != 1 or got[10001 + 2 * k].component_id != 10000 + 2 * k] == []
    assert {(got[20000 + i].n_links, got[20000 + i].component_id) for i in range(40)} == {(39, 20000)}


@pytest.mark.parametrize("piece", [1024, 16])
def test_vectors_against_all_pairs(spark, piece, monkeypatch):
    """Dense groups longer than a list, chains, pairs on both sides of the threshold, copies; large and small labels.

    With small pieces all pairs of a group are counted piece by piece, and both labels go through NN-descent.
    """
    from fusewright.llm import vector_neardup

    monkeypatch.setattr(vector_neardup, "PIECE", piece)
    rng = np.random.default_rng(9)
    rows, at = [], iter(range(10**6))

    def put(v, label):
        rows.append((next(at), (v / np.linalg.norm(v)).tolist(), label))

    for label, n in ((0, 1300), (1, 200)):
        for v in rng.standard_normal((n, 24)):
            put(v, label)
        for size in (30, 60):
            base = rng.standard_normal(24)
            for _ in range(size):
                put(base + 0.03 * rng.standard_normal(24) * np.linalg.norm(base) / 5, label)
        for _ in range(5):  # a chain: only neighbours link
            a, b = np.linalg.qr(rng.standard_normal((24, 2)))[0].T
            for k in range(8):
                put(np.cos(0.3 * k) * a + np.sin(0.3 * k) * b, label)
        for cosine in (0.93 + 1e-9, 0.93 - 1e-9, 0.93 - 5e-13, 0.95):
            for _ in range(6):
                for v in _pair(rng, cosine, 24):
                    put(v, label)
        for _ in range(4):
            rows.append((next(at), rows[-1][1], label))
    x = np.array([v for _, v, _ in rows])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    label = np.array([r[2] for r in rows])
    s = x @ x.T
    close = (s >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(close, False)
    assert (np.abs(s - 0.93) > 1e-14).all()
    first = np.arange(len(rows))
    while True:
        new = np.minimum(first, np.where(close, first[None, :], len(rows)).min(axis=1))
        if (new == first).all():
            break
        first = new
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).orderBy("vec_id").collect()
    assert [r.n_links for r in got] == close.sum(axis=1).tolist() and [r.component_id for r in got] == first.tolist() and [r.kept for r in got] == (first == np.arange(len(rows))).tolist()


def test_vector_labels_that_fail_the_audit_are_whole(spark, monkeypatch):
    """Without trees and rounds that find anything, the audit sends each label to the exact way, small and larger than a piece."""
    from fusewright.llm import vector_neardup

    empty = lambda nodes, threshold: (spark.createDataFrame([], vector_neardup._NEAR_SQL), vector_neardup._unproven(nodes, spark.createDataFrame([], vector_neardup._NEAR_SQL), threshold))
    monkeypatch.setattr(vector_neardup, "_searched", empty)
    monkeypatch.setattr(vector_neardup, "PIECE", 200)
    rng = np.random.default_rng(12)
    rows = [(1000 * label + i, v.tolist(), label) for label, n in ((0, 300), (1, 150), (2, 20)) for i, v in enumerate(rng.standard_normal((n, 24)))]
    rows += [(1000 * label + 500 + 2 * k + j, v.tolist(), label) for label in (0, 1, 2) for k in range(15) for j, v in enumerate(_pair(rng, 0.94, 24))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (1, i - i % 2) if i % 1000 >= 500 else (0, i) for i, *_ in rows}


@pytest.mark.parametrize("found, open_spaces", [("all", set()), ("hot", {"a"}), ("none", {"a"})])
def test_vector_audit_sees_missing_links(spark, found, open_spaces):
    from fusewright.llm.vector_neardup import LIST, _unproven

    rng = np.random.default_rng(6)
    base = rng.standard_normal(32)
    hot = [(i, base + 0.01 * rng.standard_normal(32)) for i in range(60)]
    sparse = [(1000 + 2 * k + j, v) for k in range(20) for j, v in enumerate(_pair(rng, 0.95))]
    rows = [] if found == "none" else hot + sparse
    rows += [(5000 + i, v) for i, v in enumerate(rng.standard_normal((30, 32)))]
    nodes = spark.createDataFrame([(i, "a", v.tobytes(), len(rows)) for i, v in rows], "node long, space string, vec binary, total long")
    near = [(i, [(-0.99, j % 60) for j in range(i + 1, i + 1 + LIST)]) for i, _ in hot] if found != "none" else []
    near += [(i, [(-0.95, i ^ 1)]) for i, _ in sparse] if found == "all" else []
    graph = spark.createDataFrame(near, "node long, near array<struct<less:double,other:long>>")
    assert {r.space for r in _unproven(nodes, graph, 0.93).collect()} == open_spaces


def test_warc_lost_and_added_records(spark):
    page = lambda i: (i, f"http://a/{i}", f"<p>{i}</p>" * (i % 9))
    same = [page(i) for i in range(120) if i not in (6, 7, 10, 40, 103, 104)] + [(None, None, None), (20, "http://a/20", "x"), (20, "http://a/20", "y")]
    make = lambda rows: raw_records(spark.createDataFrame(rows, "page_id long, url string, html string"))
    mine, other = make(same + [page(10), (8, "http://b", None), (30, "http://c", "z"), (30, "http://c", "z")]), make(same + [page(40), (30, "http://c", "z")])
    found = sorted((r.page_id, r.status) for r in audit(mine, damaged(other)).collect())
    assert found == [(5, "corrupt"), (8, "missing"), (10, "missing"), (30, "missing"), (40, "extra"), (102, "corrupt")]
    assert [r.status for r in audit(mine, mine.where("page_id < 0")).collect()] == ["missing"] * mine.count()


def test_packing_ids(docs, rows):
    import zlib
    from collections import Counter, defaultdict

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces, got, at = pack_documents(docs, P.path("word_bpe_49k.json"), with_ids=True).orderBy("sequence_id", "offset").collect(), [], defaultdict(list)
    for p in pieces:  # a document's pieces follow one another
        assert p.start == sum(map(len, at[p.doc_id])) and p.ids_crc32 == zlib.crc32(p.ids)
        at[p.doc_id].append(np.frombuffer(p.ids, "<u4").tolist())
        if p.start + p.length == p.doc_tokens:
            got.append((p.doc_id, tuple(sum(at.pop(p.doc_id), []))))
    assert not at and Counter(got) == Counter((i, (*t.encode(text or "", add_special_tokens=False).ids, 2)) for i, text, *_ in rows)
