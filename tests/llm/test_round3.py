"""Toxicity, collocations and fill-in-the-middle against plain versions."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from fusewright.llm import collocations as C
from fusewright.llm import toxicity as X
from fusewright.llm.fill_middle import Rope, chances, fill_in_middle, restore, transform
from fusewright.llm.perfect import PerfectHash

COLUMNS = "doc_id long, text string, lang string, `Text.x` string, `a b` int"
LABELS = "doc_id long, quality int, toxic int, text string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1) for i, t, lang in rows], COLUMNS)


# --- collocations


def _brute(rows, least, most):
    out = []
    by_lang = {}
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        pieces = [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]
        by_lang.setdefault("und" if lang is None else lang, []).extend(pieces)
    for lang, pieces in by_lang.items():
        f, n = Counter(), sum(map(len, pieces))
        for p in pieces:
            for k in range(1, 5):
                f.update(tuple(p[i : i + k]) for i in range(len(p) - k + 1))
        inside = lambda w, v: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
        found = {w: a for w, a in f.items() if len(w) > 1 and a >= least}
        kept = []
        for w, a in found.items():
            if any(len(v) > len(w) and inside(w, v) and 100 * b >= 80 * a for v, b in found.items()):
                continue
            score, k = min((2_000_000 * a // (f[w[:k]] + f[w[k:]]), k) for k in range(1, len(w)))
            kept.append((-score, -a, " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        out += [(lang, i + 1, w.decode(), -a, left, right, n, -s) for i, (s, a, w, left, right) in enumerate(sorted(kept)[:most])]
    return sorted(out)


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(5)
    words = ["the", "New", "york", "city", "été", "a", "b", "ab", "I", "of", "x y", "z" * 40]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "! ", "\r\n", ";"]
    text = lambda: "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(60)))
    rows = [(i, text(), rng.choice(["en", "de", "und", None, "", "en\0"])) for i in range(120)]
    return rows + [(7, rows[3][1], "en"), (None, "new york city " * 50, "en"), (8, None, "en"), (9, "", None), (10, " .,", "fr"), (11, "ein wort", "one")]


@pytest.mark.parametrize("way", [{}, {"slice_bytes": 300, "shard_bytes": 200}, {"slice_bytes": 1, "shard_bytes": 50}], ids=str)
def test_collocations(spark, spoken, way):
    for least, most in ((3, 2000), (5, 6)):
        got = C.collocations(_docs(spark, spoken).repartition(3), least=least, most=most, **way).collect()
        assert sorted(map(tuple, got)) == _brute(spoken, least, most) and len(got) > 10


def test_collocations_edges(spark):
    assert C.collocations(_docs(spark, [])).count() == 0
    assert C.collocations(_docs(spark, [(None, None, None)] * 3)).count() == 0
    assert C.collocations(_docs(spark, [(1, "once only", "en")])).count() == 0
    long = "lorem ipsum dolor " * 400_000  # 7 MB in one text
    got = C.collocations(_docs(spark, [(1, long, "la")]), slice_bytes=1 << 20).collect()
    assert [(r.phrase, r.a, r.n) for r in got][:1] == [("dolor lorem ipsum dolor", 399_999, 1_200_000)]


def test_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 50_000):
        a, b = rng.integers(0, 1 << 63, (2, n)).astype(np.uint64)
        if n > 2:
            a[1] = a[0]  # equal in one of the hashes
        h = PerfectHash.unpack(PerfectHash.of(a, b).pack())
        assert sorted(h.slot(a, b).tolist()) == list(range(n))
        other = h.slot(*rng.integers(0, 1 << 63, (2, 100)).astype(np.uint64))
        assert (other < max(n, 1)).all() and (other >= -1).all()


def test_messages_and_distinct():
    a = np.array([5, 9, 5, 5, 9, 1 << 63], np.uint64)
    b = np.array([1, 2, 1, 3, 2, 0], np.uint64)
    x, y, first, n = C._distinct(a, b)
    assert list(zip(x.tolist(), y.tolist(), n.tolist())) == [(5, 1, 2), (5, 3, 1), (9, 2, 2), (1 << 63, 0, 1)]
    assert all((p == q).all() for p, q in zip(C.unpack(C.pack(x, y, n)), (x, y, n)))


# --- fill in the middle


def test_rope(monkeypatch):
    monkeypatch.setattr("fusewright.llm.fill_middle.LEAF", 3)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["é", "ab", "\n", "x\n", "𝄞"]) for _ in range(rng.randrange(40)))
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        rope = Rope.lines(text)
        assert (str(rope), rope.units, rope.points) == (text, len(lines), len(text))
        k, p = rng.randrange(len(lines) + 1), rng.randrange(len(text) + 1)
        a, b = rope.split(k)
        assert (str(a), str(b), a.units, b.units) == ("".join(lines[:k]), "".join(lines[k:]), k, len(lines) - k)
        a, b = rope.split(p, "points")
        assert (str(a), str(b)) == (text[:p], text[p:])


def _plain(text, doc_id):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(lines)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:i], lines[i:j], lines[j:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["<", "P", ">", "<S", "<M>" if rng.random() < 0.02 else "M>", "été ", "\n", "\r\n", "line\n"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(None, "a\nb\nc", None), (7, None, None), (7, "", None), (7, "no end", None), (8, "\n\n\n", None), (9, "long line é " * 500_000 + "\nend", None)]
    got = fill_in_middle(_docs(spark, rows).coalesce(1)).collect()
    want = [(i, *_plain(t or "", i), t or "") for i, t, _ in rows]
    assert [tuple(r) for r in got] == want and {r.form for r in got} == {"plain", "psm", "spm"}
    assert all(restore(r.output, r.form) == (t or "") for r, (_, t, _) in zip(got, rows))
    assert fill_in_middle(_docs(spark, [])).count() == 0 and fill_in_middle(_docs(spark, rows), rate=0).where("form <> 'plain'").count() == 0
    assert transform("a\nb", 1, spm=0)[1] == "psm" and transform("a\nb", 1, spm=100)[1] == "spm" and len(chances(1)) == 4


# --- toxicity


def _ways(word):
    """Weights of the subsequences of a padded word, by definition."""
    out = Counter()
    for i, j, k in itertools.combinations(range(len(word)), 3):
        if k - i < X.SPAN:
            out[word[i], word[j], word[k]] += X.DECAY ** (k - i + 1)
    return out


def _kernel(x, y):
    out = []
    for w in (x, y):
        w = bytes([0]) + w + bytes([0])
        ways = _ways(w)
        if 2 * len(set(w)) <= len(w):
            m = sum(v * v for v in ways.values()) ** 0.5
        else:
            m = sum(X.DECAY ** (2 * (k - i + 1)) for i, j, k in itertools.combinations(range(len(w)), 3) if k - i < X.SPAN) ** 0.5
        out.append((ways, m))
    (a, m), (b, n) = out
    return sum(v * b[u] for u, v in a.items()) / (m * n)


WORDS = [b"\x09\x04\x09\x0f\x14", b"\x01" * 9, b"\x01", b"\x01\x02", b"\x0d\x0f\x12\x0f\x0e", b"\x09\x3f\x04\x3f\x09\x3f\x0f\x3f\x14", bytes(range(1, 25)), b"\x01\x02\x01\x02\x01\x02"]


def test_kernel():
    got = X.Spelling(WORDS).kernel(WORDS)
    want = [[_kernel(x, y) for y in WORDS] for x in WORDS]
    assert np.allclose(got, want)
    table, bias = X.train_machine(WORDS[:2], [1.0, 2.0], WORDS[2:], [1.0] * 6)
    ends = np.cumsum([len(w) for w in WORDS])
    value = X.decision(table, bias, np.frombuffer(b"".join(WORDS), np.uint8), ends - [len(w) for w in WORDS], ends)
    # the table says what the expansion over the words says
    for w, v in zip(WORDS, value):
        ways = _ways(bytes([0]) + w + bytes([0]))
        m = _kernel(w, w)
        f = sum(n * table[(u[0] * 64 + u[1]) * 64 + u[2]] for u, n in ways.items())
        norm = (sum(n * n for n in ways.values()) / m) ** 0.5
        assert np.isclose(v, f / norm + bias, atol=1e-4)


def test_words():
    sym, first, end, doc = X.words_of(["An I-D, i d i o t! x", "", "…", "é" * 60, "a b", "İx y"])
    words = {}
    for a, b, d in zip(first.tolist(), end.tolist(), doc.tolist()):
        words.setdefault(d, []).append(sym[a:b].tobytes())
    low = lambda w: bytes(ord(c) - 96 if c.isalpha() else 63 for c in w)
    assert set(words[0]) == {low("an"), low("i-d"), low("i"), low("d"), low("o"), low("t"), low("idiot"), low("x"), low("idiotx")} - {low("idiot")}
    assert len(words[3]) == 4 and {len(w) for w in words[3]} == {24} and 1 not in words and 2 not in words and len(words[4]) == 2


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(8)
    clean = ["".join(rng.choice(["the", "ri", "on", "ta", "el", "mo", "sa", "id", "lo"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    bad = ["blorgface", "zuckwit", "dumpkopf"]

    def sentence(insult=None):
        words = [rng.choice(clean) for _ in range(8)]
        if insult:
            words.insert(rng.randrange(8), insult)
        return " ".join(words).capitalize() + ". "

    docs, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        docs.append((i, "".join(sentence() for _ in range(5)) + (sentence(rng.choice(bad)) if toxic else ""), None))
        labels.append((i, 1, int(toxic), None))
    extra = ["you " + w for w in ("b l o r g f a c e", "b-l-o-r-g-f-a-c-e", "zuckxwit", "BLORGFACE!", "dump.kopf")]
    docs += [(1000 + i, t, "en") for i, t in enumerate(extra)] + [(2000, "", None), (2001, None, None), (None, "blorgface", None), (2002, "the " * 30_000 + "zuckwit", None), (1, "clean " + docs[1][1], None)]
    labels += [(0, 1, 1, None), (5, None, None, None), (None, 1, 1, None), (99_999, 1, 1, None), (6, 1, 7, None)]
    return _docs(spark, docs), spark.createDataFrame(labels, LABELS)


def test_toxicity(judged):
    docs, labels = judged
    rows = X.toxicity(docs, labels).collect()
    assert len(rows) == 610 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 600]
    assert len(held) > 150 and sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.98 * len(held)
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[1000 + i].score >= 0.5 for i in range(5)) and sum(by_id[1000 + i].predicted for i in range(5)) >= 4
    assert by_id[2002].predicted == by_id[None].predicted == 1 and by_id[2000].score == by_id[2001].score < 0.1 and not by_id[None].held_out
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)


def test_toxicity_edges(spark, judged):
    docs, labels = judged
    assert X.toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in X.toxicity(docs.where("doc_id < 20"), labels.where("toxic = 0")).collect()} == {0.0}
    assert {r.score for r in X.toxicity(docs.where("doc_id < 20"), labels.limit(0)).collect()} == {0.0}
    assert [r.score for r in X.toxicity(_docs(spark, [(None, None, None)] * 2), labels).collect()] == [0.0, 0.0]
