"""run() and its stages against plain versions, on empty tables and with columns of awkward names."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from fusewright.llm.bpe import decode_documents, encode_documents, round_trip  # noqa: E402
from fusewright.llm.jaccard_join import jaccard_components  # noqa: E402
from fusewright.llm.langid import identify  # noqa: E402
from fusewright.llm.lm_score import cross_entropy_difference  # noqa: E402
from fusewright.llm.packing import pack_documents  # noqa: E402
from fusewright.llm.phrase_dedup import remove_phrases  # noqa: E402
from fusewright.llm.quality_rules import judge  # noqa: E402
from fusewright.llm.suffix_dedup import remove_repeats  # noqa: E402
from fusewright.llm.vector_neardup import near_duplicates  # noqa: E402
from fusewright.llm.warc_fixity import audit, damaged, raw_records  # noqa: E402
from test_operators import _brute, _components  # noqa: E402

P = corpus_pipeline.public_tokenizers
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
WORDS, BYTES = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(4)
    bits = {"en": "the an of ing tion er th wh".split(), "de": "der ung ein sch keit und zu ä".split()}
    vocabulary = {k: ["".join(rng.choice(v, 3)) for _ in range(600)] for k, v in bits.items()}
    text = lambda n, lang="en": " ".join(rng.choice(vocabulary[lang], n))
    rows = [(k, text(60 + k, "de" if k % 3 == 0 else "en"), "de" if k % 3 == 0 else "en") for k in range(1, 60)]
    passage = text(25)
    rows += [(100 + k, f"{text(70)} {passage} {text(80)}", "en") for k in range(4)]
    rows += [(110, rows[5][1], "en"), (111, rows[5][1] + " more", "en"), (3, text(90), "en"), (None, text(80), None), (None, text(75), None), (120, text(20), "en"), (121, None, "en"), (122, "", None)]
    rows += [(130 + k, " ".join(w + "%%%" for w in text(80).split()), "en") for k in range(12)]
    docs = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    labels = [(k, 1, 0) for k in range(1, 50)] + [(130 + k, 0, 0) for k in range(8)] + [(None, 1, 0), (7, None, None), (999, 0, 0), (8, 1, 0)]
    return docs, labels


@pytest.fixture(scope="module")
def sf_dir(spark, corpus, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(corpus[0], COLUMNS).repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(corpus[1], LABELS).write.parquet(f"{base}/labels.parquet")
    return base


def test_run(spark, corpus, sf_dir):
    from tokenizers import Tokenizer

    rows = corpus[0]
    labels = spark.createDataFrame(corpus[1], LABELS)
    kept = {(r.doc_id, r.n_words) for r in judge(spark.createDataFrame(rows, COLUMNS), labels).where("kept").collect()}
    rows = [r for r in rows if (r[0], len((r[1] or "").split())) in kept]
    assert {k for k in range(130, 142)}.isdisjoint({r[0] for r in rows}) and len(rows) > 60  # junk goes, the rest stays but for the short ones
    # every text left is of one language; one document of each component, the one of the smallest id
    of = {}
    for i, n, c in _components([(k, *r[1:]) for k, r in enumerate(rows)]):  # by place: ids repeat
        of.setdefault(c, []).append(i)
    order = lambda k: (float("inf") if rows[k][0] is None else rows[k][0], k)
    rows = [rows[min(c, key=order)] for c in of.values()]
    cut = [(i, bytes(x for x, g in zip(r[1].encode(), gone) if not g).decode("utf-8", "ignore")) for r, (i, _, gone, _) in zip(rows, _brute(rows, lambda t: list(t.encode()), 50, bytes))]
    t = Tokenizer.from_file(WORDS)
    want = Counter((i, (*t.encode(x, add_special_tokens=False).ids, 2)) for i, x in cut)
    got, at = [], defaultdict(list)
    for p in corpus_pipeline.run(spark, sf_dir).orderBy("sequence_id", "offset").collect():
        assert p.ids_crc32 == zlib.crc32(p.ids)
        at[p.doc_id].append(np.frombuffer(p.ids, "<u4").tolist())
        if p.start + p.length == p.doc_tokens:
            got.append((p.doc_id, tuple(sum(at.pop(p.doc_id), []))))
    assert Counter(got) == want


AWKWARD = ["_null", "a.b", "null", "c0", "row", "block_id", "said", "Text", "`q`"]


def _awkward(df):
    wide = df
    for k, _ in enumerate(AWKWARD):
        wide = wide.withColumn(f"x{k}", F.lit(k).cast("long"))
    return wide.toDF(*df.columns, *AWKWARD)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, sf_dir, name, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain, wide = stage(spark, docs, sf_dir), stage(spark, _awkward(docs), sf_dir)
    empty = stage(spark, _awkward(docs).limit(0), sf_dir)
    assert plain.count() == wide.count() and empty.count() == 0
    if name != "packing":
        assert plain.columns == docs.columns and wide.columns == [*docs.columns, *AWKWARD] and empty.columns == wide.columns
        flat = wide.toDF(*(f"c{i}" for i in range(len(wide.columns)))).select(*(f"c{len(docs.columns) + k}" for k in range(len(AWKWARD))))
        assert [tuple(r) for r in flat.distinct().collect()] == [tuple(range(len(AWKWARD)))]
        assert sorted(map(repr, plain.select("doc_id", "text").collect())) == sorted(map(repr, wide.toDF(*(f"c{i}" for i in range(len(wide.columns)))).selectExpr("c0 doc_id", "c1 text").collect()))


OPERATORS = {
    "phrases": lambda d, s: remove_phrases(d), "suffix": lambda d, s: remove_repeats(d), "jaccard": lambda d, s: jaccard_components(d), "language": lambda d, s: identify(d), "packing": lambda d, s: pack_documents(d, WORDS),
    "bpe": lambda d, s: round_trip(d, BYTES), "rules": lambda d, s: judge(d, s.createDataFrame([(1, 1, 0)], LABELS)), "lm": lambda d, s: cross_entropy_difference(d, s.createDataFrame([(1, 1, 0)], LABELS)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_tables(spark, sf_dir, name):
    """Empty tables, tables of nulls alone, empty labels and awkward columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    run = lambda d: OPERATORS[name](d, spark)
    assert run(_awkward(docs).limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3, COLUMNS)
    assert run(nulls).count() == 3
    some = docs.where("doc_id < 20 or doc_id is null")
    rows = lambda d: sorted(map(repr, run(d).drop("sequence_id", "offset").collect()))
    if name == "packing":  # pieces depend on how documents meet; what they cover does not
        assert run(_awkward(some)).agg(F.sum("length")).first() == run(some).agg(F.sum("length")).first()
    else:
        assert rows(_awkward(some).coalesce(1)) == rows(some.coalesce(1))


def test_other_tables(spark):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, space string, node long")
    assert near_duplicates(vectors).count() == 0
    nulls = spark.createDataFrame([(None, None, None)] * 2, "vec_id long, embedding array<float>, label int")
    assert [(r.n_links, r.component_id) for r in near_duplicates(nulls).collect()] == [(0, None)] * 2
    pages = raw_records(spark.createDataFrame([], "page_id long, url string, html string, archive string"))
    assert audit(pages, damaged(pages)).count() == 0


def test_encode_and_decode(spark, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    rows = [(r[0], r[1]) for r in corpus[0]] + [(500, "é<|endoftext|> x  \n\n 12345 ☃ " * 30), (501, "a" * 5000)]
    encoded = encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), BYTES)
    want = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == want
    decoded = decode_documents(encoded, BYTES)
    assert Counter(map(tuple, decoded.collect())) == Counter((i, t.decode(list(ids), skip_special_tokens=False)) for (i, ids), n in want.items() for _ in range(n))


def test_rule_statistics(spark, corpus):
    """The base statistics by plain Python."""
    extra = [(900, "a#b $x\n\na a a a\na a a a\n \nq\nq\r\nq\xa0é ☃ %|<>&*"), (901, "x y z x y z x y z"), (902, "one\n" * 60), (903, "\n\n"), (904, "a b c " * 30)]
    rows = [(r[0], r[1]) for r in corpus[0]] + extra
    got = judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], LABELS)).collect()
    want = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), failed, not failed))
    assert sorted((tuple(r)[:8] for r in got), key=repr) == sorted(want, key=repr)


def test_forest_paths():
    """Scores by walking every tree from its root, one point at a time."""
    from fusewright.llm.quality_rules import IsolationForest

    rng = np.random.default_rng(1)
    points = rng.normal(0, 1, (300, 3))
    forest = IsolationForest(points, np.full(3, -8.0), np.full(3, 8.0), trees=40, sample=64)
    asked = np.concatenate([points[:20], [[7, 7, 7], [0, 0, -7.5]]])
    want = []
    for x in asked:
        total = 0.0
        for axis, split, path in zip(forest.axis, forest.split, forest.path):
            node = 0
            while axis[node] >= 0:
                node = 2 * node + (1 if x[axis[node]] <= split[node] else 2)
            total += path[node]
        want.append(2 ** (-total / 40 / IsolationForest.expected(64)))
    assert np.allclose(forest.score(asked), want) and max(want[:20]) < min(want[20:])


def test_language_mixture(spark, corpus):
    """Proportions by plain expectation-maximisation; languages of held-out documents."""
    from fusewright.llm.langid import FULL_ROUNDS, LESS_ROUNDS, mixtures

    got = identify(spark.createDataFrame(corpus[0], COLUMNS)).collect()
    lang = {(r[0]): r[2] for r in corpus[0] if r[0] is not None and r[0] != 3}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    judged = [(r.lang_pred, lang[r.doc_id]) for r in got if r.held_out and lang.get(r.doc_id) and r.lang_pred != "und"]
    assert len(judged) > 15 and all(a == b for a, b in judged)

    rng = np.random.default_rng(2)
    counts = np.array([5, 1, 9])
    likelihood = rng.random((15, 3)).astype(np.float32)
    first = np.cumsum(counts) - counts
    pi, _ = mixtures(likelihood, first, counts)
    for d in range(3):
        rows = likelihood[first[d] : first[d] + counts[d]].astype(float)

        def fit(p, rounds):
            for _ in range(rounds):
                part = rows * p  # noqa: B023
                p = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
            return p

        full = fit(np.full(3, 1 / 3), FULL_ROUNDS)
        best = None
        for size in (1, 2, 3):
            p = np.where(np.argsort(np.argsort(-full, kind="stable"), kind="stable") < size, full, 0)
            p = p / p.sum()
            p = fit(p, LESS_ROUNDS) if 1 < size < 3 else p
            value = np.log((rows * p).sum(axis=1)).sum() - 0.5 * (size - 1) * np.log(counts[d])
            if best is None or value > best[0]:
                best = (value, p)
        assert np.allclose(pi[d], best[1], atol=1e-4)
