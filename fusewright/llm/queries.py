"""One query per operator over its whole table, with production parameters, and the same in SQL where it can be said."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from .bpe import round_trip
from .collocations import collocations
from .fill_middle import fill_in_middle
from .jaccard_join import jaccard_components
from .langid import identify
from .lm_score import cross_entropy_difference
from .packing import pack_documents
from .phrase_dedup import remove_phrases
from .quality_rules import judge
from .suffix_dedup import remove_repeats
from .toxicity import toxicity
from .vector_neardup import near_duplicates
from .warc_fixity import audit, damaged, raw_records


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vector_neardup(spark, sf_dir):
    return near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_repeated_phrases(spark, sf_dir):
    return remove_phrases(_table(spark, sf_dir, "documents"), window=13, digest=True)


def op3_lm_score(spark, sf_dir):
    """Entropies to six decimals, so that sums in another order compare equal."""
    out = cross_entropy_difference(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", *(F.round(c, 6).alias(c) for c in ("target_entropy", "background_entropy", "difference")))


def op4_quality_rules(spark, sf_dir):
    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_warc_fixity(spark, sf_dir):
    """Audits a replica of the archives in which of 97 records one was changed, one lost and one added on purpose."""
    records = raw_records(_table(spark, sf_dir, "pages"))
    return audit(records, damaged(records, every=97))


def op6_suffix_dedup(spark, sf_dir):
    return remove_repeats(_table(spark, sf_dir, "documents"), window=50, digest=True)


def op7_retrieval_packing(spark, sf_dir):
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=4096, closing=2)


def op8_jaccard_join(spark, sf_dir):
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op9_language_mixture(spark, sf_dir):
    return identify(_table(spark, sf_dir, "documents"))


def op10_bpe(spark, sf_dir):
    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_toxicity(spark, sf_dir):
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op12_collocations(spark, sf_dir):
    return collocations(_table(spark, sf_dir, "documents"), least=30, most=2000, scale=2_000_000, share=80)


def op13_fill_middle(spark, sf_dir):
    out = fill_in_middle(_table(spark, sf_dir, "documents"), rate=100, spm=50, seed=7)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_vector_neardup, op2_repeated_phrases, op3_lm_score, op4_quality_rules, op5_warc_fixity, op6_suffix_dedup,
        op7_retrieval_packing, op8_jaccard_join, op9_language_mixture, op10_bpe, op11_toxicity, op12_collocations,
        op13_fill_middle,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_vector_neardup": r"""
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1),
        reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT reach.vec_id, l.b FROM reach JOIN l ON l.a = reach.other),
        c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1)
        SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op2_repeated_phrases": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        p AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 11, 1))) AS i FROM w),
        win AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win FROM p),
        gone AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY win) AS first FROM win) WHERE first < doc_id),
        covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM gone),
        cut AS (SELECT doc_id, list(i) AS gone FROM covered GROUP BY doc_id)
        SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
          sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
        FROM w LEFT JOIN cut USING (doc_id)""",
    "op3_lm_score": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL),
        t AS (SELECT doc_id, len(words) AS n, unnest(range(1, len(words) + 1)) AS i, words, CASE WHEN doc_id IN (SELECT doc_id FROM g) THEN 1 ELSE 0 END AS good FROM w WHERE len(words) > 0),
        tok AS (SELECT doc_id, n, i, good, words[i] AS v, CASE WHEN i > 1 THEN words[i - 1] END AS u FROM t),
        c1 AS (SELECT v, count(*) AS b, sum(good) AS t FROM tok GROUP BY v),
        c2 AS (SELECT u, v, count(*) AS b, sum(good) AS t FROM tok WHERE u IS NOT NULL GROUP BY u, v),
        o1 AS (SELECT doc_id, v, count(*) AS o FROM tok GROUP BY 1, 2), o2 AS (SELECT doc_id, u, v, count(*) AS o FROM tok WHERE u IS NOT NULL GROUP BY 1, 2, 3),
        s AS (SELECT count(*) AS b, sum(good) AS t, count(DISTINCT v) AS words FROM tok),
        p AS (SELECT tok.doc_id, tok.i, (c1.b - o1.o + 1)::DOUBLE / (s.b - n + s.words) AS pb, (c1.t - good * o1.o + 1)::DOUBLE / (s.t - good * n + s.words) AS pt,
          c2.b - o2.o AS pair_b, c2.t - good * o2.o AS pair_t, d1.b - q1.o AS before_b, d1.t - good * q1.o AS before_t
          FROM tok CROSS JOIN s JOIN c1 ON c1.v = tok.v JOIN o1 ON o1.doc_id = tok.doc_id AND o1.v = tok.v
          LEFT JOIN c2 ON c2.u = tok.u AND c2.v = tok.v LEFT JOIN o2 ON o2.doc_id = tok.doc_id AND o2.u = tok.u AND o2.v = tok.v
          LEFT JOIN c1 d1 ON d1.v = tok.u LEFT JOIN o1 q1 ON q1.doc_id = tok.doc_id AND q1.v = tok.u),
        e AS (SELECT doc_id, avg(-ln(CASE WHEN i = 1 THEN pt ELSE (pair_t + 2 * pt) / (before_t + 2) END)) AS et, avg(-ln(CASE WHEN i = 1 THEN pb ELSE (pair_b + 2 * pb) / (before_b + 2) END)) AS eb FROM p GROUP BY 1)
        SELECT doc_id, len(words)::BIGINT AS n_words, round(et, 6) AS target_entropy, round(eb, 6) AS background_entropy, round(et - eb, 6) AS difference FROM w LEFT JOIN e USING (doc_id)""",
    "op5_warc_fixity": r"""
        WITH b AS (SELECT page_id, coalesce(url, '') AS url, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS body FROM pages),
        r AS (SELECT page_id, url, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
          || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(body)::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM b),
        o AS (SELECT *, CASE WHEN page_id IS NULL THEN -1 - ('0x' || md5(url)[1:3])::BIGINT ELSE floor(page_id / 4096)::BIGINT END AS archive, coalesce(page_id, 0) % 97 AS k FROM r),
        t AS (SELECT archive, row_number() OVER w - 1 AS place, page_id, url, k, sum(strlen(record)) OVER w - strlen(record) AS record_offset, strlen(record) AS record_length, sha256(record) AS digest, record
          FROM o WINDOW w AS (PARTITION BY archive ORDER BY page_id NULLS FIRST, url, sha256(record) ROWS UNBOUNDED PRECEDING)),
        u AS (SELECT archive, page_id, url, k, CASE WHEN k = 5 THEN substr(record, 1, length(record) - 5) || '?' || substr(record, length(record) - 3, 4) ELSE record END AS record, false AS again FROM o WHERE k <> 6
          UNION ALL SELECT archive, page_id, url || '#again', k, record, true FROM o WHERE k = 7),
        v AS (SELECT archive, row_number() OVER w - 1 AS place, page_id, url, k, again, sum(strlen(record)) OVER w - strlen(record) AS record_offset, strlen(record) AS record_length, sha256(record) AS digest
          FROM u WINDOW w AS (PARTITION BY archive ORDER BY page_id NULLS FIRST, url, sha256(record) ROWS UNBOUNDED PRECEDING))
        SELECT t.archive, t.place::BIGINT AS place, t.page_id, t.record_offset::BIGINT AS record_offset, t.record_length::BIGINT AS record_length, t.digest AS digest_here, CASE WHEN k = 5 THEN
          sha256(substr(record, 1, length(record) - 5) || '?' || substr(record, length(record) - 3, 4)) END AS digest_there, CASE WHEN k = 5 THEN 'corrupt' ELSE 'missing' END AS status FROM t WHERE k IN (5, 6)
        UNION ALL SELECT archive, place::BIGINT, page_id, record_offset::BIGINT, record_length::BIGINT, NULL, digest, 'extra' FROM v WHERE again""",
    "op6_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS i FROM d),
        k AS MATERIALIZED (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM w),
        f AS (SELECT s, min(doc_id) AS first FROM k GROUP BY s HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT k.doc_id, i FROM k JOIN f USING (s) WHERE first < k.doc_id),
        runs AS (SELECT doc_id, i, sum(CASE WHEN i - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone)),
        spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run),
        parts AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
        cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN cut USING (doc_id)""",
    "op8_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        g AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
          GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (max(x.n) + max(y.n) - count(*))),
        reach AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT reach.doc_id, l.b FROM reach JOIN l ON l.a = reach.other)
        SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(other) FROM reach WHERE reach.doc_id = w.doc_id) AS component_id
        FROM w LEFT JOIN n USING (doc_id)""",
    "op12_collocations": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (SELECT lang, unnest(regexp_extract_all(text, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM d)),
        total AS (SELECT lang, sum(len(words))::BIGINT AS n FROM p GROUP BY lang),
        g AS (SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda k: list_transform(range(1, len(words) - k + 2), lambda i: words[i:i + k - 1])))) AS w FROM p WHERE len(words) > 0),
        f AS MATERIALIZED (SELECT lang, w, count(*) AS f FROM g GROUP BY lang, w HAVING count(*) >= 30),
        c AS (SELECT lang, w, f AS a FROM f WHERE len(w) > 1),
        cut AS (SELECT c.*, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score FROM (SELECT *, unnest(range(1, len(w))) AS k FROM c) c JOIN f x ON x.lang = c.lang AND x.w = c.w[1:k] JOIN f y ON y.lang = c.lang AND y.w = c.w[k + 1:]),
        worst AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
        parts AS (SELECT lang, a, unnest(flatten(list_transform(range(2, len(w)), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])))) AS w FROM c WHERE len(w) > 2),
        longer AS (SELECT lang, w, max(a) AS longer FROM parts GROUP BY lang, w),
        ranked AS (SELECT lang, array_to_string(w, ' ') AS phrase, a, l, r, score FROM worst LEFT JOIN longer USING (lang, w) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
        SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank FROM ranked) JOIN total USING (lang) WHERE rank <= 2000""",
    "op13_fill_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines, list_transform(range(0, 4), lambda i: ('0x' || h[8 * i + 1:8 * i + 8])::BIGINT) AS c FROM d),
        k AS (SELECT *, len(lines)::BIGINT AS n, least(c[1] % (len(lines) + 1), c[2] % (len(lines) + 1)) AS i, greatest(c[1] % (len(lines) + 1), c[2] % (len(lines) + 1)) AS j,
          CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN c[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
        p AS (SELECT *, array_to_string(lines[1:i], '') AS prefix, array_to_string(lines[i + 1:j], '') AS middle, array_to_string(lines[j + 1:], '') AS suffix FROM k)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
}
