"""Corpus pipeline over ``documents``: rules, language, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), is written as Parquet, and the next one reads that.  All but the last
return the columns of ``documents``.  No stage can be said in SQL as a whole (a forest, an EM fit, a packing),
so ORACLE_SQL is None; tests/llm/test_pipeline.py holds run() and every stage against plain versions.

Defined cases: documents with a null or empty text fail the rules; a null ``doc_id`` has no label, counts as later than all
others and stays null; rows of equal ``doc_id`` are documents of their own (near copies are told apart by components, not ids);
of rows that tie for the smallest id of a component the first stored one stays; other columns pass through whatever their names;
an empty table gives an empty result; very long texts are read whole in every stage.
"""

from __future__ import annotations

import public_tokenizers

from fusewright.llm.common import store
from fusewright.llm.jaccard_join import first_of_each
from fusewright.llm.langid import with_language
from fusewright.llm.packing import pack_documents
from fusewright.llm.quality_rules import accepted
from fusewright.llm.suffix_dedup import edited


def quality_rules(spark, docs, sf_dir):
    """Documents that break a rule or that the forest finds anomalous go."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_id(spark, docs, sf_dir):
    """Documents without a language that has two fifths of the words go."""
    return with_language(docs)


def ngram_jaccard(spark, docs, sf_dir):
    """One document of each group of near copies stays."""
    return first_of_each(docs)


def suffix_dedup(spark, docs, sf_dir):
    """50-byte strings that an earlier document has are cut out."""
    return edited(docs, window=50)


def packing(spark, docs, sf_dir):
    """Pieces of token sequences of 4096, with their ids."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, closing=2, with_ids=True)


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("n-gram Jaccard join", ngram_jaccard), ("suffix-array dedup", suffix_dedup), ("packing", packing)]

ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
