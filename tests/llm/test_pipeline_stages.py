"""The corpus pipeline, stage by stage, and the registered queries against DuckDB."""

import hashlib

import oracle
import public_tokenizers
import pytest
from test_documents import plain_near_classes, plain_repeats
from test_tokens import check_pieces, library_ids

import corpus_pipeline
from seatwise.llm.queries import ORACLES, QUERIES


def texts_of(docs):
    return dict(sorted((r["doc_id"], r["text"]) for r in docs.collect()))


def test_stages_against_plain_versions(spark, odd_docs, sf_dir):
    """Each stage's decisions on what the one before it kept; clean documents stay."""
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, docs: stages[name](spark, docs, sf_dir).cache()
    before = texts_of(odd_docs)
    docs = run("language_id", odd_docs)
    kept = texts_of(docs)
    letters = {k: t for k, t in before.items() if t and any(c.isalpha() for c in t)}
    assert kept.items() <= letters.items() and all(k in kept for k, t in letters.items() if len(t) > 300)
    docs = run("exact_dedup", docs)
    last = {t: k for k, t in kept.items()}
    assert texts_of(docs) == {k: t for t, k in last.items()}
    before, docs = texts_of(docs), run("near_dedup", docs)
    ids = list(before)
    first = {ids[k] for k in plain_near_classes(list(before.values()))}
    assert texts_of(docs) == {k: t for k, t in before.items() if k in first}
    before, docs = texts_of(docs), run("suffix_dedup", docs)
    after = texts_of(docs)
    for (k, text), (_, removed, _, sha) in zip(before.items(), plain_repeats(list(before.values()))):
        assert hashlib.sha256(after[k].encode()).hexdigest() == sha
        assert removed or after[k] == text
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    ids = library_ids(public_tokenizers.path("word_bpe_49k.json"), list(after.values()), 2)
    check_pieces(pieces, dict(zip(after, ids)), 4096)


def test_every_stage_on_odd_documents(spark, odd_docs, sf_dir):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == odd_docs.columns, name
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}


def test_stages_on_no_documents(spark, no_docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf_dir).count() == 0


def test_run(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.selectExpr("count(distinct doc_id) > 100").first()[0]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, name):
    assert oracle.compare(QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), ORACLES[name]) is None
