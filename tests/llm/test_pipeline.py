"""The pipeline against brute force, stage by stage on its own input."""

import re

import corpus_pipeline
import pytest

from purselake.llm.common import staged


@pytest.fixture(scope="module")
def stages(spark):
    folder = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        result = staged(f(spark, docs, folder), name)
        out.append((name, docs, result))
        docs = result
    return out


def test_stages_and_columns(stages):
    assert [s[0] for s in stages] == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_decisions_take_effect(spark, stages):
    from test_dedup import brute, norm

    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    by = {name: ([r for r in a.collect()], [r for r in b.collect()]) for name, a, b in stages}
    before, after = by["toxicity"]
    kept, marked = {r.doc_id for r in after}, {r.doc_id: r.toxic for r in labels.collect()}
    assert kept < {r.doc_id for r in before}
    clean, toxic = ([r.doc_id for r in before if marked.get(r.doc_id) == y] for y in (0, 1))
    assert sum(d in kept for d in clean) >= 0.95 * len(clean) and sum(d in kept for d in toxic) <= 0.5 * len(toxic)
    before, after = by["exact_dedup"]
    first = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        first.setdefault(norm(r.text), r.doc_id)
    assert {r.doc_id for r in after} == set(first.values())
    before, after = by["near_dedup"]
    rows = sorted(before, key=lambda r: r.doc_id)
    _, classes = brute([r.text for r in rows])
    assert {r.doc_id for r in after} == {rows[c].doc_id for c in set(classes)}
    before, after = by["pii"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    assert not [r for r in after if re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9]", r.text)]
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = by["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, f in corpus_pipeline.STAGES:
            docs = staged(f(spark, docs, "/root/testdata/sf0.001"), name)
        docs.count()


def test_a_worker_keeps_one_stages_caches(spark, monkeypatch, word_file):
    """A worker goes from stage to stage; what an earlier one kept must not stay."""
    import gc

    from purselake.llm import common, jaccard_join, toxicity, wordbpe

    def readers():
        gc.collect()
        return sum(isinstance(x, (toxicity.Reader, wordbpe.WordEncoder)) for x in gc.get_objects())

    common.keep_nothing()
    before = readers()
    machine = toxicity.train(["you idiot there", "a fine day"] * 3, [1, 0] * 3)
    toxicity.score_texts(machine, "a", ["one two"])
    assert readers() == before + 1
    first = wordbpe.encoder(word_file)
    assert wordbpe.encoder(word_file) is first and readers() == before + 1
    del first
    toxicity.score_texts(machine, "b", ["one two"])
    assert readers() == before + 1
    list(jaccard_join.by_bucket(iter([]), None, []))
    assert readers() == before
