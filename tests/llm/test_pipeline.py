import pytest

import corpus_pipeline
from kinset.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, SF).collect(), docs.schema)
        assert after.columns == docs.columns, name
        ids = {r.doc_id for r in after.collect()}
        assert ids <= {r.doc_id for r in before.collect()} and ids, name
        before = after
    coded = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    assert len(coded) == before.count()
    assert sorted((r.doc_id, r.decoded) for r in coded) == sorted((r.doc_id, r.text) for r in before.collect())
    assert all(r.n_tokens == len(r.ids) for r in coded)


def test_near_duplicates_leave_one(spark, docs, corpus):
    kept = corpus_pipeline.ngram_jaccard(spark, docs, SF).collect()
    assert {40 <= r.doc_id < 66 for r in kept} == {True, False}
    texts = [r.text for r in kept if r.text]
    copies = [t for t in texts if texts.count(t) > 1]
    assert copies == [] and {r.doc_id for r in kept} >= {75, 76, 77, 81}


def test_texts_under_one_id_are_judged_alone(spark, docs):
    words = lambda x: " ".join(f"{x}{i}" for i in range(60))
    rows = [(5, words("a")), (5, words("b")), (9, words("a") + " x"), (8, words("c")), (8, "w " + words("b")), (4, words("a").upper()), (4, words("a")),
            (None, words("a")), (6, None), (6, ""), (6, ""), (7, "one"), (7, "one")]
    df = spark.createDataFrame([(i, t, "s", "en", 1, "k", 1) for i, t in rows], docs.schema).repartition(3)
    kept = sorted(((r.doc_id, (r.text or "-")[:2].lower()) for r in corpus_pipeline.ngram_jaccard(spark, df, SF).collect()), key=str)
    assert kept == sorted([(4, "a0"), (5, "b0"), (8, "c0"), (None, "a0"), (6, "-"), (6, "-"), (7, "on")], key=str)


@pytest.mark.parametrize("stage", ["ngram_jaccard", "suffix_array", "mixing", "sentencepiece"])
def test_edges(spark, docs, nothing, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    assert run(spark, nothing, SF).collect() == []
    if stage != "sentencepiece":
        assert run(spark, docs, SF).columns == docs.columns


def test_queries_are_named():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(SQL) <= set(QUERIES)
