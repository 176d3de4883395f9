import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinset.llm import toxicity
from kinset.llm.toxicity import CUT, FitOptions, WordBuckets, fit, score, train

BAD = ["awful", "rotten", "nasty"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(1, 80))]
        toxic = rng.random() < 0.2
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(BAD) + rng.choice(["", "ing", "xo", "er"]))
        rows.append((i, " ".join(words), rng.choice(["en", "de", None]), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


def test_held_out_accuracy(spark, labelled):
    docs = labelled.drop("toxic").withColumn("cut", F.lit("x"))
    held = F.col("doc_id") % 4 == 2
    net = train(docs, labelled.select("doc_id", "toxic"), ~held)
    rows = score(docs, net).join(labelled.select("doc_id", "toxic"), "doc_id").where(held).collect()
    y, s = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    pairs = (s[y == 1][:, None] > s[y == 0][None]).mean()
    assert pairs > 0.97 and 0 <= s.min() and s.max() <= 1
    assert ((s >= CUT) == (y == 1)).mean() > 0.93
    assert all(r.rejected == (r.score >= r.cut) for r in rows)
    # The same rows give the same network, and the score does not read the language.
    again = score(docs.withColumn("lang", F.lit("fr")), train(docs, labelled.select("doc_id", "toxic"), ~held))
    assert {r.doc_id: r.score for r in again.where(held).collect()} == {r.doc_id: r.score for r in rows}


def test_edges(spark, labelled, docs, nothing):
    net = train(labelled.drop("toxic"), labelled.select("doc_id", "toxic"), options=FitOptions(rows=200, epochs=2))
    got = score(docs, net).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if not (r.text or "").strip()}
    assert len(empty) == 1
    assert score(nothing, net).collect() == []
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    assert all(abs(r.score) < 1e-9 for r in score(docs, train(docs, odd)).collect())
    kept = score(docs, net, accepted_only=True).collect()
    assert sorted(map(str, kept)) == sorted(str(r) for r in got if not r.rejected)
    clash = docs.withColumn("cut", F.lit("x")).withColumn("_t", F.lit(3)).withColumn("rejected", F.lit(1))
    assert sorted((str(r.doc_id), r.score, r._t) for r in score(clash, net).collect()) == sorted((str(r.doc_id), r.score, 3) for r in got)
    assert fit([], np.zeros(0), [], FitOptions()).cuts == {}


def test_cuts_come_from_all_labelled_rows(spark):
    """Classes that overlap, one in ten toxic: the fit sees a balanced sample, the cuts all rows."""
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        toxic, lang = rng.random() < 0.1, rng.choice(["en", "de"])
        words = [f"w{rng.randrange(30)}" for _ in range(12)]
        words += [x for x, p, q in (("awful", 0.8, 0.1), ("rotten", 0.7, 0.15), ("nasty", 0.6, 0.2), ("poor", 0.5, 0.25)) if rng.random() < (p if toxic else q)]
        rows.append((i, " ".join(words), lang, int(toxic)))
    both = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    allowed = F.col("doc_id") % 4 != 2
    net = train(both.drop("toxic"), both.select("doc_id", "toxic"), allowed, FitOptions(rows=300, epochs=4))
    got = score(both, net).where(allowed).collect()

    def f1(some, cut):
        y, hit = np.array([r.toxic for r in some]), np.array([r.score for r in some]) >= cut
        return 2 * (y & hit).sum() / (y.sum() + hit.sum())

    for some, cut in [(got, CUT), *[([r for r in got if r.lang == x], net.cuts[x]) for x in ("en", "de")]]:
        assert f1(some, cut) >= max(f1(some, r.score) for r in some[::3]) - 0.005


@pytest.mark.parametrize("buckets, kind", [(1 << 15, np.uint16), (1 << 16, np.int32)])
def test_sample_takes_few_bytes_in_the_driver(spark, labelled, monkeypatch, buckets, kind):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, *rest: seen.append(texts) or fit(texts, *rest))
    some = labelled.where("doc_id < 60")
    train(some.drop("toxic"), some.select("doc_id", "toxic"), options=FitOptions(epochs=1, buckets=buckets))
    rows = sorted(some.collect(), key=lambda r: str(r.doc_id))
    raw = [r.text.encode() for r in rows]
    ids, first = WordBuckets(buckets).of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(t) for t in raw]))
    assert len(seen[0]) == 60 and all(t.dtype == kind for t in seen[0])
    # Buckets go up to their number, so 1 << 16 of them need more than two bytes.
    assert (np.concatenate(seen[0]) == np.concatenate([ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)])).all()
