import hashlib

import numpy as np

from kinset.llm.phrases import PhraseParser, edited_fingerprints, fingerprints, from_text, likeness, likeness_of


def phrases(text):
    known, out, at = set(), [], 0
    for i in range(1, len(text) + 1):
        if text[at:i] not in known:
            known.add(text[at:i])
            out.append(text[at:i])
            at = i
    return out + ([text[at:]] if at < len(text) else [])


def test_phrases_and_shared_beginnings(corpus):
    parser = PhraseParser(size=10**6)
    for _, text in corpus:
        text = text or ""
        assert len(parser.parse(text)) == len(set(phrases(text)))
        for keep in (0, len(text) // 2, len(text)):
            own, edited = parser.parse_edited(text, keep, "tail of other words")
            assert (own == parser.parse(text)).all()
            assert (edited == parser.parse(text[:keep] + "tail of other words")).all()


def test_likeness():
    a, b = np.arange(10, dtype=np.uint32), np.arange(5, 15, dtype=np.uint32)
    assert likeness(a, a) == 1 and likeness(a[:0], a[:0]) == 1 and likeness(a, a[:0]) == 0
    assert likeness(a, b) == 5 / 15
    assert likeness(a, b, size=8) == 3 / 8


def check(rows, got):
    # Descending id, texts in order, null ids last; each is followed by the next, the last by the first.
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = []
    for n, (i, text) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        cut = len(text) // 3
        want.append((i, len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(((r.doc_id, r.n_chars, digest(r.edited_text)) for r in got), key=str) == sorted(want, key=str)


def test_edited_texts(spark, docs, corpus, nothing):
    got = edited_fingerprints(docs).collect()
    check(corpus, got)
    parser = PhraseParser()
    for r in got:
        edited = parser.parse(r.edited_text)
        assert (from_text(r.edited_fingerprint) == edited).all()
        assert r.near_edited == likeness(from_text(r.fingerprint), edited)
        assert 0 <= r.near_next <= 1
    assert edited_fingerprints(nothing).collect() == []
    one = spark.createDataFrame([(None, "abcdef")], "doc_id long, text string")
    check([(None, "abcdef")], edited_fingerprints(one).collect())


def test_fingerprints(docs, corpus):
    got = fingerprints(docs)
    by_text = {}
    for r in got.collect():
        by_text.setdefault(r.text or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and by_text[""] == {""}
    assert got.select(likeness_of("fingerprint", "fingerprint").alias("x")).distinct().collect()[0].x == 1.0
    assert got.columns == [*docs.columns, "fingerprint"]
