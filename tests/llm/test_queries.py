"""The registered queries over whole tables, digests and column types included, against plain models."""

import hashlib
import re
import zlib

import pytest

from kinset.llm import queries as q
from test_mixing import targets
from test_ngram_join import model as ngram_model
from test_repeats import known_model
from test_repeats import model as repeat_model

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def got(df, types):
    assert dict(df.dtypes).items() >= types.items()
    return sorted(tuple(r[c] for c in types) for r in df.select(*types).collect())


def test_op1(spark, rows):
    types = {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "n_links": "bigint"}
    assert got(q.op1_ngram_jaccard(spark, SF), types) == ngram_model(rows, 4, 85, 100)


def test_op2(spark, rows):
    found = {r.doc_id: r for r in q.op2_phrase_fingerprints(spark, SF).collect()}
    order = sorted(rows, reverse=True)
    for (i, t), (_, nxt) in zip(order, [*order[1:], order[0]], strict=True):
        t, nxt = t or "", nxt or ""
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert (found[i].n_chars, found[i].edited_sha256) == (len(t), sha(edited))
        assert 0 <= found[i].near_edited <= 1 and 0 <= found[i].near_next <= 1
    prints = {}
    for i, t in rows:
        assert prints.setdefault(t or "", found[i].fingerprint) == found[i].fingerprint
    # The likeness of equal fingerprints is 1.
    assert all(r.near_edited == 1 for r in found.values() if r.fingerprint == r.edited_fingerprint)


def test_op4(spark, rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=q.tokenizer_path())
    want = []
    for i, t in rows:
        ids = model.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))))
    types = {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    assert got(q.op4_sentencepiece(spark, SF), types) == sorted(want)


def test_op5(spark, rows):
    types = {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    assert got(q.op5_suffix_array(spark, SF), types) == sorted((*x[:4], sha(x[4])) for x in repeat_model(rows, 200))


def test_op6(spark, rows):
    types = {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"}
    texts = [(i, " ".join(WORD.findall(t or ""))) for i, t in rows]
    want = []
    for i, n, gone, kept in known_model(texts, 50):
        want.append((i, n, gone, sha(kept)))
    assert got(q.op6_substring_dedup(spark, SF), types) == sorted(want)


def test_op7(spark, rows):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    want = []
    for i, t in rows:
        lower = (t or "").translate({c: c + 32 for c in range(65, 91)})
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        at = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in at]
        want.append((i, len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    types = {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string"}
    found = q.op7_license_scan(spark, SF)
    assert sorted(map(str, got_any(found, types))) == sorted(map(str, want))
    for r in found.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))


def got_any(df, types):
    assert dict(df.dtypes).items() >= types.items()
    return [tuple(r[c] for c in types) for r in df.select(*types).collect()]


def test_op8(spark, rows):
    types = {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    found = got(q.op8_toxicity(spark, SF), types)
    assert [(i, h) for i, h, _, _ in found] == sorted((i, zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in rows)
    assert all(0 <= s <= 1 and p == (s >= 0.3) for _, _, s, p in found)


def test_op9(spark, rows):
    found = q.op9_mixing(spark, SF).collect()
    size = {i: len(WORD.findall(t or "")) for i, t in rows}
    whole, taken = {}, {}
    for r in found:
        assert r["size"] == size[r.doc_id] and r.taken <= 2 * r["size"]
        whole[r.source] = whole.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = targets(whole)
    assert len(found) == len(rows)
    for r in found:
        assert r.source_size == whole[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    assert all(abs(taken[s] - want[s]) <= max(size.values()) for s in whole)


def test_op10(spark):
    from test_lattice import model

    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    unit = {i: [*v] for i, v in vectors}
    found = {r.vec_id: (r.n_links, r.component_id) for r in q.op10_lattice_vectors(spark, SF).collect()}
    assert found == model(list(unit.items()), 0.95)
