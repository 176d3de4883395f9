import random
import re

import numpy as np
import pytest

from kinset.llm.ngram_join import forest, multiply, ngram_jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    k = min(k, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def model(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets}  # rows with one id are one vertex

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    degree = [0] * len(sets)
    for a, (i, s) in enumerate(sets):
        for b, (j, t) in enumerate(sets[:a]):
            if s and t and den * len(s & t) >= num * len(s | t):
                degree[a] += 1
                degree[b] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, len(s), find(i), d) for (i, s), d in zip(sets, degree, strict=True))


@pytest.mark.parametrize("k,num,den", [(5, 80, 100), (4, 85, 100)])
def test_equals_brute_force(docs, corpus, k, num, den):
    got = ngram_jaccard_join(docs, words=k, num=num, den=den).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == model(corpus, k, num, den)


def test_two_texts_under_one_key(spark):
    """Near copies of both texts of doc 5, and of one of them under a smaller and a larger key."""
    rng = random.Random(6)
    a, b, c = (" ".join(f"{rng.randrange(10**6):x}" for _ in range(60)) for _ in range(3))
    rows = [(5, a), (5, b), (9, a + " x"), (10, b + " y"), (3, "z " + b), (7, c), (8, c), (8, "w " + a), (5, a), (11, None), (11, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_jaccard_join(df)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got.collect()) == model(rows, 5, 80, 100)
    # Texts alone: those like a, those like b, c.
    groups = {}
    for r in got.where("n_shingles > 0").collect():
        groups.setdefault(r.text_group, set()).add((r.doc_id, r.set_key))
    assert sorted(sorted(i for i, _ in g) for g in groups.values()) == [[3, 5, 10], [5, 8, 9], [7, 8]]


def test_large_groups_are_split(docs, corpus, monkeypatch):
    import kinset.llm.ngram_join as m

    monkeypatch.setattr(m, "BLOCK", 1500)
    got = m.ngram_jaccard_join(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == model(corpus, 5, 80, 100)


def test_empty_and_null_keys(spark, nothing):
    assert ngram_jaccard_join(nothing).collect() == []
    df = spark.createDataFrame([(None, "a b c d e f"), (None, None), (3, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_join(df).collect()), key=str)
    assert got == sorted([(None, 2, 3), (None, 0, None), (3, 2, 3)], key=str)


def test_product_of_blocks():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.95], rng.integers(0, 1 << 62, 2).astype(np.uint64)])) for _ in range(30)]
    want = np.array([[i != j and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    for side in (np.zeros(30, int), (np.arange(30) >= 12).astype(int)):
        a, b, links = multiply(sets, side, 80, 100)
        full = np.zeros((30, 30), bool)
        full[np.ix_(a, b)] = links
        allowed = want if not side.any() else want & (side[:, None] == 0) & (side[None] == 1)
        assert (full == allowed).all()
        label = forest(a, b, links, 30)
        assert ((label >= 0) == (full | full.T).any(1)).all()


def test_small_blocks_around_a_large_one_are_put_together(spark, monkeypatch):
    """400 rows share an n-gram, and 300 more rows one each with one of these: the large blocks must
    not be moved once for each small one, and all rows that share an n-gram must still meet."""
    import kinset.llm.ngram_join as m

    monkeypatch.setattr(m, "BLOCK", 20_000)
    entries = [(0, k) for k in range(400)] + [(100 + i, k) for i in range(300) for k in (i, 1000 + i)]
    shared = spark.createDataFrame(entries, "gram long, key long").selectExpr(
        "gram", "key", "60L as n", "count(1) over (partition by gram) as df"
    )
    placed = m.settle(m.blocks_of(shared, 80, 100))
    block = {r["key"]: r["block"] for r in placed.collect()}
    met = {(r.a, r.b) for r in m.block_pairs(shared, placed, 80, 100).collect()}
    sizes = {b: list(block.values()).count(b) for b in block.values()}
    assert len(block) == 700 and max(sizes.values()) < 200
    assert sum(sizes[a] + (sizes[b] if a != b else 0) for a, b in met) < 10_000
    for i in range(300):
        a, b = sorted((block[i], block[1000 + i]))
        assert (a, b) in met
