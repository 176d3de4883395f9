from collections import defaultdict

import numpy as np
import pytest

from kinset.llm.mixing import mix_sources, mixed_rows, split_quotas


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, total = {}, set(names), share * sum(sizes.values())
    while left:
        level = (total - sum(out.values())) / sum(weight[s] for s in left)
        full = [s for s in left if level * weight[s] > most * sizes[s]]
        if not full:
            break
        for s in full:
            out[s] = most * sizes[s]
            left.discard(s)
    return out | {s: level * weight[s] for s in left}


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), [None, "a", "b", "é", "Z"][int(i % 13 % 5)]) for i in range(4000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_takes(many):
    got = mix_sources(many).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["size"] == len(r.text.split()) and r.taken == r["size"] * len(r.placed) <= 2 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
    want = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60
    again = {r.doc_id: (r.taken, r.placed) for r in mix_sources(many.repartition(7)).collect()}
    assert again == {r.doc_id: (r.taken, r.placed) for r in got}


def test_edges(docs, corpus, nothing):
    got = mix_sources(docs).collect()
    assert len(got) == len(corpus) and all(r["size"] == len((r.text or "").split()) for r in got)
    assert mix_sources(nothing).collect() == []
    rows = mixed_rows(docs)
    assert rows.columns == [*docs.columns, "shard", "place"]
    assert rows.count() == sum(len(r.placed) for r in got)


def test_quotas():
    split = split_quotas([100, 0, 7, 31], 5, seed=3)
    assert split.shape == (5, 4) and split.sum(0).tolist() == [100, 0, 7, 31] and split.min() >= 0
    assert np.ptp(split.sum(1)) <= 3
    assert (split == split_quotas([100, 0, 7, 31], 5, seed=3)).all()
    means = np.mean([split_quotas([40, 60], 4, seed=s) for s in range(200)], axis=0)
    assert np.allclose(means, [[10, 15]] * 4, atol=0.6)
