"""Links and pairs by masks, in groups above a bucket where few places vary."""

import random

import pytest

import models
from kinset import near_pairs, single_linkage
from kinset.operators.copies import distinct_sequences
from kinset.operators.signatures import masks_for
from kinset.plans.limits import LIMITS

SCHEMA = "g int, id long, seq string"


def strings(seed, lengths=(9,), groups=2, n=60):
    rng = random.Random(seed)
    texts = ["Nr" + "".join(rng.choice("0123\U0001f600") for _ in range(length - 3)) + "z" for length in lengths for _ in range(n)]
    return [(g if g else None, i * groups + g, s) for g in range(groups) for i, s in enumerate(texts)]


@pytest.mark.parametrize("thres", [0.12, 0.23, 0.34])
@pytest.mark.parametrize("lengths", [(9,), (6, 9)])
def test_masks_equal_all_pairs(spark, tight, thres, lengths):
    rows = strings(3, lengths)
    df = spark.createDataFrame(rows, SCHEMA)
    assert masks_for(distinct_sequences(df, ["g"], "hamming", "skip"), thres) is not None
    got = near_pairs(df, ["g"], "hamming", thres, "block", "skip").collect()
    want = near_pairs(df, ["g"], "hamming", thres, "allpairs", "skip").collect()
    assert len(want) > 0 and sorted(map(str, got)) == sorted(map(str, want))
    members = {r.id: r.cluster_id for r in single_linkage(df, ["g"], "hamming", thres, "skip").collect()}
    ids = [r[1] for r in rows]
    first = {}
    for g, i, s in rows:
        first.setdefault((g, s), i)
    links = [(r.src, r.dst) for r in want] + [(first[g, s], i) for g, i, s in rows]
    assert members == models.components(ids, [x for x in links if x[0] != x[1]])


def test_dense_links_need_no_pairs(spark, tight, monkeypatch):
    # Before, a dense group went through leaders and buckets; now through one window a mask.
    import kinset.operators.components as parts

    def none(*_, **__):
        raise AssertionError("searched for pairs")

    monkeypatch.setattr(parts, "close_pairs", none)
    monkeypatch.setattr(parts, "assign_leaders", none)
    rows = [(0, i, f"{i:010d}") for i in range(300)]
    got = single_linkage(spark.createDataFrame(rows, SCHEMA), ["g"], "hamming", 0.2).collect()
    assert {r.cluster_id for r in got} == {0} and len(got) == 300


def test_too_many_masks_fall_back(spark, tight, monkeypatch):
    monkeypatch.setattr(LIMITS, "masks", 3)
    df = spark.createDataFrame(strings(4), SCHEMA)
    assert masks_for(distinct_sequences(df, ["g"], "hamming"), 0.23) is None
    got = near_pairs(df, ["g"], "hamming", 0.23).count()
    assert got == near_pairs(df, ["g"], "hamming", 0.23, "allpairs").count()


def test_rounds_by_edges_and_letters_are_those_of_the_matrix():
    import numpy as np

    from kinset.operators.matrix import edge_rounds, letter_rounds, merge_rounds

    for seed, n, length, letters, limit in ((1, 60, 4, 3, 0.6), (2, 200, 5, 4, 0.35), (3, 200, 6, 10, 0.4), (4, 300, 4, 9, 0.3)):
        rng = np.random.default_rng(seed)
        texts = np.unique(rng.integers(0, letters, (n, length)), axis=0)
        rng.shuffle(texts)
        ids, copies = np.arange(len(texts)) * 3, rng.integers(1, 4, len(texts))
        mismatches = (texts[:, None] != texts[None]).sum(2).astype(float)
        near = mismatches / length < limit
        a, b = np.nonzero(np.triu(near, 1))
        mix = rng.permutation(len(a))
        a, b = a[mix], b[mix]
        counts = np.concatenate([(c[:, None] == np.unique(c)) * copies[:, None] for c in texts.T], 1)
        want = merge_rounds(ids, copies, mismatches * np.outer(copies, copies), "average", limit, unit=length)
        got = letter_rounds(ids, copies, counts, length, a, b, limit)
        assert len(want) > 5 and sorted(got) == sorted(want)
        weight = np.outer(copies, copies)
        for linkage, value in (("average", mismatches * weight / length), ("complete", mismatches / length), ("single", mismatches / length)):
            want = merge_rounds(ids, copies, np.where(near, value, np.inf), linkage, limit)
            got = edge_rounds(ids, copies, a, b, value[a, b], linkage, limit)
            assert sorted(got) == sorted(want)


@pytest.mark.parametrize("linkage", ["average", "complete"])
@pytest.mark.parametrize("edges", [0, 10**6])
def test_groups_with_few_close_pairs_merge_alike(spark, tight, monkeypatch, linkage, edges):
    # Before, a component above matrix_cells took a quadratic merge or rounds over tables.
    from kinset import linkage_clusters
    from kinset.operators import linkage as used

    df = spark.createDataFrame(strings(5, n=50), SCHEMA)
    monkeypatch.setattr(LIMITS, "pairs_per_row", 1000)
    whole = {r.id: r.cluster_id for r in linkage_clusters(df, ["g"], "hamming", 0.34, linkage).collect()}
    monkeypatch.setattr(LIMITS, "bucket_rows", 2000)
    want = {r.id: r.cluster_id for r in linkage_clusters(df, ["g"], "hamming", 0.34, linkage).collect()}
    assert whole == want
    monkeypatch.setattr(LIMITS, "bucket_rows", 10)
    monkeypatch.setattr(LIMITS, "matrix_cells", 9)
    monkeypatch.setattr(LIMITS, "piece_edges", edges)
    if edges:
        for name in ("_average_rounds", "_merge_edges", "solve_profiles"):
            monkeypatch.setattr(used, name, None)
    got = {r.id: r.cluster_id for r in linkage_clusters(df, ["g"], "hamming", 0.34, linkage).collect()}
    assert got == want
