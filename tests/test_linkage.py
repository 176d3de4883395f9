import random

import numpy as np
import pytest

import models
from kinset import agglomerate, cut_merges, linkage_clusters
from kinset.operators import linkage
from kinset.operators.linkage import linkage_merges
from kinset.operators.matrix import merge_rounds, profile_rounds
from kinset.plans.limits import LIMITS

SCHEMA = "g int, id long, seq string"


def as_map(members):
    return {r.id: r.cluster_id for r in members.collect()}


@pytest.mark.parametrize("linkage", ["average", "complete", "single"])
def test_merge_table_equals_greedy(spark, linkage):
    rng = random.Random(31)
    n = 14
    dist = {(i, j): round(rng.random(), 6) for i in range(n) for j in range(i + 1, n)}
    pairs = spark.createDataFrame(
        [(0, i, j, d) for (i, j), d in dist.items()], "g int, src long, dst long, dist double"
    )
    merges = agglomerate(pairs, ["g"], linkage)
    got = [(r.left_id, r.right_id, round(r.height, 9)) for r in merges.orderBy("step").collect()]
    want = [(a, b, round(h, 9)) for a, b, h in models.greedy_merges(range(n), dist, linkage)]
    assert got == want
    ids = spark.createDataFrame([(0, i, "x") for i in range(n)], SCHEMA)
    for k in (1, 4, n):
        kept = want[: n - k]
        assert as_map(cut_merges(ids, ["g"], merges, k=k)) == models.components(
            range(n), [(a, b) for a, b, _ in kept]
        )
    with pytest.raises(ValueError):
        cut_merges(ids, ["g"], merges)


def test_similarity_counts_missing_pairs_as_zero(spark):
    sim = [(0, 1, 2, 0.9), (0, 2, 3, 0.8), (0, 4, 5, 0.9)]
    pairs = spark.createDataFrame(sim, "g int, src long, dst long, dist double")
    got = agglomerate(pairs, ["g"], "average", 0.3, "similarity").orderBy("step").collect()
    # Equal similarities go to the larger ids first; 1 and 3 have no pair.
    assert [(r.left_id, r.right_id, round(r.height, 6)) for r in got] == [
        (4, 5, 0.9), (1, 2, 0.9), (1, 3, 0.4),
    ]


@pytest.mark.parametrize(
    "metric,linkage,thres",
    [("hamming", "average", 0.35), ("hamming", "complete", 0.5), ("edit", "average", 3.0)],
)
def test_linkage_clusters(spark, metric, linkage, thres):
    rows = models.random_rows(32, n=26, groups=2)
    df = spark.createDataFrame(rows, SCHEMA)
    got = as_map(linkage_clusters(df, ["g"], metric, thres, linkage))
    table = models.distinct(rows)
    dist = {(i, j): d for (_, i, j), d in models.pairs(rows, metric).items()}
    roots = {}
    for g in {g for g, _, _ in rows}:
        weights = {i: n for (h, _), (i, n) in table.items() if h == g}
        merges = models.mutual_rounds(sorted(weights), dist, linkage, weights, thres)
        roots |= models.components(weights, [(a, b) for a, b, _ in merges])
    assert got == {i: roots[table[g, s][0]] for g, i, s in rows}


def test_merges_of_records(spark):
    rows = [(0, 1, "AAAA"), (0, 2, "AAAA"), (0, 3, "AAAA"), (0, 4, "AAAT"), (1, 5, "CCCC")]
    df = spark.createDataFrame(rows, SCHEMA)
    merges = linkage_merges(df, ["g"], "hamming")
    got = [(r.step, r.left_id, r.right_id, r.height, r["size"]) for r in merges.orderBy("step").collect()]
    assert got == [(0, 1, 2, 0.0, 2), (1, 1, 3, 0.0, 3), (2, 1, 4, 0.25, 4)]
    # More clusters than distinct sequences: copies stay apart.
    assert as_map(cut_merges(df, ["g"], merges, k=3)) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    with pytest.raises(ValueError):
        linkage_clusters(df, ["g"], "hamming", 0.3, "ward")


@pytest.mark.parametrize(
    "metric,linkage,thres", [("hamming", "average", 0.35), ("edit", "average", 3.0), ("edit", "average", 2.5), ("hamming", "complete", 0.5)]
)
def test_large_pieces_merge_alike(spark, monkeypatch, metric, linkage, thres):
    """Limits so low that every component takes the ways for large ones."""
    from kinset.plans.limits import LIMITS

    df = spark.createDataFrame(models.random_rows(32, n=30, groups=2), SCHEMA)
    want = as_map(linkage_clusters(df, ["g"], metric, thres, linkage))
    monkeypatch.setattr(LIMITS, "matrix_cells", 3)
    monkeypatch.setattr(LIMITS, "measured_whole", 1)
    assert as_map(linkage_clusters(df, ["g"], metric, thres, linkage)) == want


@pytest.mark.parametrize("cells", [20, 1_000_000])
def test_whole_similarity_tables(spark, monkeypatch, cells):
    """Similarities with many ties, none missing."""
    from kinset.plans.limits import LIMITS

    monkeypatch.setattr(LIMITS, "matrix_cells", cells)
    rng = random.Random(9)
    n = 12
    sim = {(i, j): rng.randrange(1, 9) / 8 for i in range(n) for j in range(i + 1, n)}
    pairs = spark.createDataFrame([(0, i, j, s) for (i, j), s in sim.items()], "g int, src long, dst long, dist double")
    merges = agglomerate(pairs, ["g"], "average", None, "similarity").orderBy("step").collect()
    want = similar_rounds(n, sim)
    assert sorted((r.left_id, r.right_id, round(r.height, 9)) for r in merges) == sorted(want)
    assert [r.height for r in merges] == sorted((r.height for r in merges), reverse=True)
    ids = spark.createDataFrame([(0, i, "x") for i in range(n)], SCHEMA)
    kept = [(r.left_id, r.right_id) for r in merges[: n - 4]]
    got = as_map(cut_merges(ids, ["g"], agglomerate(pairs, ["g"], "average", None, "similarity"), k=4))
    assert got == models.components(range(n), kept) and len(set(got.values())) == 4


def similar_rounds(n, sim):
    """Rounds of mutual first choices by (higher similarity, larger id, smaller id), clusters called by
    their smallest ids."""
    clusters, out = {i: [i] for i in range(n)}, []
    while len(clusters) > 1:
        mean = lambda a, b: sum(sim[min(x, y), max(x, y)] for x in clusters[a] for y in clusters[b]) / len(clusters[a]) / len(clusters[b])  # noqa: E731, B023
        scored = sorted((-round(mean(a, b), 12), -b, -a) for a in clusters for b in clusters if a < b)
        first = {}
        for e in reversed(scored):
            first[-e[1]] = first[-e[2]] = e
        for e in {e for e in first.values() if first[-e[1]] == e == first[-e[2]]}:
            out.append((-e[2], -e[1], round(-e[0], 9)))
            clusters[-e[2]] += clusters.pop(-e[1])
    return out


def test_bounds_save_measuring(spark, monkeypatch):
    """A chain of families: far fewer pairs are measured than there are."""
    from kinset.operators.copies import distinct_sequences
    from kinset.operators.linkage import average_edit_below
    from kinset.plans.limits import LIMITS

    rng = random.Random(12)
    seqs = ["".join(rng.choice("ACGT") for _ in range(14))]
    while len(seqs) < 60:
        s = list(rng.choice(seqs[-12:]))
        for _ in range(rng.choice([1, 1, 2])):
            s[rng.randrange(len(s))] = rng.choice("ACGT")
        if (s := "".join(s)) not in seqs:
            seqs.append(s)
    rows = [(0, i, s) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(LIMITS, "measured_whole", 5)
    measured = []
    merges = average_edit_below(distinct_sequences(df, ["g"], "edit"), 3.0, measured).collect()
    dist = {(i, j): d for (_, i, j), d in models.pairs(rows, "edit").items()}
    want = models.mutual_rounds(range(60), dist, "average", None, 3.0)
    assert sorted((r.left_id, r.right_id, round(r.height, 9)) for r in merges) == sorted((a, b, round(h, 9)) for a, b, h in want)
    assert sum(measured) < 60 * 59 / 2 / 3


def test_merges_by_letter_counts_are_those_of_the_matrix():
    for seed, n, length, letters, limit in ((1, 60, 4, 3, None), (2, 200, 5, 4, 0.35), (3, 200, 6, 10, None), (4, 80, 1, 80, None)):
        rng = np.random.default_rng(seed)
        strings = np.unique(rng.integers(0, letters, (n, length)), axis=0)
        rng.shuffle(strings)
        ids, copies = np.arange(len(strings)) * 3, rng.integers(1, 4, len(strings))
        mismatches = (strings[:, None] != strings[None]).sum(2).astype(float)
        want = merge_rounds(ids, copies, mismatches * np.outer(copies, copies), "average", limit, unit=length)
        counts = np.concatenate([(c[:, None] == np.unique(c)) * copies[:, None] for c in strings.T], 1)
        assert profile_rounds(ids, copies, counts, length, limit) == want


@pytest.mark.parametrize("cells", [0, 10**9])
def test_average_merges_need_no_distance_table(spark, monkeypatch, cells):
    rows = models.random_rows(33, n=40, groups=2)
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, linkage_merges(df, ["g"], "hamming").collect()))
    monkeypatch.setattr(LIMITS, "matrix_cells", 4)
    monkeypatch.setattr(LIMITS, "profile_cells", cells)
    if cells:
        monkeypatch.setattr(linkage, "distance_pairs", None)
    assert sorted(map(tuple, linkage_merges(df, ["g"], "hamming").collect())) == want
