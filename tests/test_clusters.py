import random

import pytest
from pyspark.sql import functions as F

import models
from kinset import (
    cluster_counts,
    cluster_radius,
    cluster_sizes,
    components,
    condense,
    cut,
    dense_labels,
    labels,
    leader_clusters,
    mst_edges,
    single_linkage,
    summaries,
    summary_levels,
    two_stage,
)

SCHEMA = "g int, id long, seq string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def as_map(members):
    rows = members.collect()
    out = {r.id: r.cluster_id for r in rows}
    assert len(out) == len(rows)
    return out


def test_components(spark, skewed):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    # A long path in id order and a hub.
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 40)]
    got = components(spark.createDataFrame(edges, "src long, dst long"))
    want = models.components({v for e in edges for v in e}, edges)
    out = {r.id: r.root for r in got.collect()}
    loops = {v for v in want if all(a == b for a, b in edges if v in (a, b))}
    assert out == {v: r for v, r in want.items() if v not in loops}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


CASES = [("hamming", 0.3), ("edit", 2.5)]


@pytest.mark.parametrize("metric,thres", CASES)
def test_single_linkage(spark, metric, thres):
    rows = models.random_rows(21, n=60)
    got = single_linkage(table(spark, rows), ["g"], metric, thres)
    assert as_map(got) == models.single(rows, metric, thres)


@pytest.mark.parametrize("metric,thres", CASES)
def test_single_linkage_dense(spark, tight, metric, thres):
    rows = models.random_rows(22, n=44, groups=2)
    got = single_linkage(table(spark, rows), ["g"], metric, thres)
    assert as_map(got) == models.single(rows, metric, thres)


@pytest.mark.parametrize("metric,thres", CASES)
def test_leader(spark, metric, thres):
    rows = models.random_rows(23, n=60)
    got = leader_clusters(table(spark, rows), ["g"], metric, thres)
    assert as_map(got) == models.leader(rows, metric, thres)


@pytest.mark.parametrize("metric,thres", CASES)
def test_leader_dense(spark, tight, metric, thres):
    rows = models.random_rows(24, n=44, groups=2)
    got = leader_clusters(table(spark, rows), ["g"], metric, thres)
    assert as_map(got) == models.leader(rows, metric, thres)


def test_leader_path_in_id_order(spark):
    # Each is within reach of its neighbours only, so leaders alternate.
    rows = [(0, i, "A" * i + "C" * (12 - i)) for i in range(13)]
    got = as_map(leader_clusters(table(spark, rows), ["g"], "hamming", 0.1))
    assert got == models.leader(rows, "hamming", 0.1)
    assert as_map(single_linkage(table(spark, rows), ["g"], "hamming", 0.1)) == {
        i: 0 for i in range(13)
    }


def test_small_groups_and_missing_sequences(spark):
    rows = [
        (1, 10, "AAAA"),
        (2, 20, "AAAA"), (2, 21, "AAAT"),
        (3, 30, "AAAA"), (3, 31, "TTTT"),
        (4, 40, None), (4, 41, ""), (4, 42, ""), (4, 43, None),
    ]
    df = table(spark, rows)
    want = {10: 10, 20: 20, 21: 20, 30: 30, 31: 31, 40: 40, 41: 41, 42: 42, 43: 43}
    for method in (single_linkage, leader_clusters):
        assert as_map(method(df, ["g"], "hamming", 0.3)) == want
        # At 0 not even copies join.
        assert as_map(method(df, ["g"], "edit", 0.5))[42] == 41
        assert all(i == c for i, c in as_map(method(df, ["g"], "edit", 0)).items())
    empty = spark.createDataFrame([], SCHEMA)
    assert single_linkage(empty, ["g"], "hamming", 0.3).count() == 0
    assert leader_clusters(empty, ["g"], "hamming", 0.3).count() == 0


@pytest.mark.parametrize("metric,thres", [("hamming", None), ("edit", 3)])
def test_mst(spark, metric, thres):
    rows = models.random_rows(25, n=40)
    got = mst_edges(table(spark, rows), ["g"], metric, thres).collect()
    assert sorted((r.src, r.dst, round(r.dist, 9)) for r in got) == models.kruskal(
        rows, metric, thres
    )


@pytest.mark.parametrize("metric,thres", [("hamming", 0.4)])
def test_mst_dense_and_cut(spark, tight, metric, thres):
    rows = models.random_rows(26, n=40, groups=2)
    df = table(spark, rows)
    forest = mst_edges(df, ["g"], metric, thres)
    assert sorted((r.src, r.dst, round(r.dist, 9)) for r in forest.collect()) == models.kruskal(
        rows, metric, thres
    )
    lower = thres / 2
    assert as_map(cut(df, ["g"], forest, lower)) == models.single(rows, metric, lower)


def model_condense(rows, metric, inner, coarse=None):
    led = models.leader(rows, metric, inner)
    centres = [r for r in rows if led[r[1]] == r[1]]
    if coarse is not None and coarse > inner:
        again = models.leader(centres, metric, coarse)
        led = {i: again[c] for i, c in led.items()}
        centres = [r for r in centres if again[r[1]] == r[1]]
    return led, centres


def test_condense_and_summaries(spark):
    rows = models.random_rows(27, n=60)
    df = table(spark, rows)
    for coarse in (None, 0.4):
        members = condense(df, ["g"], "hamming", 0.2, coarse)
        want, _ = model_condense(rows, "hamming", 0.2, coarse)
        assert as_map(members) == want
    seqs = {i: s for _, i, s in rows}
    got = {
        r.center_id: (r.weight, round(r.radius, 9))
        for r in summaries(df, ["g"], "hamming", members).collect()
    }
    assert got == {
        c: (
            sum(1 for x in want.values() if x == c),
            round(max(models.hamming(seqs[i], seqs[c]) for i, x in want.items() if x == c), 9),
        )
        for c in set(want.values())
    }


@pytest.mark.parametrize("cut_at", [None, 0.2])
def test_two_stage(spark, cut_at):
    rows = models.random_rows(28, n=60)
    df = table(spark, rows)
    got = as_map(two_stage(df, ["g"], "hamming", 0.3, inner=0.2, cut=cut_at))
    led, centres = model_condense(rows, "hamming", 0.2, 0.3 if cut_at is None else cut_at)
    final = models.single(centres, "hamming", 0.3)
    assert got == {i: final[c] for i, c in led.items()}


def test_cluster_tables(spark, skewed):
    rows = models.random_rows(29, n=50)
    df = table(spark, rows)
    members = single_linkage(df, ["g"], "hamming", 0.3)
    want = models.single(rows, "hamming", 0.3)
    group = {i: g for g, i, _ in rows}
    sizes = {r.cluster_id: r["size"] for r in cluster_sizes(members, ["g"]).collect()}
    assert sum(sizes.values()) == len(rows)
    assert sizes == {c: list(want.values()).count(c) for c in set(want.values())}
    for r in cluster_counts(members, ["g"]).collect():
        mine = [c for i, c in want.items() if group[i] == r.g]
        assert (r.clusters, r.records) == (len(set(mine)), len(mine))
    assert {r.id: r.label for r in labels(members).collect()} == want
    order = sorted({(group[c], c) for c in want.values()})
    for start in (0, 1):
        got = {r.id: r.label for r in dense_labels(members, ["g"], start).collect()}
        assert got == {i: order.index((group[i], c)) + start for i, c in want.items()}
    radius = {r.cluster_id: r.radius for r in cluster_radius(df, members, ["g"], "hamming").collect()}
    assert set(radius) == set(sizes) and min(radius.values()) == 0.0


def test_leaders_of_a_long_path(spark, monkeypatch):
    import kinset.operators.leader as leader

    edges = [(i, i + 1) for i in range(2000)]
    df = spark.createDataFrame(edges, "src long, dst long")
    # Vertices in order: every second one leads, the others follow the one before.
    want = {i: i - 1 for i in range(1, 2001, 2)}
    got = {r.id: r.cluster_id for r in leader.first_leaders(df).collect()}
    assert got == want
    monkeypatch.setattr(leader, "CHAIN", 3)
    short = spark.createDataFrame(edges[:30] + [(100, 101), (100, 102), (101, 103)], "src long, dst long")
    got = {r.id: r.cluster_id for r in leader.first_leaders(short).collect()}
    assert got == {i: i - 1 for i in range(1, 31, 2)} | {101: 100, 102: 100}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    import kinset.operators.leader as leader

    steps = []
    count = leader.settle_counted
    monkeypatch.setattr(leader, "settle_counted", lambda *a: steps.append(1) or count(*a))
    n = 30_000
    path = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = leader.first_leaders(path)
    wrong = got.where("id % 2 = 0 or cluster_id <> id - 1")
    assert got.count() == n // 2 and wrong.count() == 0
    assert len(steps) < 40


def test_leaders_of_chains_that_meet(spark, monkeypatch):
    """Chains that end in vertices waiting for several."""
    import kinset.operators.leader as leader

    monkeypatch.setattr(leader, "CHAIN", 2)
    monkeypatch.setattr(leader, "ROUNDS", 2)
    rng = random.Random(1)
    edges = {(rng.randrange(max(0, i - 4), i), i) for i in range(1, 60)}
    edges |= {(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(12)) if a < b}
    edges |= {(60, i) for i in range(61, 90)} | {(i, i + 40) for i in range(61, 90)}
    followers = {}
    for v in range(200):
        first = [a for a, b in sorted(edges) if b == v and a not in followers]
        if first:
            followers[v] = first[0]
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    assert {r.id: r.cluster_id for r in leader.first_leaders(df).collect()} == followers


@pytest.mark.parametrize("dense", [False, True])
def test_distance_at_the_threshold(spark, request, dense):
    """Whole products of length and threshold: pairs at just the threshold are not linked."""
    if dense:
        request.getfixturevalue("tight")
    # Two sets that differ from each other in 2 places at least, each linked within itself.
    rows = [(0, i, "CCCCCCCC" + a + b) for i, (a, b) in enumerate([(x, x) for x in "ABDE"] + [("A", "B"), ("D", "E")])]
    df = table(spark, rows)
    assert as_map(single_linkage(df, ["g"], "hamming", 0.2)) == models.single(rows, "hamming", 0.2)
    far = [(0, i, "GGGGGGGGGG"[: 10 - k] + "T" * k) for i, k in enumerate((0, 2, 4, 6))]
    assert as_map(single_linkage(table(spark, far), ["g"], "hamming", 0.2)) == {i: i for i in range(4)}


def test_condense_without_inner(spark):
    rows = [(0, 1, "AAAAAAAAAA"), (0, 2, "AAAAAAAAAC"), (0, 3, "AAAAAAAAAA"), (0, 4, "GGGGGGGGGG")]
    df = table(spark, rows)
    assert as_map(condense(df, ["g"], "hamming", 0.0)) == {i: i for i in (1, 2, 3, 4)}
    assert as_map(condense(df, ["g"], "hamming", 0.0, 0.2)) == models.leader(rows, "hamming", 0.2)
    got = as_map(two_stage(df, ["g"], "hamming", 0.15, inner=0.0, cut=0.2))
    assert got == models.leader(rows, "hamming", 0.2)


@pytest.mark.parametrize("metric,cuts", [("hamming", (0.2, 0.4, 0.7)), ("edit", (1.0, 2.5, 5.0))])
def test_summary_levels(spark, metric, cuts):
    rows = [*models.random_rows(61, n=50), (1, 9001, None)]
    df = table(spark, rows)
    levels = summary_levels(df, ["g"], metric, cuts).collect()
    by_level = [{r.center_id: r for r in levels if r.level == i} for i in range(len(cuts))]
    sizes = [len(x) for x in by_level]
    assert sizes == sorted(sizes, reverse=True) and all(sum(r.weight for r in x.values()) == len(rows) for x in by_level)
    seqs = {i: s for _, i, s in rows}
    at = models.leader([r for r in rows if r[2] is not None], metric, cuts[0]) | {9001: 9001}
    for i, found in enumerate(by_level):
        assert {c: sum(x == c for x in at.values()) for c in at.values()} == {c: r.weight for c, r in found.items()}
        for x, c in at.items():
            assert x == c or models.DIST[metric](seqs[x], seqs[c]) <= found[c].radius + 1e-9
        if i == 0:
            assert all(r.radius == max([models.DIST[metric](seqs[x], seqs[c]) for x, y in at.items() if y == c and x != c], default=0.0) for c, r in found.items())
        at = {x: found[c].parent_id for x, c in at.items()}
    with pytest.raises(ValueError):
        summary_levels(df, ["g"], metric, (0.4, 0.2))
