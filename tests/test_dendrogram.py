import random

import pytest

import models
from kinset import (
    agglomerate,
    cut,
    cut_merges,
    dendrogram,
    leaves,
    linkage_clusters,
    mst_edges,
    node_leaves,
    sweep_members,
    tree_merges,
)
from kinset.plans.limits import LIMITS

SCHEMA = "g int, id long, seq string"


def edge_model(edges):
    """Merges of forest edges one at a time: (left, right, height, size)."""
    name, size, out = {}, {}, []

    def find(x):
        while name.setdefault(x, x) != x:
            x = name[x]
        return x

    for d, a, b in sorted(edges):
        a, b = sorted((find(a), find(b)))
        size[a] = size.get(a, 1) + size.get(b, 1)
        name[b] = a
        out.append((a, b, d, size[a]))
    return out


def random_tree(rng, n, shape):
    ids = rng.sample(range(-n, 5 * n), n)
    out = []
    for i in range(1, n):
        up = {"random": rng.randrange(i), "path": i - 1, "star": 0, "broom": i - 1 if i < n // 2 else 0}[shape]
        a, b = sorted((ids[i], ids[up]))
        out.append((rng.randrange(6) / 4, a, b))
    return out


@pytest.mark.parametrize("shape,limit", [("random", 12), ("path", 20), ("star", 20), ("broom", 20_000)])
def test_merges_of_trees(spark, monkeypatch, shape, limit):
    from kinset.plans.limits import LIMITS

    monkeypatch.setattr(LIMITS, "tree_edges", limit)
    rng = random.Random(3)
    edges = random_tree(rng, 60, shape)
    df = spark.createDataFrame([(0, a, b, d) for d, a, b in edges], "g int, src long, dst long, dist double").repartition(3)
    got = tree_merges(df, ["g"]).orderBy("step").collect()
    assert [(r.left_id, r.right_id, r.height, r["size"]) for r in got] == edge_model(edges)
    assert [r.step for r in got] == list(range(len(edges)))


def check_nodes(nodes, placed, merges, below):
    """The nodes' children, intervals and leaves against the merges followed one at a time."""
    pos = {r.id: (r.tree, r.pos) for r in placed}
    members, made = {i: {i} for i in pos}, {}
    by_node = {(r.g, r.node): r for r in nodes}
    assert len(by_node) == len(merges)
    for m in sorted(merges, key=lambda r: (r.g, r.step)):
        node = by_node[m.g, m.step]
        assert (node.left_id, node.right_id, node.height, node["size"]) == (m.left_id, m.right_id, m.height, m["size"])
        assert (node.left_node, node.right_node) == (made.get(m.left_id), made.get(m.right_id))
        members[m.left_id] |= members.pop(m.right_id)
        made[m.left_id] = m.step
        mine = members[m.left_id]
        assert len(mine) == m["size"] and below.get((m.g, m.step), mine) == mine
        assert {pos[i][0] for i in mine} == {node.tree}
        assert sorted(pos[i][1] for i in mine) == list(range(node.lo, node.hi + 1))


@pytest.mark.parametrize("metric,thres", [("hamming", None), ("edit", 3.0)])
def test_dendrogram_of_single_linkage(spark, metric, thres):
    rows = models.random_rows(41, n=60)
    df = spark.createDataFrame(rows, SCHEMA)
    edges = mst_edges(df, ["g"], metric, thres).cache()
    merges = tree_merges(edges, ["g"]).cache()
    by_group = {}
    for r in edges.collect():
        by_group.setdefault(r.g, []).append((r.dist, r.src, r.dst))
    got = {}
    for r in merges.orderBy("g", "step").collect():
        got.setdefault(r.g, []).append((r.left_id, r.right_id, r.height, r["size"]))
    assert got == {g: edge_model(e) for g, e in by_group.items()}
    nodes, placed = dendrogram(merges, ["g"]).cache(), leaves(df, ["g"], merges).cache()
    below = {}
    for r in node_leaves(nodes, placed, ["g"], width=4).collect():
        below.setdefault((r.g, r.node), set()).add(r.id)
    assert len(below) == nodes.count() and placed.count() == len(rows)
    check_nodes(nodes.collect(), placed.collect(), merges.collect(), below)
    # The top nodes below a height are the clusters of the cut there.
    heights = sorted({r.height for r in nodes.collect()})
    for t in [heights[len(heights) // 2], 9.0]:
        clusters = {r.id: r.cluster_id for r in cut(df, ["g"], edges, t).collect()}
        tops = {}
        for (g, node), ids in below.items():
            h = next(r.height for r in nodes.collect() if (r.g, r.node) == (g, node))
            if h < t:
                for i in ids:
                    tops[i] = max(tops.get(i, ()), (len(ids), min(ids)))
        assert clusters == {i: tops.get(i, (1, i))[1] for _, i, _ in rows}


@pytest.mark.parametrize("linkage", ["average", "complete"])
def test_dendrogram_of_other_linkages(spark, linkage):
    rng = random.Random(5)
    pairs = [(g, 100 * g + i, 100 * g + j, rng.random()) for g in range(2) for i in range(25) for j in range(i + 1, 25)]
    merges = agglomerate(spark.createDataFrame(pairs, "g int, src long, dst long, dist double"), ["g"], linkage).cache()
    df = spark.createDataFrame([(g, 100 * g + i, "x") for g in range(2) for i in range(26)], SCHEMA)
    check_nodes(dendrogram(merges, ["g"]).collect(), leaves(df, ["g"], merges).collect(), merges.collect(), {})


def test_empty(spark):
    none = spark.createDataFrame([], "g int, src long, dst long, dist double")
    merges = tree_merges(none, ["g"])
    assert merges.collect() == [] and dendrogram(merges, ["g"]).collect() == []
    df = spark.createDataFrame([(0, 7, "A")], SCHEMA)
    assert [tuple(r) for r in leaves(df, ["g"], merges).collect()] == [(0, 7, 7, 0)]


@pytest.mark.parametrize(
    "metric,linkage,cuts",
    [("hamming", "single", (0.0, 0.3)), ("hamming", "average", (0.13, 0.4)), ("edit", "average", (1.5, 3.0)), ("edit", "complete", (2.0, 4.0))],
)
def test_sweep_equals_separate_cuts(spark, metric, linkage, cuts):
    rows = [*models.random_rows(44, n=40, groups=2), (0, 9001, None), (1, 9002, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in sweep_members(df, ["g"], metric, cuts, linkage).collect():
        got.setdefault(r.thres, {})[r.id] = r.cluster_id
    assert sorted(got) == sorted(map(float, cuts))
    for t in cuts:
        want = {r.id: r.cluster_id for r in linkage_clusters(df, ["g"], metric, t, linkage).collect()}
        assert got[t] == want


def test_cuts_of_a_long_chain(spark):
    """A path of 3000 ids whose names all vanish one into the next."""
    n = 2600
    edges = spark.createDataFrame([(0, i, i + 1, float(n - i)) for i in range(n)], "g int, src long, dst long, dist double")
    merges = tree_merges(edges, ["g"]).cache()
    from kinset import labels_at

    ids = spark.range(n + 1)
    got = {(r.id, r.thres): r.cluster_id for r in labels_at(ids, merges, [0.5, 100.0, 2500.5]).collect()}
    assert all(got[i, 0.5] == i for i in range(n + 1))
    for t in (100.0, 2500.5):
        first = next(i for i in range(n + 1) if n - i < t)  # the edge at its right end counts
        assert all(got[i, t] == (i if i <= first else first) for i in range(n + 1))
    assert [cut_merges(ids.withColumnRenamed("id", "id").selectExpr("0 as g", "id"), ["g"], merges, thres=100.0).where("id <> cluster_id").count()] == [99]


def test_tables_that_grow_with_the_records_are_not_broadcast(spark, monkeypatch):
    """Ids in order take little room in files, so file sizes must not decide."""
    monkeypatch.setattr(LIMITS, "broadcast_rows", 10, raising=False)
    rows = [(0, i, 20 + i, 10 + i, 2.0, 2) for i in range(10)] + [(0, 10 + i, 0, i + 1, 3.0, 2 * i + 4) for i in range(9)]
    merges = spark.createDataFrame(
        [(g, step, a, b, h, n) for step, (g, _, a, b, h, n) in enumerate(rows)],
        "g int, step long, left_id long, right_id long, height double, size long",
    )
    nodes = dendrogram(merges, ["g"])
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert nodes.count() == 19
