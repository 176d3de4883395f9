import pytest
from pyspark.errors import PySparkException

import models
from kinset import cluster_groups, compare_methods, route_groups, threshold_sweep

SCHEMA = "g int, id long, seq string"


def rows_of_sizes():
    rows = []
    for g, n in enumerate((1, 2, 6, 14)):
        for r in models.random_rows(40 + g, n=n, groups=1, copies=False):
            rows.append((g, 1000 * g + r[1], r[2]))
    return rows


def as_map(members):
    return {r.id: r.cluster_id for r in members.collect()}


def test_route_groups(spark):
    rows = rows_of_sizes()
    routed = [(*r, "leader" if r[0] < 2 else "mst") for r in rows]
    df = spark.createDataFrame(routed, SCHEMA + ", how string")
    got = as_map(route_groups(df, ["g"], "hamming", 0.3, "how", ["leader", "mst"]))
    small = [r for r in rows if r[0] in (0, 1)]
    large = [r for r in rows if r[0] in (2, 3)]
    assert got == models.leader(small, "hamming", 0.3) | models.single(large, "hamming", 0.3)
    with pytest.raises(ValueError):
        route_groups(df, ["g"], "hamming", 0.3, "how", ["other"])
    with pytest.raises(PySparkException, match="no such method"):
        route_groups(df, ["g"], "hamming", 0.3, "how", ["leader"])


def test_cluster_groups(spark):
    rows = rows_of_sizes()
    df = spark.createDataFrame(rows, SCHEMA)
    single = models.single(rows, "hamming", 0.3)
    # One method for all groups, whatever their sizes.
    for method in (1, 2, "mst"):
        assert as_map(cluster_groups(df, ["g"], method, "hamming", 0.3)) == single
    options = {"two_stage": {"inner": 0.0, "cut": 0.0}}
    assert as_map(cluster_groups(df, ["g"], 3, "hamming", 0.3, options)) == single
    with pytest.raises(ValueError):
        cluster_groups(df, ["g"], 4)


@pytest.mark.parametrize("dense", [False, True])
def test_sweep(spark, request, dense):
    if dense:
        request.getfixturevalue("tight")
    rows = models.random_rows(45, n=36, groups=2)
    df = spark.createDataFrame(rows + [(0, 9999, None)], SCHEMA)
    cuts = (0.0, 0.1, 0.2, 0.4)
    got = {r.thres: r.clusters for r in threshold_sweep(df, ["g"], "hamming", cuts).collect()}
    want = {t: 1 + len(set(models.single(rows, "hamming", t).values())) for t in cuts}
    assert got == want


def test_compare_methods(spark):
    rows = rows_of_sizes()
    df = spark.createDataFrame(rows, SCHEMA)
    got = compare_methods(df, ["g"], "hamming", 0.3, k=1, methods=("mst", "leader")).collect()
    top = [r for r in rows if r[0] == 3]
    assert {r.id: r.cluster_id for r in got if r.method == "mst"} == models.single(top, "hamming", 0.3)
    assert {r.id: r.cluster_id for r in got if r.method == "leader"} == models.leader(
        top, "hamming", 0.3
    )


def test_condense_sweep_searches_the_centres_once(spark, monkeypatch):
    import random

    import kinset.operators.leader as leader
    from kinset.operators.condense import Leaves

    rng = random.Random(11)
    rows = [(i % 3, i, "".join(rng.choice("ab") for _ in range(18))) for i in range(150)]
    rows += [(0, 500, None), (1, 501, rows[1][2])]
    df = spark.createDataFrame(rows, "g int, id long, seq string")
    cuts = (-1.0, 0.03, 0.06, 0.12, 0.15, 0.2)
    leaves = Leaves(df, ["g"], "hamming", 0.06)
    want = []
    for t in cuts:
        centres = leaves.coarsen(t).where("id = cluster_id") if t > 0.06 else leaves.centres
        want.append((t, centres.count() + 1))
    calls = []
    search = leader.close_pairs
    monkeypatch.setattr(leader, "close_pairs", lambda *a, **b: calls.append(b) or search(*a, **b))
    got = threshold_sweep(df, ["g"], "hamming", cuts, "condense", 0.06)
    assert sorted(map(tuple, got.collect())) == want
    # Once for the leaves, once for the centres at all cuts.
    assert len(calls) == 2
