import models
import pytest
from kinset import (
    cluster_lists,
    group_labels,
    read_cluster_lists,
    read_group_labels,
    shared_path,
    single_linkage,
    write_cluster_lists,
    write_group_labels,
)

SCHEMA = "g int, id long, seq string"


@pytest.fixture(scope="module")
def clustered(spark):
    rows = [*models.random_rows(51, n=60, groups=4), (None, 9001, "AAAA"), (None, 9002, "AAAT"), (2, 9003, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    return rows, df, single_linkage(df, ["g"], "edit", 2.0).cache()


def test_cluster_lists(spark, clustered):
    rows, df, members = clustered
    lists = cluster_lists(df, members, ["g"], "edit", list_rows=9).cache()
    assert max(sum(len(c.members) for c in r.clusters) for r in lists.collect()) <= 9
    path = shared_path(spark, "lists")
    write_cluster_lists(lists, ["g"], path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert len(lines) == lists.count() and all(x.startswith('{"g":') for x in lines)
    got = read_cluster_lists(spark, path, "g int").collect()
    seq = {i: s for _, i, s in rows}
    of = {r.id: r.cluster_id for r in members.collect()}
    size = {c: list(of.values()).count(c) for c in of.values()}
    assert sorted((r.id, r.center, r.seq or "", r["size"]) for r in got) == sorted((i, of[i], seq[i] or "", size[of[i]]) for _, i, _ in rows)
    far = {}
    for i, c in of.items():
        if seq[i] is not None:
            far[c] = max(far.get(c, 0.0), models.edit(seq[i], seq[c]))
    assert all(r.radius == far.get(r.center, 0.0) for r in got if r.seq is not None)
    # Parts of a group hold its records in the order of cluster and id.
    for g in {r.g for r in got}:
        mine = [(r.part, r.center, r.id) for r in got if r.g == g]
        assert [x[1:] for x in sorted(mine)] == sorted(x[1:] for x in mine)
    with pytest.raises(Exception, match="(?i)already exists"):
        write_cluster_lists(lists, ["g"], path)


def test_label_files(spark, clustered):
    rows, df, members = clustered
    both = members.selectExpr("'mst' as method", "g", "id", "cluster_id").unionByName(members.selectExpr("'alone' as method", "g", "id", "id as cluster_id"))
    labels = group_labels(both, ["method", "g"]).cache()
    path = shared_path(spark, "labels")
    write_group_labels(labels, ["method", "g"], path)
    want = {}
    for r in sorted(labels.collect(), key=lambda r: r.id):
        want.setdefault((r.method, r.g), []).append(r.label)
    got = {}
    for r in sorted(read_group_labels(spark, path, "method string, g int").collect(), key=lambda r: r.line):
        got.setdefault((r.method, r.g), []).append(r.label)
    assert got == want
    assert all(sorted(set(x)) == list(range(len(set(x)))) for x in got.values())
    assert got["alone", None] == [0, 1]
