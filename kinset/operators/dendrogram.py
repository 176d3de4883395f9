"""Dendrograms: merge tables of trees, their nodes and leaf order, clusters at many heights.

A merge table has a row for each merge: step (from 0 within the group, by height), the
smallest ids of both clusters, height and new size. A cluster is called by its smallest id, so
at each merge the larger of two names vanishes into the smaller one, for good. These steps make
a tree over the ids, with each root a cluster that is left at the end, and all that is asked of a
dendrogram follows from paths in it, which are walked by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinset.operators.components import components
from kinset.operators.copies import distinct_sequences
from kinset.operators.groups import with_ordinal
from kinset.operators.joins import attach, join_keys, unsent
from kinset.operators.near import union_all
from kinset.plans.limits import LIMITS
from kinset.plans.session import is_empty, settle, settle_counted


def _name_merges(rows: DataFrame) -> DataFrame:
    """``rows`` (piece, a, b, size_a, size_b, dist, src, dst and others) with the names and sizes of
    the clusters that each edge joins, all edges of a piece being taken in order."""

    names = [*rows.columns, "left_id", "right_id", "left_size", "right_size"]
    place = {c: names.index(c) for c in ("piece", "a", "b", "size_a", "size_b")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}
        size: dict[int, int] = {}
        now = None

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            out: list[list[int]] = [[], [], [], []]
            columns = [batch.column(place[c]).to_pylist() for c in ("piece", "a", "b", "size_a", "size_b")]
            for piece, a, b, size_a, size_b in zip(*columns, strict=True):
                if piece != now:
                    up, size, now = {}, {}, piece
                for x, n in ((a, size_a), (b, size_b)):
                    if x not in up:
                        up[x], size[x] = x, n
                a, b = sorted((find(a), find(b)))
                for column, x in zip(out, (a, b, size[a], size[b]), strict=True):
                    column.append(x)
                up[b] = a
                size[a] += size[b]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.int64()) for c in out]], names=names)

    columns = ", ".join(f"{c} long" for c in ("left_id", "right_id", "left_size", "right_size"))
    ordered = rows.repartition("piece").sortWithinPartitions("piece", "dist", "src", "dst")
    return ordered.mapInArrow(run, f"{', '.join(f'`{c}` {t}' for c, t in rows.dtypes)}, {columns}")


def _halves(rows: DataFrame, n: int) -> DataFrame:
    """Large pieces cut in two by rank: the first half falls into the trees that its edges make,
    the second half sees each of these as one vertex."""
    others = [c for c in rows.columns if c not in ("piece", "a", "b", "size_a", "size_b")]
    middle = rows.groupBy("piece").agg(
        F.least(F.percentile_approx("rank", F.lit(0.5)), F.max("rank") - 1).alias("_middle")
    )
    rows = settle(attach(rows, middle, ["piece"], n, "inner"))
    low = rows.where(F.col("rank") <= F.col("_middle"))
    vertex = lambda c: F.struct("piece", F.col(c).alias("at"))
    roots = components(low.select(vertex("a").alias("src"), vertex("b").alias("dst")))
    roots = settle(roots.select(F.col("id.piece").alias("piece"), F.col("id.at").alias("at"), F.col("root.at").alias("_root")))
    vertices = rows.select("piece", F.col("a").alias("at"), F.col("size_a").alias("_size")).unionByName(
        rows.select("piece", F.col("b").alias("at"), F.col("size_b").alias("_size"))
    )
    vertices = vertices.groupBy("piece", "at").agg(F.max("_size").alias("_size"))
    weights = vertices.join(unsent(roots, n), ["piece", "at"]).groupBy("piece", "_root").agg(F.sum("_size").alias("_sum"))
    known = settle(roots.join(unsent(weights, n), ["piece", "_root"]))
    for end in ("a", "b"):
        named = known.withColumnsRenamed({"at": end, "_root": f"_{end}", "_sum": f"_size_{end}"})
        rows = attach(rows, named, ["piece", end], n, dim_rows=n)
    first = F.col("rank") <= F.col("_middle")
    later = [F.when(first, F.col(c)).otherwise(F.coalesce(f"_{c}", c)).alias(c) for c in ("a", "b", "size_a", "size_b")]
    piece = F.when(first, F.concat("piece", F.lit(" "), F.col("_a").cast("string"))).otherwise(F.concat("piece", F.lit(" -")))
    return rows.select(piece.alias("piece"), *later, *others)


def tree_merges(edges: DataFrame, group: Sequence[str]) -> DataFrame:
    """Merge table ``(group, step, left_id, right_id, height, size)`` of single linkage from the
    edges ``(group, src, dst, dist)`` of a spanning forest, as ``mst_edges`` gives them.

    Edges merge in the order of (dist, src, dst). Groups, and trees, of up to ``LIMITS.tree_edges``
    edges are merged in one task each. A larger tree is cut in two by order: what its first half
    joins does not depend on the second half, and for the second half it is single vertices. So
    the largest tree halves each time, and what a task holds is bounded.
    """
    one = F.lit(1).cast("long")
    rows, n = settle_counted(edges.select(
        *group, F.lit(0).alias("_all"), "src", "dst", F.col("dist").cast("double").alias("dist"),
        F.col("src").alias("a"), F.col("dst").alias("b"), one.alias("size_a"), one.alias("size_b"),
    ))
    sizes = rows.groupBy(*group, "_all").agg(F.count(F.lit(1)).alias("_n"), F.min("src").alias("_first"))
    rows = settle(attach(rows, settle(sizes), [*group, "_all"], n, "inner"))
    few = F.col("_n") <= LIMITS.tree_edges
    columns = [F.col("_first").cast("string").alias("piece"), "a", "b", "size_a", "size_b", "dist", "src", "dst", *group]
    done = [_name_merges(rows.where(few).select(*columns))]
    large, n = settle_counted(rows.where(~few))
    if n:
        roots = components(large.select("src", "dst")).select(F.col("id").alias("src"), F.col("root").alias("_root"))
        large = attach(large.drop("_first"), settle(roots), ["src"], n, "inner", dim_rows=n).withColumnRenamed("_root", "_first")
        large = settle(with_ordinal(large.select(*columns), ["dist", "src", "dst"], (), "rank"))
    while n:
        many = large.groupBy("piece").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LIMITS.tree_edges)
        many = settle(many.select("piece"))
        if is_empty(many):
            done.append(_name_merges(large))
            break
        done.append(_name_merges(large.join(many, "piece", "left_anti")))
        large, n = settle_counted(_halves(attach(large, many, ["piece"], n, "inner"), n))
    kept = [*group, "dist", "src", "dst", "left_id", "right_id", (F.col("left_size") + F.col("right_size")).alias("size")]
    merges = with_ordinal(union_all([d.select(*kept) for d in done]), ["dist", "src", "dst"], group, "step")
    return merges.select(*group, "step", "left_id", "right_id", F.col("dist").alias("height"), "size")


def leaf_order(merges: DataFrame) -> DataFrame:
    """(id, tree, pos): the place of every id of a merge table among the leaves of its tree, which is
    named by its smallest id. Each node's leaves are consecutive, those of its left side first.

    A cluster that vanishes is put behind what the other one holds by then, so its place is that
    size further on; the place of a leaf is the sum of these along its path to the root.
    """
    sizes = merges.groupBy(F.col("left_id").alias("right_id")).agg(F.max("size").alias("_own"))
    n = merges.count()
    steps = settle(attach(merges.select("left_id", "right_id", "size"), settle(sizes), ["right_id"], n, dim_rows=n))
    point = steps.select(
        F.col("right_id").alias("id"), F.col("left_id").alias("up"),
        (F.col("size") - F.coalesce("_own", F.lit(1))).alias("pos"),
    )
    roots = merges.select(F.col("left_id").alias("id")).distinct().join(unsent(point, n), "id", "left_anti")
    point = settle(point.unionByName(roots.select("id", F.col("id").alias("up"), F.lit(0).cast("long").alias("pos"))))
    while True:
        onward = point.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("pos").alias("_pos"))
        hop = attach(point, onward, ["up"], 2 * n, "inner", dim_rows=n)
        hop, moving = settle_counted(hop, F.col("up") != F.col("_up"))
        point = hop.select("id", F.col("_up").alias("up"), (F.col("pos") + F.col("_pos")).alias("pos"))
        if moving == 0:
            return point.select("id", F.col("up").alias("tree"), "pos")


def dendrogram(merges: DataFrame, group: Sequence[str]) -> DataFrame:
    """Nodes ``(group, node, left_id, right_id, left_node, right_node, height, size, tree, lo, hi)`` of a
    merge table of any linkage.

    A node is a merge and has its step as number; left_node and right_node are the nodes that it
    joins, null for a leaf, which then is the record left_id or right_id. The leaves of a node are
    those with pos from lo to hi in ``leaf_order`` of its tree: see ``node_leaves``.
    """
    merges, n = settle_counted(merges.select(*group, "step", "left_id", "right_id", "height", "size"))
    last = merges.groupBy(F.col("left_id").alias("right_id")).agg(F.max("step").alias("right_node"))
    # The node before, by the left name: the row before in the order of (name, step).
    ordered = settle(with_ordinal(attach(merges, settle(last), ["right_id"], n, dim_rows=n), ["left_id", "step"], (), "_n"))
    before = ordered.select((F.col("_n") + 1).alias("_n"), F.col("left_id").alias("_left"), F.col("step").alias("_step"))
    nodes = join_keys(ordered, unsent(before, n), ["_n"], "left")
    nodes = nodes.withColumn("left_node", F.when(F.col("_left") == F.col("left_id"), F.col("_step")))
    nodes = attach(nodes, leaf_order(merges).withColumnRenamed("id", "left_id"), ["left_id"], n, "inner", dim_rows=n)
    return nodes.select(
        *group, F.col("step").alias("node"), "left_id", "right_id", "left_node", "right_node", "height", "size",
        "tree", F.col("pos").alias("lo"), (F.col("pos") + F.col("size") - 1).alias("hi"),
    )


def leaves(df: DataFrame, group: Sequence[str], merges: DataFrame) -> DataFrame:
    """(group, id, tree, pos) of every record; one without a merge is a tree of its own."""
    records = df.select(*group, F.col("id").cast("bigint").alias("id"))
    n = records.count()
    placed = attach(records, settle(leaf_order(merges)), ["id"], n, dim_rows=n)
    return placed.select(
        *group, "id", F.coalesce("tree", "id").alias("tree"), F.coalesce("pos", F.lit(0).cast("bigint")).alias("pos")
    )


def node_leaves(nodes: DataFrame, placed: DataFrame, group: Sequence[str], width: int = 1024) -> DataFrame:
    """(group, node, id): the records below each of ``nodes``, from ``leaves``.

    A range join by stretches of ``width`` leaves: a node meets the stretches that it covers, so no
    tree is one key, and no more stretches are met than there are records to put out.
    """
    spans = nodes.select(
        *group, "node", "tree", "lo", "hi",
        F.explode(F.sequence(F.expr(f"lo div {int(width)}"), F.expr(f"hi div {int(width)}"))).alias("_part"),
    )
    own = placed.select(F.col("tree").alias("_tree"), F.expr(f"pos div {int(width)}").alias("_at"), "id", "pos")
    met = spans.join(own, (F.col("tree") == F.col("_tree")) & (F.col("_part") == F.col("_at")))
    return met.where(F.col("pos").between(F.col("lo"), F.col("hi"))).select(*group, "node", "id")


def labels_at(ids: DataFrame, merges: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """(id, thres, cluster_id): the cluster of every id at each of ``cuts``, which is all merges with a
    height below it. Heights must not fall towards the root, as with single, complete and average
    linkage.

    Jumps of 1, 2, 4 ... steps towards the root are tabled once, each with the height that it
    reaches; from the longest down, an id takes those that stay below its cut. All cuts go together.
    """
    jumps, n = [], 1
    jump = merges.select(F.col("right_id").alias("id"), F.col("left_id").alias("up"), F.col("height").alias("top"))
    while True:
        jump, n = settle_counted(jump)
        if n == 0:
            break
        jumps.append((jump, n))
        onward = jump.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"))
        jump = attach(jump, onward, ["up"], n, "inner", dim_rows=n).select("id", F.col("_up").alias("up"), F.col("_top").alias("top"))
    heights = F.array(*[F.lit(float(t)) for t in cuts])
    at = ids.select(F.col("id").cast("bigint").alias("id"), F.explode(heights).alias("thres"))
    at, n = settle_counted(at.withColumn("cluster_id", F.col("id")))
    for jump, far in reversed(jumps):
        step = jump.withColumnRenamed("id", "cluster_id")
        at = attach(at, step, ["cluster_id"], n, dim_rows=far)
        at = at.withColumn("cluster_id", F.when(F.col("top") < F.col("thres"), F.col("up")).otherwise(F.col("cluster_id")))
        at = at.drop("up", "top")
        if n > LIMITS.plain_join_rows:
            at = settle(at)
    return at


def sweep_members(
    df: DataFrame, group: Sequence[str], metric: str, cuts: Sequence[float], linkage: str = "single"
) -> DataFrame:
    """``(group, id, thres, cluster_id)``: the cluster of every record at each threshold, by any linkage.

    The merges are made once, up to the largest threshold; every cut is read off them. At a threshold
    of 0 or less every record is alone. Records without a comparable sequence are alone.
    """
    from kinset.operators.linkage import merges_below

    cuts = sorted({float(t) for t in cuts})
    distinct = distinct_sequences(df, group, metric)
    ids = distinct.table.select("id")
    above = [t for t in cuts if t > 0]
    number = F.col("id").cast("bigint")
    parts = [
        df.select(*group, number.alias("id"), F.lit(t).alias("thres"), number.alias("cluster_id"))
        for t in cuts if t <= 0
    ]
    if above:
        merges = settle(merges_below(distinct, df, above[-1], linkage))
        placed = settle(labels_at(ids, merges, above))
        lists = placed.groupBy("id").agg(F.collect_list(F.struct("thres", "cluster_id")).alias("_at"))
        known = join_keys(distinct.table.select(*group, "seq", "id"), lists, ["id"], "left").select(*group, "seq", "_at")
        members = distinct.attach_to(df.select(*group, "id", "seq"), known)
        alone = F.array(*[F.struct(F.lit(t).alias("thres"), number.alias("cluster_id")) for t in above])
        members = members.select(*group, number.alias("id"), F.explode(F.coalesce("_at", alone)).alias("_x"))
        parts.append(members.select(*group, "id", "_x.thres", "_x.cluster_id"))
    return union_all(parts)


__all__ = ["dendrogram", "labels_at", "leaf_order", "leaves", "node_leaves", "sweep_members", "tree_merges"]
