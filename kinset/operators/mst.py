"""Minimum spanning forests of the close-pair graph, and their cuts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinset.functions.distance import edit_radius
from kinset.operators.components import components
from kinset.operators.copies import Distinct, distinct_sequences
from kinset.operators.joins import attach, join_keys
from kinset.operators.matrix import each_piece
from kinset.operators.near import close_pairs, is_dense, union_all
from kinset.plans.limits import LIMITS
from kinset.plans.session import is_empty, settle, settle_counted


def spanning_forest(edges: DataFrame, group: Sequence[str]) -> DataFrame:
    """Minimum spanning forest of ``edges(group, src, dst, dist, src_comp,
    dst_comp)``, which joins components; ``_root`` is the smallest component that an edge
    reaches, where that is known already.

    Edges are ordered by (dist, src, dst), so the forest is unique. The edges of
    a group that has few go through one task in this order. For the others, in
    rounds, every component takes its first outgoing edge, and the components
    those edges join become one; of the edges between two components only the
    first can ever be taken, so the others are dropped.
    """
    chosen, edges = _small_forests(edges, group)
    if edges is None:
        return chosen
    entry = F.struct("dist", "src", "dst", *group, "src_comp", "dst_comp")
    left = edges.select(
        F.least("src_comp", "dst_comp").alias("_a"),
        F.greatest("src_comp", "dst_comp").alias("_b"),
        entry.alias("_edge"),
    )
    chosen = [chosen]
    left, n = settle_counted(left.groupBy("_a", "_b").agg(F.min("_edge").alias("_edge")))
    while n > 0:
        ends = left.select(F.col("_a").alias("_c"), "_edge", "_a", "_b").unionByName(
            left.select(F.col("_b").alias("_c"), "_edge", "_a", "_b")
        )
        first = ends.groupBy("_c").agg(F.min(F.struct("_edge", "_a", "_b")).alias("_first"))
        taken = settle(first.select("_first.*").distinct())
        chosen.append(taken.select("_edge.*"))
        roots = components(taken.select(F.col("_a").alias("src"), F.col("_b").alias("dst")))
        roots = settle(roots)
        for end in ("_a", "_b"):
            left = attach(left, roots.withColumnRenamed("id", end), [end], n)
            left = left.withColumn(end, F.coalesce("root", end)).drop("root")
        left = left.where("_a <> _b").select(
            F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b"), "_edge"
        )
        left, n = settle_counted(left.groupBy("_a", "_b").agg(F.min("_edge").alias("_edge")))
    columns = [*group, "src", "dst", "dist", "src_comp", "dst_comp"]
    found = [c.select(*columns, F.lit(None).cast("bigint").alias("_root")) for c in chosen[1:]]
    return union_all([chosen[0].select(*columns, "_root"), *found])


def _forest_roots(forest: DataFrame) -> DataFrame:
    """(comp, root) of the components that a forest of ``spanning_forest`` joins."""
    ends = [forest.where("_root is not null").select(F.col(c).alias("comp"), F.col("_root").alias("root")) for c in ("src_comp", "dst_comp")]
    known = union_all(ends).distinct()
    others = forest.where("_root is null")
    if is_empty(others):
        return known
    found = components(others.select(F.col("src_comp").alias("src"), F.col("dst_comp").alias("dst")))
    return known.unionByName(found.withColumnRenamed("id", "comp"))


def _small_forests(edges: DataFrame, group: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """The forests of groups with few edges, and the edges of the others (None without any)."""
    edges, n = settle_counted(edges.withColumn("_all", F.lit(0)))
    keys = [*group, "_all"]
    sizes = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("src").alias("_piece"))
    placed = attach(edges, settle(sizes), keys, n, "inner")
    fits = F.col("_n") <= LIMITS.matrix_cells
    columns = ["_piece", "dist", "src", "dst", "src_comp", "dst_comp", *group]
    rows = placed.where(fits).select(*columns).repartition("_piece").sortWithinPartitions("_piece", "dist", "src", "dst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in each_piece(batches):
            kept, root = _ordered_forest(*(table.column(i).to_numpy() for i in (4, 5)))
            table = table.append_column("_root", pa.array(root)).filter(pa.array(kept))
            yield from table.combine_chunks().to_batches()

    schema = rows.withColumn("_root", F.lit(0).cast("bigint")).schema
    forests = settle(rows.mapInArrow(run, schema).drop("_piece"))
    large, n = settle_counted(placed.where(~fits).drop("_all", "_n", "_piece"))
    return forests, large if n else None


def _ordered_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the edges (a, b), best first, are in the spanning forest, and the smallest vertex
    that each of them reaches. In rounds every component takes its first outgoing edge."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    n, m = len(ids), len(a)
    a, b = at[:m], at[m:]
    comp, kept, live = np.arange(n), np.zeros(m, bool), np.arange(m)
    while True:
        x, y = comp[a[live]], comp[b[live]]
        across = x != y
        live, x, y = live[across], x[across], y[across]
        if not len(live):
            break
        first = np.full(n, m)
        for end in (x, y):
            mine = np.full(n, m)
            # The last one written, which is the first in order, stays.
            mine[end[::-1]] = live[::-1]
            first = np.minimum(first, mine)
        roots = np.flatnonzero(first < m)
        taken = first[roots]
        kept[taken] = True
        up = np.arange(n)
        up[roots] = comp[a[taken]] + comp[b[taken]] - roots
        # Two components that took the same edge point to each other.
        top = roots[(up[up[roots]] == roots) & (roots < up[roots])]
        up[top] = top
        while (up[up] != up).any():
            up = up[up]
        comp = up[comp]
    smallest = np.empty(n, np.int64)
    smallest[comp[::-1]] = ids[::-1]
    return kept, smallest[comp[a]]


def _rungs(distinct: Distinct, thres: float | None) -> list[dict]:
    """Radii at which edges are searched, smallest first.

    Close edges join most sequences before wide radii are searched, where then
    only pairs of different components count.
    """
    if thres is not None and not is_dense(distinct, distinct.table, thres, LIMITS.edges_per_row):
        return [{"thres": thres}]
    if thres is None:
        reach = distinct.longest
    elif distinct.metric == "hamming":
        reach = int(thres * distinct.longest)
    else:
        reach = edit_radius(thres)
    rungs, radius = [], 1
    while radius < reach:
        rungs.append({"within": radius})
        radius *= 2
    rungs.append({"within": max(reach, 0)} if thres is None else {"thres": thres})
    return rungs


def _across(distinct: Distinct, table: DataFrame, radius: dict) -> DataFrame:
    """Close pairs of different components of ``table``, in which ``_main`` is the largest component
    of each group: one end of every such pair lies outside it, and those rows only are searched for."""
    rest = settle(table.where("comp <> _main").drop("_main"))
    main = table.where("comp = _main").drop("_main")
    inside = close_pairs(distinct, rest, **radius, carry=("comp",), comp=True)
    out = close_pairs(distinct, rest, main, **radius, carry=("comp",), comp=True)
    turn = F.col("src") > F.col("dst")
    ends = [
        F.when(turn, F.col(there)).otherwise(F.col(here)).alias(here)
        for x, y in (("src", "dst"), ("src_comp", "dst_comp")) for here, there in ((x, y), (y, x))
    ]
    return inside.unionByName(out.select(*distinct.group, *ends, "dist"))


def mst_edges(
    df: DataFrame,
    group: Sequence[str],
    metric: str,
    thres: float | None = None,
    on_unequal: str = "raise",
) -> DataFrame:
    """Edges ``(group, src, dst, dist)`` of each group's minimum spanning tree,
    or of its forest below ``thres``.

    Sorted by distance they are the merge heights of single linkage. Edges are
    ordered by (dist, src, dst), and a copy hangs at its sequence's smallest id.
    Without ``thres`` and with ``on_unequal='skip'`` sequences of different
    lengths stay apart.
    """
    distinct = distinct_sequences(df, group, metric, on_unequal)
    table = distinct.table.withColumn("comp", F.col("id"))
    trees = []
    rungs = [] if thres is not None and thres <= 0 else _rungs(distinct, thres)
    for number, radius in enumerate(rungs):
        if number == 0:
            edges = close_pairs(distinct, table, **radius, carry=("comp",), comp=True)
        else:
            edges = _across(distinct, table, radius)
        trees.append(settle(spanning_forest(edges, group)))
        if number == len(rungs) - 1:
            break
        roots = settle(_forest_roots(trees[-1]))
        table = attach(table, roots, ["comp"], distinct.rows, dim_rows=distinct.rows)
        table = table.withColumn("comp", F.coalesce("root", "comp")).drop("root")
        # Groups that are one tree already need no wider radius.
        table = settle(table.drop("_main").withColumn("_all", F.lit(0)))
        counted = table.groupBy(*group, "_all", "comp").agg(F.count(F.lit(1)).alias("_n"))
        open_groups = (
            counted.groupBy(*group, "_all")
            .agg(F.max(F.struct("_n", "comp"))["comp"].alias("_main"), F.count(F.lit(1)).alias("_comps"))
            .where("_comps > 1")
            .drop("_comps")
        )
        table = attach(table, settle(open_groups), [*group, "_all"], distinct.rows, "inner")
        table = settle(table.drop("_all"))
        if is_empty(table):
            break
    own = distinct.table.select(*group, "seq", F.col("id").alias("src"))
    copies = distinct.attach_to(df.select(*group, "id", "seq"), own, "inner").where("id <> src")
    if thres is not None and thres <= 0:
        copies = copies.where(F.lit(False))
    trees.append(
        copies.select(*group, "src", F.col("id").cast("bigint").alias("dst"), F.lit(0.0).alias("dist"))
    )
    return union_all([t.select(*group, "src", "dst", "dist") for t in trees])


def cut(df: DataFrame, group: Sequence[str], edges: DataFrame, thres: float) -> DataFrame:
    """Members after cutting tree ``edges`` at ``thres``: the clusters of single
    linkage at that threshold."""
    kept = edges.where(F.col("dist") < thres)
    roots = components(kept.select("src", "dst"))
    records = df.select(*group, F.col("id").cast("bigint").alias("id"))
    placed = join_keys(records, roots, ["id"], "left")
    return placed.select(*group, "id", F.coalesce("root", "id").alias("cluster_id"))
