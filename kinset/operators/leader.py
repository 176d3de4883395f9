"""Leader clustering: in id order, join the first leader close enough."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinset.operators.contraction import components
from kinset.operators.copies import Distinct, distinct_sequences, restore
from kinset.operators.groups import with_ordinal
from kinset.operators.joins import attach, unsent
from kinset.operators.near import candidate_load, close_pairs, union_all
from kinset.plans.limits import LIMITS
from kinset.plans.session import is_empty, settle, settle_counted


#: Rounds between looks at what is left, and edges of a component gone through in one row.
ROUNDS, CHAIN = 4, 5_000


def first_leaders(edges: DataFrame) -> DataFrame:
    """Leader of each vertex of ``edges(src < dst)`` that is not one itself.

    Going through the vertices in id order, one becomes a leader unless it has
    a leader among its smaller neighbours. In rounds: a vertex without a smaller
    undecided neighbour leads, all its neighbours are covered, and the edges of
    covered vertices go. This gives the same leaders as the sequential order.

    Few vertices wait for long, but chains of them would take a round a link: after
    ``ROUNDS`` rounds the small components that are left are gone through in
    order, each in one row, and in larger ones whole chains are decided at once.
    """
    edges, n = settle_counted(edges.select("src", "dst"))
    left, covered, turn = edges, [], 0
    while n > 0:
        turn += 1
        if turn % ROUNDS == 0:
            done, left = _in_order(left)
            covered.append(done)
            left, n = settle_counted(left)
            if n == 0:
                break
            now = _along_chains(left, n)
            covered.append(now)
            left, n = settle_counted(_without(left, unsent(now, n)))
            continue
        preceded = left.select(F.col("dst").alias("src")).distinct().withColumn("_wait", F.lit(1))
        marked = settle(left.join(unsent(preceded, n), "src", "left"))
        now = settle(marked.where("_wait is null").select("dst").distinct())
        covered.append(now)
        left, n = settle_counted(_without(marked.drop("_wait"), unsent(now, n)))
    if covered:
        followers = union_all(covered).distinct().withColumnRenamed("dst", "src")
        edges = edges.join(followers, "src", "left_anti")
    return edges.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("cluster_id"))


def _without(left: DataFrame, covered: DataFrame) -> DataFrame:
    """Edges of ``left`` at whose ends no vertex is covered."""
    left = left.join(covered, "dst", "left_anti")
    return left.join(covered.withColumnRenamed("dst", "src"), "src", "left_anti")


def _along_chains(left: DataFrame, n: int) -> DataFrame:
    """Covered vertices of the chains of ``left`` that start at a leader.

    A vertex with one smaller neighbour leads exactly if that one does not. Such
    vertices point to it; pointers are followed twice as far each time, counting
    links, until they reach a vertex that waits for none (it leads, so an odd
    number of links away all are covered) or for several (not decided yet).
    """
    waiting = settle(left.groupBy("dst").agg(F.count(F.lit(1)).alias("_n"), F.min("src").alias("_up")))
    point = settle(
        waiting.where("_n = 1").select(F.col("dst").alias("id"), "_up", F.lit(True).alias("_odd"))
    )
    while True:
        onward = point.select(F.col("id").alias("_up"), F.col("_up").alias("_far"), F.col("_odd").alias("_more"))
        hop = attach(point, onward, ["_up"], n, dim_rows=n)
        moved = F.col("_far").isNotNull()
        point, moving = settle_counted(
            hop.select(
                "id", F.coalesce("_far", "_up").alias("_up"),
                (F.col("_odd") != F.coalesce("_more", F.lit(False))).alias("_odd"), moved.alias("_moved"),
            ),
            F.col("_moved"),
        )
        point = point.drop("_moved")
        if moving == 0:
            break
    several = waiting.where("_n > 1").select(F.col("dst").alias("_up"), F.lit(True).alias("_open"))
    ended = attach(point.where("_odd"), several, ["_up"], n)
    return settle(ended.where("_open is null").select(F.col("id").alias("dst")))


def _in_order(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Covered vertices of the small components of ``left``, and the edges of the others."""
    roots = settle(components(left))
    tagged = attach(left, roots.withColumnRenamed("id", "src"), ["src"], LIMITS.plain_join_rows + 1, "inner")
    tagged = settle(tagged)
    sizes = tagged.groupBy("root").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CHAIN)
    large = settle(sizes.select("root"))
    small = tagged.join(large, "root", "left_anti")
    before = small.groupBy("root", "dst").agg(F.collect_list("src").alias("srcs"))
    lists = before.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("dst", "srcs"))).alias("_v"))
    # A vertex is covered if one of its smaller neighbours is not, and so leads.
    covered = F.aggregate(
        "_v", F.array().cast("array<bigint>"),
        lambda s, v: F.when(
            F.exists(v["srcs"], lambda x: ~F.array_contains(s, x)), F.concat(s, F.array(v["dst"]))
        ).otherwise(s),
    )
    done = settle(lists.select(F.explode(covered).alias("dst")))
    return done, tagged.join(large, "root", "left_semi").select("src", "dst")


def assign_leaders(distinct: Distinct, thres: float) -> DataFrame:
    """``(id, cluster_id)`` of the sequences that follow a leader."""
    if thres <= 0:
        return distinct.table.select("id", F.col("id").alias("cluster_id")).where(F.lit(False))
    return union_all(_solve(distinct, distinct.table, thres))


def leaders_at(distinct: Distinct, cuts: Sequence[float]) -> dict[float, DataFrame]:
    """``assign_leaders`` at several thresholds.

    If meeting all key partners is affordable, the pairs are searched once, at the largest
    threshold, and thresholds between which no distance lies share their leaders.
    """
    cuts, limit = sorted({float(t) for t in cuts if t > 0}), LIMITS.pairs_per_row * distinct.rows
    alone = assign_leaders(distinct, 0.0)
    if not cuts or distinct.widest > LIMITS.bucket_rows and candidate_load(distinct, distinct.table, cuts[-1]) > limit:
        return {0.0: alone} | {t: assign_leaders(distinct, t) for t in cuts}
    edges = settle(close_pairs(distinct, thres=cuts[-1]).select("src", "dst", "dist"))
    below = edges.agg(*[F.count(F.when(F.col("dist") < t, 1)) for t in cuts]).first()
    found: dict[int, DataFrame] = {}
    for t, n in zip(cuts, below, strict=True):
        if n not in found:
            found[n] = settle(first_leaders(edges.where(F.col("dist") < t)))
    return {0.0: alone} | {t: found[n] for t, n in zip(cuts, below, strict=True)}


def _solve(distinct: Distinct, rows: DataFrame, thres: float) -> list[DataFrame]:
    """Leaders within ``rows``, which no leader outside them covers.

    If meeting all key partners is affordable, one search finds all edges.
    Otherwise the ids of each group are cut into stretches of growing size.
    The leaders of a stretch depend on it alone; what they cover leaves before
    the next stretch is searched, so a dense region costs its leaders times its
    size instead of its size squared.
    """
    if distinct.widest <= LIMITS.bucket_rows:
        return [settle(first_leaders(close_pairs(distinct, rows, thres=thres)))]
    n = rows.count()
    numbered = settle(with_ordinal(rows, ["id"], distinct.group, "_number"))
    widest = 1 + (numbered.agg(F.max("_number")).first()[0] or 0)
    affordable = candidate_load(distinct, rows, thres) <= LIMITS.pairs_per_row * n
    if widest <= LIMITS.bucket_rows or affordable:
        return [settle(first_leaders(close_pairs(distinct, rows, thres=thres)))]
    parts, start, size = [], 0, LIMITS.bucket_rows
    pending = numbered
    while not is_empty(pending):
        stretch = pending.where(F.col("_number") < start + size).drop("_number")
        later = pending.where(F.col("_number") >= start + size)
        if not is_empty(stretch):
            inside = _solve(distinct, stretch, thres)
            parts.extend(inside)
            followers = union_all(inside).select("id")
            leading = settle(stretch.join(followers, "id", "left_anti"))
            hits = close_pairs(distinct, leading, later.drop("_number"), thres=thres)
            hits = settle(
                hits.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("cluster_id"))
            )
            parts.append(hits)
            later = later.join(hits.select("id"), "id", "left_anti")
        pending = settle(later)
        start += size
        size *= 4
    return parts


def leader_clusters(
    df: DataFrame,
    group: Sequence[str],
    metric: str,
    thres: float,
    on_unequal: str = "raise",
) -> DataFrame:
    """Cluster of every record by leader clustering within its group.

    Records are taken in id order; one joins the earliest leader at distance
    below ``thres``, or becomes a leader. The cluster id is the leader's id,
    which is the smallest in the cluster.
    """
    distinct = distinct_sequences(df, group, metric, on_unequal)
    if thres <= 0:
        number = F.col("id").cast("bigint")
        return df.select(*group, number.alias("id"), number.alias("cluster_id"))
    return restore(df, distinct, assign_leaders(distinct, thres))
