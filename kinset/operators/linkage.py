"""Agglomerative clustering by rounds of mutual nearest clusters.

Average and complete linkage are reducible: merging two clusters never brings
the result closer to a third one than both were. So all pairs of clusters that
are each other's nearest can be merged at once, and the merges are those that
merging one closest pair at a time would make (Murtagh, 1983). Equal heights
are ordered by (height, smaller id, larger id).

Groups, and components of what is close, that have few clusters are gathered as matrices in one
task each, those that have few close pairs as lists of these (``matrix``); only larger ones take
distributed rounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinset.functions.distance import distance
from kinset.operators.components import components, linked_components, single_linkage
from kinset.operators.copies import Distinct, distinct_sequences, restore
from kinset.operators.dendrogram import tree_merges
from kinset.operators.groups import group_sizes, with_ordinal
from kinset.operators.joins import attach, join_keys
from kinset.operators.matrix import (
    DIGITS, PAIR, RUN, merge_pieces, pack_pairs, solve_edges, solve_letters, solve_packed, solve_profiles, solve_sparse, solve_strings, unpacked,
)
from kinset.operators.mst import mst_edges
from kinset.operators.near import close_pairs, distance_pairs, is_dense, union_all
from kinset.plans.limits import LIMITS
from kinset.plans.session import is_empty, settle, settle_counted

LINKAGES = ("single", "average", "complete")


def _mutual(scored: DataFrame, group: Sequence[str]) -> DataFrame:
    """Edges that are the first choice of both their ends."""
    columns = [*group, "a", "b", "score", "size_a", "size_b"]
    choice = F.struct("score", "rank_a", "rank_b", *[c for c in columns if c != "score"])
    ranked = scored.select(*columns, "rank_a", "rank_b")
    ends = ranked.select(F.col("a").alias("_end"), choice.alias("_edge")).unionByName(
        ranked.select(F.col("b").alias("_end"), choice.alias("_edge"))
    )
    first = ends.groupBy("_end").agg(F.min("_edge").alias("_edge"))
    agreed = first.groupBy("_edge").agg(F.count(F.lit(1)).alias("_votes")).where("_votes = 2")
    return agreed.select(*[F.col(f"_edge.{c}").alias(c) for c in columns])


def _merge_edges(edges: DataFrame, merged: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rewrite ends and sizes of cluster edges after merges; the ends of an edge
    that were merged with each other leave it a loop, which goes."""
    renamed = merged.select("a", "b", (F.col("size_a") + F.col("size_b")).alias("_size"))
    moves = renamed.select(F.col("a").alias("_old"), F.col("a").alias("_new"), "_size").unionByName(
        renamed.select(F.col("b").alias("_old"), F.col("a").alias("_new"), "_size")
    )
    n = edges.count()
    for end in ("a", "b"):
        step = moves.select(
            F.col("_old").alias(end), F.col("_new").alias("_to"), F.col("_size").alias("_grown")
        )
        edges = attach(edges, step, [end], n)
        edges = (
            edges.withColumn(f"size_{end}", F.coalesce("_grown", f"size_{end}"))
            .withColumn(f"_moved_{end}", F.col("_to").isNotNull())
            .withColumn(end, F.coalesce("_to", end))
            .drop("_to", "_grown")
        )
    swap = F.col("a") > F.col("b")
    others = [c for c in edges.columns if c not in ("a", "b", "size_a", "size_b")]
    return edges.where("a <> b").select(
        F.least("a", "b").alias("a"),
        F.greatest("a", "b").alias("b"),
        F.when(swap, F.col("size_b")).otherwise(F.col("size_a")).alias("size_a"),
        F.when(swap, F.col("size_a")).otherwise(F.col("size_b")).alias("size_b"),
        *others,
    )


def _score(linkage: str) -> Column:
    return {
        "average": F.col("total") / (F.col("size_a") * F.col("size_b")),
        "complete": F.col("most"),
        "single": F.col("least"),
    }[linkage]


def agglomerate(
    pairs: DataFrame,
    group: Sequence[str],
    linkage: str = "average",
    thres: float | None = None,
    mode: str = "distance",
) -> DataFrame:
    """Merge table of a distance or similarity table ``pairs(group, src, dst,
    dist)``, with optional ``src_copies`` and ``dst_copies`` as weights.

    One row per merge: ``step`` (from 0 within the group, by height), the
    smallest ids of both clusters, the height and the new size. With ``thres``
    only merges below it (above it for similarities) are made.

    A pair missing from a distance table is too far to merge; a pair missing
    from a similarity table has similarity 0. A merged height is the mean of
    all member pairs (average), the largest (complete) or smallest (single).
    In similarity mode ties go to the larger id.
    """
    if linkage not in LINKAGES:
        raise ValueError(f"linkage must be one of {LINKAGES}, not {linkage!r}")
    if mode not in ("distance", "similarity"):
        raise ValueError(f"mode must be 'distance' or 'similarity', not {mode!r}")
    sign = 1 if mode == "distance" else -1
    one = F.lit(1).cast("bigint")
    weights = [
        F.col(c).cast("bigint") if c in pairs.columns else one for c in ("src_copies", "dst_copies")
    ]
    swap = F.col("src") > F.col("dst")
    value = (F.col("dist") * sign).cast("double")
    n = weights[0] * weights[1]
    plain = pairs.select(
        *group,
        F.xxhash64(*group).alias("_key"),
        F.least("src", "dst").cast("bigint").alias("a"),
        F.greatest("src", "dst").cast("bigint").alias("b"),
        F.when(swap, weights[1]).otherwise(weights[0]).alias("size_a"),
        F.when(swap, weights[0]).otherwise(weights[1]).alias("size_b"),
        ((value * n) if linkage == "average" else value).alias("value"),
    )
    first, rest = [], plain
    if sign < 0 or thres is None:
        # Tables of all pairs. Distances below a threshold are lists of few pairs.
        first, rest = _dense_groups(plain, group, linkage, None if thres is None else sign * thres, sign)
    n, mean = F.col("size_a") * F.col("size_b"), F.col("value")
    edges = settle(rest.select(
        *group, "a", "b", "size_a", "size_b", mean.alias("total"), mean.alias("most"), mean.alias("least"), n.alias("n")
    ))
    rounds, edges = _small_pieces(edges, group, linkage, None if thres is None else sign * thres, sign)
    rounds, number = [*first, *rounds], 0
    while not is_empty(edges):
        scored = edges.withColumn("score", F.round(_score(linkage), DIGITS))
        if thres is not None:
            scored = scored.where(F.col("score") < sign * thres)
        order = (F.col("a"), F.col("b")) if sign > 0 else (-F.col("b"), -F.col("a"))
        scored = scored.withColumn("rank_a", order[0]).withColumn("rank_b", order[1])
        merged, n_merged = settle_counted(_mutual(scored, group))
        if n_merged == 0:
            break
        rounds.append(merged.withColumn("_round", F.lit(number)))
        number += 1
        moved = _merge_edges(edges, merged, group)
        edges = moved.groupBy(*group, "a", "b", "size_a", "size_b").agg(
            F.sum("total").alias("total"),
            F.max("most").alias("most"),
            F.min("least").alias("least"),
            F.sum("n").alias("n"),
        )
        if sign > 0 and linkage != "single":
            # A missing member pair is too far, and stays so in any union.
            edges = edges.where(F.col("n") == F.col("size_a") * F.col("size_b"))
        edges = settle(edges)
    return _merge_table(rounds, group, sign)


def _dense_groups(
    plain: DataFrame, group: Sequence[str], linkage: str, limit: float | None, sign: int
) -> tuple[list[DataFrame], DataFrame]:
    """The merges of the groups that have packed pairs and fit in a matrix, and the pairs of the others.

    A table of all pairs grows with the square of a group. Its rows are packed where they arise, some
    million to a row and about a byte each, so that only these are written and moved; a task then fills the matrix of a
    group from them. Groups without packed pairs, and those above ``LIMITS.dense_cells``, stay rows.
    """
    most, least = LIMITS.packed_pairs, LIMITS.packed_least
    fields = ", ".join(f"`{c}` {t}" for c, t in plain.dtypes)
    runs, n = settle_counted(plain.mapInArrow(lambda batches: pack_pairs(batches, most, least), f"{fields}, {RUN}"))
    runs = runs.withColumn("_all", F.lit(0))
    keys, packed = [*group, "_all"], F.col("_pairs").isNotNull()
    some = settle(runs.where(packed).select(*keys).distinct())
    rows = runs.select(*plain.columns)
    if is_empty(some):
        return [], rows
    mine = attach(runs, some, keys, n, "inner")
    ends = mine.select(*keys, F.explode(F.coalesce("_ends", F.array("a", "b"))).alias("_v")).distinct()
    sizes = ends.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("piece"))
    sizes = settle(sizes.withColumn("_fits", F.col("_n") * F.col("_n") <= LIMITS.dense_cells))
    fits = sizes.where("_fits").select(*keys, "piece")
    solved = attach(runs, fits, keys, n, "inner").select("piece", *PAIR, "_pairs")
    merges = settle(merge_pieces(solved, solve_packed(linkage, limit, sign < 0)))
    found = attach(merges, fits.drop("_all"), ["piece"], n, "inner").drop("piece")
    others = join_keys(runs, fits, keys, "left_anti")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                columns, row = unpacked(batch.column("_pairs")[i].as_buffer()), batch.slice(i, 1)
                for at in range(0, len(columns[0]), 10_000):
                    part = [pa.array(x[at : at + 10_000]) for x in columns]
                    same = pa.array(np.zeros(len(part[0]), np.int32))
                    yield pa.RecordBatch.from_arrays([*[row.column(c).take(same) for c in kept], *part], names=[*kept, *PAIR])

    kept = [*group, "_key"]
    loose = others.where(~packed).select(*plain.columns)
    again = others.where(packed).select(*kept, "_pairs").mapInArrow(unpack, fields)
    return [settle(found)], loose.unionByName(again)


def _small_pieces(
    edges: DataFrame, group: Sequence[str], linkage: str, limit: float | None, sign: int
) -> tuple[list[DataFrame], DataFrame]:
    """The merges of small pieces, and the edges of the others.

    A group with few clusters is a piece, as is one with few distances; of others, the components are.
    """
    value = {"average": "total", "complete": "most", "single": "least"}[linkage]
    placed, n = settle_counted(edges.withColumn("_all", F.lit(0)))
    nothing = edges.where(F.lit(False)).withColumns({"score": F.lit(0.0), "_round": F.lit(0)})
    found, pieces = [nothing.select(*group, "a", "b", "score", "size_a", "size_b", "_round")], None
    for by in ("group", "component"):
        keys = [*group, "_all"] if by == "group" else [*group, "_all", "piece"]
        ends = placed.select(*keys, F.col("a").alias("_v")).unionByName(placed.select(*keys, F.col("b").alias("_v")))
        sizes = ends.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_first"), (F.sum("_c") / 2).alias("_edges")
        )
        sizes = settle(sizes)
        fits = F.col("_n") * F.col("_n") <= LIMITS.matrix_cells
        few = ~fits & (F.col("_edges") <= LIMITS.piece_edges) if sign > 0 else F.lit(False)
        named = settle(sizes.select(*group, F.col("_first").alias("piece")))
        for which, solve in ((fits, solve_edges(linkage, limit, sign < 0)), (few, solve_sparse(linkage, limit))):
            some = settle(sizes.where(which).select(*keys, "_first"))
            if is_empty(some):
                continue
            mine = attach(placed, some, keys, n, "inner").select(F.col("_first").alias("piece"), "a", "b", "size_a", "size_b", F.col(value).alias("value"))
            # Settled first, as a join by hot keys reads its rows more than once.
            merges = settle(merge_pieces(mine, solve))
            found.append(settle(attach(merges, named, ["piece"], n, "inner").drop("piece")))
        large = settle(sizes.where(~fits & ~few).select(*keys))
        if is_empty(large):
            placed = placed.where(F.lit(False))
            break
        placed, n = settle_counted(attach(placed, large, keys, n, "inner"))
        if by == "group":
            pieces = components(placed.select(F.col("a").alias("src"), F.col("b").alias("dst")))
            pieces = settle(pieces.select(F.col("id").alias("a"), F.col("root").alias("piece")))
            placed, n = settle_counted(attach(placed, pieces, ["a"], n, "inner"))
    return found, placed.select(*edges.columns)


def _merge_table(
    rounds: list[DataFrame], group: Sequence[str], sign: int = 1
) -> DataFrame:
    columns = [
        *group, "left_id", "right_id", "height", "size", "_order", "_round", "_tie_a", "_tie_b",
    ]
    merges = union_all(rounds).select(
        *group,
        F.col("a").alias("left_id"),
        F.col("b").alias("right_id"),
        (F.col("score") * sign).alias("height"),
        (F.col("size_a") + F.col("size_b")).alias("size"),
        # Rounding keeps sums taken in another order from changing the order.
        F.round("score", DIGITS).alias("_order"),
        "_round",
        (F.col("a") if sign > 0 else -F.col("b")).alias("_tie_a"),
        (F.col("b") if sign > 0 else -F.col("a")).alias("_tie_b"),
    )
    numbered = with_ordinal(
        merges.select(*columns), ["_order", "_round", "_tie_a", "_tie_b"], group, "step"
    )
    return numbered.select(*group, "step", "left_id", "right_id", "height", "size")


def linkage_merges(
    df: DataFrame,
    group: Sequence[str],
    metric: str,
    linkage: str = "average",
) -> DataFrame:
    """Complete merge table of the records of each group.

    Copies are merged first, at height 0. Average linkage under the Hamming metric works by letter
    counts in groups that one task holds. The others need the distance table; large ones are a
    case for ``two_stage`` or a threshold.
    """
    if linkage == "average" and metric == "hamming":
        distinct = distinct_sequences(df, group, metric)
        table = distinct.table.withColumn("_all", F.lit(0))
        keys = [*group, "_all"]
        sizes = settle(table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("piece")))
        placed = settle(attach(table, sizes, keys, distinct.rows, "inner"))
        rounds, large = _pieces_by_letters(distinct, placed, None)
        merges = _merge_table(rounds, group)
        large = settle(large.select(*group, "id", "seq", "copies"))
        if not is_empty(large):
            pairs = distance_pairs(large, group, metric).drop("src_copies", "dst_copies")
            for end in ("src", "dst"):
                weight = large.select(F.col("id").alias(end), F.col("copies").alias(f"{end}_copies"))
                pairs = pairs.join(weight, end)
            merges = merges.unionByName(agglomerate(pairs, group, linkage))
    else:
        merges = agglomerate(distance_pairs(df, group, metric), group, linkage)
        distinct = distinct_sequences(df, group, metric)
    own = distinct.table.select(*group, "seq", F.col("id").alias("left_id"))
    copies = distinct.attach_to(df.select(*group, "id", "seq"), own, "inner")
    copies = copies.where("id <> left_id")
    copies = with_ordinal(
        copies.select(*group, "left_id", F.col("id").cast("bigint").alias("right_id")),
        ["left_id", "right_id"], group, "step",
    )
    copies = with_ordinal(copies, ["right_id"], [*group, "left_id"], "_nth")
    copies = copies.select(
        *group, "step", "left_id", "right_id", F.lit(0.0).alias("height"),
        (F.col("_nth") + 2).alias("size"),
    )
    extra = copies.withColumn("_all", F.lit(0)).groupBy(*group, "_all").agg(
        F.count(F.lit(1)).alias("_first")
    )
    shifted = attach(merges.withColumn("_all", F.lit(0)), extra, [*group, "_all"], distinct.rows)
    shifted = shifted.withColumn("step", F.col("step") + F.coalesce("_first", F.lit(0)))
    return copies.unionByName(shifted.select(*copies.columns))


def cut_merges(
    df: DataFrame,
    group: Sequence[str],
    merges: DataFrame,
    k: int | None = None,
    thres: float | None = None,
) -> DataFrame:
    """Members after the lowest merges: down to ``k`` clusters per group, or all
    merges with height below ``thres``."""
    if (k is None) == (thres is None):
        raise ValueError("give either k or thres")
    if thres is not None:
        kept = merges.where(F.col("height") < thres)
    else:
        sizes = group_sizes(df.withColumn("_all", F.lit(0)), [*group, "_all"])
        rows = df.count()
        kept = attach(merges.withColumn("_all", F.lit(0)), sizes, [*group, "_all"], rows, "inner")
        kept = kept.where(F.col("step") < F.col("n") - k)
    roots = components(kept.select(F.col("left_id").alias("src"), F.col("right_id").alias("dst")))
    records = df.select(*group, F.col("id").cast("bigint").alias("id"))
    placed = join_keys(records, roots, ["id"], "left")
    return placed.select(*group, "id", F.coalesce("root", "id").alias("cluster_id"))


def _profile_totals(touched: DataFrame, profiles: DataFrame) -> DataFrame:
    """Mismatches summed over all member pairs of the clusters ``(a, b)``.

    Two clusters agree at a position as often as the products of their letter
    counts there add up to, so no member pair has to be looked at.
    """
    first = profiles.select(
        F.col("cluster").alias("a"), "pos", "letter", F.col("count").alias("_in_a")
    )
    second = profiles.select(
        F.col("cluster").alias("b"), "pos", "letter", F.col("count").alias("_in_b")
    )
    joined = touched.select("a", "b").join(first, "a").join(second, ["b", "pos", "letter"])
    return joined.groupBy("a", "b").agg(
        F.sum(F.col("_in_a") * F.col("_in_b")).alias("_agreements")
    )


def _components_of(distinct: Distinct, thres: float) -> DataFrame:
    """The distinct sequences that have company below ``thres``, with the component and its size."""
    linked = linked_components(distinct, thres).withColumnRenamed("cluster_id", "piece")
    placed = settle(join_keys(distinct.table, linked, ["id"], "inner"))
    sizes = placed.groupBy("piece").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return settle(attach(placed, settle(sizes), ["piece"], distinct.rows, "inner"))


def _with_groups(merges: DataFrame, placed: DataFrame, group: Sequence[str], rows: int) -> DataFrame:
    """Merges of pieces with the group columns, which a piece's first sequence has."""
    named = placed.where("id = piece").select("piece", *group)
    return settle(attach(settle(merges), settle(named), ["piece"], rows, "inner").drop("piece"))


def average_below(distinct: Distinct, thres: float) -> DataFrame:
    """Average-linkage merges below ``thres`` under the Hamming metric.

    The mean over member pairs is below ``thres`` only if some member pair is, so clusters merge
    within the components of the close pairs. A component of few sequences is one matrix of
    mismatches. In a larger one the pairs of clusters to consider come from the close pairs and
    their means from letter counts, so its distance table is never needed. A large group in which few
    pairs are close is one piece, without looking for its components.
    """
    rounds = []
    if distinct.widest > LIMITS.bucket_rows and not is_dense(distinct, distinct.table, thres):
        rounds, rest = _groups_by_links(distinct, thres)
        rest, n = settle_counted(rest)
        if n == 0:
            return _merge_table(rounds, distinct.group)
        distinct = replace(distinct, table=rest, rows=n)
    placed = _components_of(distinct, thres)
    found, large = _pieces_by_letters(distinct, placed, thres)
    rounds += found
    large, n = settle_counted(large)
    if n:
        rounds += _average_rounds(replace(distinct, table=large, rows=n), thres)
    return _merge_table(rounds, distinct.group)


def _groups_by_links(distinct: Distinct, thres: float) -> tuple[list[DataFrame], DataFrame]:
    """Average-linkage merges of the groups with few close pairs, and the sequences of the other groups.

    The strings of a group that have company and its close pairs go to one task. Strings of several
    lengths are several pieces.
    """
    keys = [*distinct.group, "_len"]
    near = close_pairs(distinct, distinct.table.withColumn("len", F.length("seq")), thres=thres, carry=("len",))
    near, n = settle_counted(near.select(*distinct.group, F.col("src_len").alias("_len"), "src", "dst"))
    ends = near.select(F.col("src").alias("id")).unionByName(near.select(F.col("dst").alias("id"))).distinct()
    strings, rows = settle_counted(join_keys(distinct.table.withColumn("_len", F.length("seq")), ends, ["id"], "left_semi"))
    letters = strings.select(*keys, F.posexplode(F.split("seq", "")).alias("_at", "_letter")).distinct()
    pieces = join_keys(
        join_keys(
            strings.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("piece")),
            letters.groupBy(*keys).agg(F.count(F.lit(1)).alias("_kinds")), keys, "inner",
        ),
        near.groupBy(*keys).agg(F.count(F.lit(1)).alias("_edges")), keys, "inner",
    )
    fits = (F.col("_edges") <= LIMITS.piece_edges) & (F.col("_n") * F.col("_kinds") <= LIMITS.profile_cells)
    pieces = settle(pieces.select(*keys, "piece", fits.alias("_fits")))
    mine = pieces.where("_fits").select(*keys, "piece")
    linked = attach(strings, mine, keys, rows, "inner").select("piece", F.col("id").alias("a"), F.col("id").alias("b"), "copies", "seq")
    pairs = attach(near, mine, keys, n, "inner").select(
        "piece", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).cast("bigint").alias("copies"), F.lit(None).cast("string").alias("seq")
    )
    merges = settle(merge_pieces(linked.unionByName(pairs), solve_letters(thres)))
    found = settle(attach(merges, mine.select("piece", *distinct.group), ["piece"], rows, "inner").drop("piece"))
    others = pieces.where("not _fits").select(*keys)
    rest = attach(strings, others, keys, rows, "inner").select(*distinct.table.columns)
    return [found], rest


def _pieces_by_letters(distinct: Distinct, placed: DataFrame, limit: float | None) -> tuple[list[DataFrame], DataFrame]:
    """Average-linkage merges of pieces of strings of one length, and the sequences of those too large.

    ``placed`` is the table of distinct sequences with ``piece``, its smallest id, and ``_n``, its
    size. A few sequences are one matrix of mismatches, more are merged by letter counts.
    """
    columns = ["piece", "id", "copies", "seq"]
    small = F.col("_n") * F.col("_n") <= LIMITS.matrix_cells
    rounds = [merge_pieces(placed.where(small).select(*columns), solve_strings(limit))]
    rest, n = settle_counted(placed.where(~small))
    if n:
        letters = rest.where(F.col("_n") <= LIMITS.profile_rows).select(
            "piece", "_n", F.posexplode(F.split("seq", "")).alias("_at", "_letter")
        ).distinct()
        cells = letters.groupBy("piece").agg((F.first("_n") * F.count(F.lit(1))).alias("_cells"))
        fits = settle(cells.where(F.col("_cells") <= LIMITS.profile_cells).select("piece", F.lit(True).alias("_fits")))
        rest = settle(attach(rest, fits, ["piece"], n))
        rounds.append(merge_pieces(rest.where("_fits").select(*columns), solve_profiles(limit)))
        rest = rest.where("_fits is null")
    found = [_with_groups(r, placed, distinct.group, distinct.rows) for r in rounds]
    return found, rest.select(*distinct.table.columns)


def _average_rounds(distinct: Distinct, thres: float) -> list[DataFrame]:
    """Rounds of average linkage below ``thres`` by letter counts."""
    group = distinct.group
    copies = F.col("src_copies") * F.col("dst_copies")
    near = close_pairs(distinct, thres=thres, carry=("copies", "len"),
                       left=distinct.table.withColumn("len", F.length("seq")))
    edges = settle(
        near.select(
            *group,
            F.col("src").alias("a"),
            F.col("dst").alias("b"),
            F.col("src_copies").alias("size_a"),
            F.col("dst_copies").alias("size_b"),
            F.col("src_len").cast("bigint").alias("len"),
            (F.round(F.col("dist") * F.col("src_len")).cast("bigint") * copies).alias("total"),
        )
    )
    involved = edges.select(F.col("a").alias("id")).unionByName(
        edges.select(F.col("b").alias("id"))
    ).distinct()
    profiles = settle(
        distinct.table.join(involved, "id")
        .select(
            F.col("id").alias("cluster"),
            F.posexplode(F.split("seq", "")).alias("pos", "letter"),
            F.col("copies").alias("count"),
        )
    )
    pairs = F.col("size_a") * F.col("size_b")
    mean = F.col("total").cast("double") / (F.col("len") * pairs)
    rounds = []
    while True:
        scored = edges.withColumn("score", mean).where(F.col("score") < thres)
        scored = scored.withColumn("rank_a", F.col("a")).withColumn("rank_b", F.col("b"))
        merged, n_merged = settle_counted(_mutual(scored, group))
        if n_merged == 0:
            break
        rounds.append(merged.withColumn("_round", F.lit(len(rounds))))
        moved = _merge_edges(edges, merged, group)
        moved = settle(
            moved.groupBy(*group, "a", "b", "size_a", "size_b", "len").agg(
                F.max("total").alias("total"),
                F.bool_or(F.col("_moved_a") | F.col("_moved_b")).alias("_touched"),
            )
        )
        to = merged.select(F.col("b").alias("cluster"), F.col("a").alias("_to"))
        profiles = attach(profiles, to, ["cluster"], profiles.count())
        profiles = settle(
            profiles.groupBy(F.coalesce("_to", "cluster").alias("cluster"), "pos", "letter").agg(
                F.sum("count").alias("count")
            )
        )
        touched = moved.where("_touched").drop("total", "_touched")
        agreements = _profile_totals(touched, profiles)
        fresh = touched.join(agreements, ["a", "b"], "left").withColumn(
            "total", F.col("len") * pairs - F.coalesce("_agreements", F.lit(0))
        )
        edges = moved.where("not _touched").drop("_touched").unionByName(
            fresh.drop("_agreements")
        )
        edges = settle(edges)
    return rounds


def average_edit_below(distinct: Distinct, thres: float, measured: list[int] | None = None) -> DataFrame:
    """Average-linkage merges below ``thres`` under the edit metric.

    Clusters merge within the components of the close pairs. In a component of few sequences all
    pairs are measured. In a larger one bounds decide what is measured: a pair that the search
    for close pairs has not found is at least ``thres`` apart, and distances are whole numbers. So
    the mean over two clusters is at least that of the known distances and ceil(thres) for
    each other pair. Known sums and counts add up when clusters merge. In rounds, the pairs of
    clusters that are each other's first choice by these bounds are looked at: if all their member
    pairs are known, no other pair can be nearer and they merge; if not, they are measured. Pairs of
    clusters whose bound reaches ``thres`` are never measured. ``measured`` receives the numbers
    of pairs measured.
    """
    group, measured = distinct.group, [] if measured is None else measured
    placed = _components_of(distinct, thres)
    few = F.col("_n") <= LIMITS.measured_whole
    small, n = settle_counted(placed.where(few))
    rounds = []
    if n:
        pairs, n_pairs = settle_counted(_weighted_pairs(small.withColumnRenamed("piece", "comp"), "edit"))
        measured.append(n_pairs)
        value = F.col("dist") * F.col("src_copies") * F.col("dst_copies")
        rows = pairs.select(F.col("comp").alias("piece"), F.col("src").alias("a"), F.col("dst").alias("b"),
                            F.col("src_copies").alias("size_a"), F.col("dst_copies").alias("size_b"), value.alias("value"))
        rounds.append(_with_groups(merge_pieces(rows, solve_edges("average", thres, False)), small, group, n))
    large, n = settle_counted(placed.where(~few).select(*distinct.table.columns))
    if n:
        rounds += _bounded_rounds(replace(distinct, table=large, rows=n), thres, measured)
    if not rounds:
        none = placed.where(F.lit(False)).select(*group, F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("score"),
                                                 F.col("copies").alias("size_a"), F.col("copies").alias("size_b"))
        rounds = [none.withColumn("_round", F.lit(0))]
    return _merge_table(rounds, group)


def _bounded_rounds(distinct: Distinct, thres: float, measured: list[int]) -> list[DataFrame]:
    group, apart = distinct.group, float(ceil(thres))
    weight = F.col("src_copies") * F.col("dst_copies")
    near = close_pairs(distinct, thres=thres, carry=("copies",))
    edges = settle(near.select(
        *group, F.col("src").alias("a"), F.col("dst").alias("b"),
        F.col("src_copies").alias("size_a"), F.col("dst_copies").alias("size_b"),
        (F.col("dist") * weight).alias("total"), weight.alias("known"),
    ))
    members = distinct.table.select(F.col("id").alias("cluster"), "seq", "copies")
    pairs = F.col("size_a") * F.col("size_b")
    rounds, number = [], 0
    while True:
        bound = (F.col("total") + F.lit(apart) * (pairs - F.col("known"))) / pairs
        scored = edges.withColumn("score", F.round(bound, DIGITS)).where(F.col("score") < thres)
        scored = scored.withColumn("rank_a", F.col("a")).withColumn("rank_b", F.col("b"))
        first = settle(_mutual(scored, group).join(edges.select("a", "b", "known"), ["a", "b"]))
        sure = F.col("known") == pairs
        open_, n_open = settle_counted(first.where(~sure).select("a", "b"))
        if n_open:
            x, y = (members.select(F.col("cluster").alias(c), F.col("seq").alias(f"_{c}"), F.col("copies").alias(f"_n{c}")) for c in ("a", "b"))
            dist = F.when(F.col("_a") == F.col("_b"), F.lit(0.0)).otherwise(distance("edit", "_a", "_b"))
            each = open_.join(x, "a").join(y, "b").select("a", "b", (dist * F.col("_na") * F.col("_nb")).alias("d"))
            exact, n_pairs = settle_counted(each.groupBy("a", "b").agg(F.sum("d").alias("_total"), F.count(F.lit(1)).alias("_m")))
            measured.append(exact.agg(F.coalesce(F.sum("_m"), F.lit(0))).first()[0])
            edges = edges.join(exact.drop("_m"), ["a", "b"], "left").withColumn("known", F.when(F.col("_total").isNull(), F.col("known")).otherwise(pairs))
            edges = edges.withColumn("total", F.coalesce("_total", "total")).drop("_total")
            edges = settle(edges.select(*group, "a", "b", "size_a", "size_b", "total", "known"))
        merged, n_merged = settle_counted(first.where(sure).drop("known"))
        if n_merged == 0 and n_open == 0:
            return rounds
        if n_merged == 0:
            continue
        rounds.append(merged.withColumn("_round", F.lit(number)))
        number += 1
        moved = _merge_edges(edges, merged, group)
        edges = settle(moved.groupBy(*group, "a", "b", "size_a", "size_b").agg(F.sum("total").alias("total"), F.sum("known").alias("known")))
        to = merged.select(F.col("b").alias("cluster"), F.col("a").alias("_to"))
        members = attach(members, to, ["cluster"], distinct.rows)
        members = settle(members.withColumn("cluster", F.coalesce("_to", "cluster")).drop("_to"))


def merges_below(distinct: Distinct, df: DataFrame, thres: float, linkage: str) -> DataFrame:
    """Merge table of the distinct sequences below ``thres`` by any linkage, copies as weights."""
    if linkage not in LINKAGES:
        raise ValueError(f"linkage must be one of {LINKAGES}, not {linkage!r}")
    if linkage == "single":
        forest = mst_edges(distinct.table.select(*distinct.group, "id", "seq"), distinct.group, distinct.metric, thres)
        return tree_merges(forest, distinct.group)
    if linkage == "complete":
        return agglomerate(close_pairs(distinct, thres=thres, carry=("copies",)), distinct.group, "complete", thres)
    return average_below(distinct, thres) if distinct.metric == "hamming" else average_edit_below(distinct, thres)


def linkage_clusters(
    df: DataFrame,
    group: Sequence[str],
    metric: str,
    thres: float,
    linkage: str = "single",
    on_unequal: str = "raise",
) -> DataFrame:
    """Cluster of every record by hierarchical clustering cut at ``thres``.

    Single and complete linkage need the close pairs only, average linkage under
    Hamming the close pairs and letter counts, and under the edit metric those
    distances that bounds do not settle.
    """
    if linkage not in LINKAGES:
        raise ValueError(f"linkage must be one of {LINKAGES}, not {linkage!r}")
    if linkage == "single" or thres <= 0:
        return single_linkage(df, group, metric, thres, on_unequal)
    distinct = distinct_sequences(df, group, metric, on_unequal)
    merges = merges_below(distinct, df, thres, linkage)
    roots = components(merges.select(F.col("left_id").alias("src"), F.col("right_id").alias("dst")))
    return restore(df, distinct, roots.withColumnRenamed("root", "cluster_id"))


def _weighted_pairs(placed: DataFrame, metric: str) -> DataFrame:
    """Distances within components, weighted by the copies already counted."""
    pairs = distance_pairs(placed, ["comp"], metric)
    weights = placed.select("id", "copies")
    for end in ("src", "dst"):
        side = weights.select(F.col("id").alias(end), F.col("copies").alias(f"_{end}"))
        pairs = pairs.join(side, end).drop(f"{end}_copies").withColumnRenamed(
            f"_{end}", f"{end}_copies"
        )
    return pairs
