"""Connected components, and single linkage as components of the close pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinset.operators.contraction import components
from kinset.operators.copies import Distinct, distinct_sequences, restore
from kinset.operators.joins import attach, join_keys
from kinset.operators.leader import assign_leaders
from kinset.operators.near import close_pairs, is_dense, union_all
from kinset.operators.signatures import Masks, masks_for
from kinset.plans.session import settle


# Windows that follow each other in one plan.
CHAINED = 4


def linked_by_masks(distinct: Distinct, masks: Masks) -> DataFrame:
    """``(id, cluster_id)``: the component of each distinct sequence among the close pairs.

    Mask by mask, each sequence takes the smallest name among those that are equal under it. A
    sequence that changes its name links the two names; the components of these links are those
    of the sequences. What grows is one window over the table for each mask, however many pairs are close.
    """
    group = list(distinct.group)
    now = distinct.table.select(
        *group, "id", F.length("seq").alias("_len"), masks.varying("seq").alias("_text"), F.col("id").alias("_name")
    )
    links = []
    for first in range(0, masks.most, CHAINED):
        names = [F.col("_name")]
        for i, slot in enumerate(range(first, min(first + CHAINED, masks.most))):
            now = now.withColumn("_key", masks.shown(slot, "_text"))
            # The hash comes first, as it sorts fast.
            same = Window.partitionBy(F.xxhash64("_key", *group), "_key", "_len", *group)
            now = now.withColumn(f"_name{i}", F.min(names[-1]).over(same))
            names.append(F.col(f"_name{i}"))
        now = settle(now.drop("_key"))
        steps = F.array(*[F.struct(y.alias("src"), x.alias("dst")) for x, y in zip(names, names[1:])])
        changed = now.select(F.explode(F.filter(steps, lambda s: s["src"] != s["dst"])).alias("s"))
        links.append(changed.select("s.src", "s.dst").distinct())
        now = now.select(*group, "id", "_len", "_text", names[-1].alias("_name"))
    named = now.select("id", F.col("_name").alias("comp"))
    if not links:
        return named.select("id", F.col("comp").alias("cluster_id"))
    roots = settle(components(union_all(links)).select(F.col("id").alias("comp"), "root"))
    joined = attach(named, roots, ["comp"], distinct.rows)
    return joined.select("id", F.coalesce("root", "comp").alias("cluster_id"))


def linked_components(distinct: Distinct, thres: float) -> DataFrame:
    """Single-linkage cluster of each distinct sequence that has company.

    Where many sequences lie close together the close pairs grow with the
    square of their number, though a few links would do. Such inputs are
    condensed to leaders first (each sequence is within ``thres`` of its
    leader, which is a link); after that only pairs that join two different
    leaders' clusters are looked for. Where few places vary, masks give the
    links without any pairs.
    """
    if thres <= 0:
        return distinct.table.select("id", F.col("id").alias("cluster_id")).where(F.lit(False))
    masks = masks_for(distinct, thres)
    if masks is not None:
        return linked_by_masks(distinct, masks)
    if not is_dense(distinct, distinct.table, thres):
        roots = components(close_pairs(distinct, thres=thres))
        return roots.select("id", F.col("root").alias("cluster_id"))
    led = assign_leaders(distinct, thres).withColumnRenamed("cluster_id", "_leader")
    marked = settle(
        join_keys(distinct.table, led, ["id"], "left")
        .withColumn("comp", F.coalesce("_leader", "id"))
        .drop("_leader")
    )
    bridges = close_pairs(distinct, marked, thres=thres, comp=True, links_only=True)
    roots = components(bridges.select(F.col("src_comp").alias("src"), F.col("dst_comp").alias("dst")))
    roots = roots.select(F.col("id").alias("comp"), "root")
    joined = attach(marked.select("id", "comp"), roots, ["comp"], distinct.rows)
    return joined.select("id", F.coalesce("root", "comp").alias("cluster_id"))


def single_linkage(
    df: DataFrame, group: Sequence[str], metric: str, thres: float, on_unequal: str = "raise"
) -> DataFrame:
    """Cluster of every record: the components of {distance < ``thres``} in its
    group, which is a minimum spanning tree cut at ``thres``.

    The cluster id is the smallest member id.
    """
    distinct = distinct_sequences(df, group, metric, on_unequal)
    if thres <= 0:
        return _singletons(df, group)
    return restore(df, distinct, linked_components(distinct, thres))


def _singletons(df: DataFrame, group: Sequence[str]) -> DataFrame:
    number = F.col("id").cast("bigint")
    return df.select(*group, number.alias("id"), number.alias("cluster_id"))
