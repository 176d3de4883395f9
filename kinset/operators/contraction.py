"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinset.operators.joins import attach
from kinset.plans.limits import LIMITS
from kinset.plans.session import settle, settle_counted


def components(edges: DataFrame) -> DataFrame:
    """Map each vertex of ``edges(src, dst)`` to the smallest vertex it reaches.

    Contraction rounds: every vertex points to its smallest neighbour, or to
    itself if that is smaller. The pointers form trees whose roots are smaller
    than all their neighbours; following them twice as far each time reaches
    the roots in logarithmically many steps. Each tree becomes its root and the
    edges are rewritten, so at most half of the vertices remain.
    """
    left, n = settle_counted(edges.select("src", "dst").where("src <> dst").distinct())
    rounds = []
    while n > 0:
        ends = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        point = ends.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("_low"))
        point = settle(point.select("id", F.least("id", "_low").alias("root")))
        while True:
            for step in ("_next", "_last"):
                at = "root" if step == "_next" else "_next"
                onward = point.select(F.col("id").alias(at), F.col("root").alias(step))
                hop = attach(point if step == "_next" else hop, onward, [at], 2 * n, "inner", dim_rows=n)
            hop, moving = settle_counted(hop, F.col("_next") != F.col("_last"))
            point = hop.select("id", F.col("_last").alias("root"))
            if moving == 0:
                break
        rounds.append(point)
        for end in ("src", "dst"):
            to = point.select(F.col("id").alias(end), F.col("root").alias("_to"))
            left = attach(left, to, [end], n, "inner", dim_rows=n).drop(end).withColumnRenamed("_to", end)
            if n > LIMITS.plain_join_rows:
                left = settle(left)
        left, n = settle_counted(left.where("src <> dst").distinct())
    if not rounds:
        return left.select(F.col("src").alias("id"), F.col("dst").alias("root"))
    # Later rounds only name what earlier ones led to, so they are smaller.
    final = rounds.pop()
    while rounds:
        here = rounds.pop()
        later = final.select(F.col("id").alias("root"), F.col("root").alias("_last"))
        n = here.count()
        final = attach(here, later, ["root"], n, dim_rows=n).select(
            "id", F.coalesce("_last", "root").alias("root")
        )
    return final
