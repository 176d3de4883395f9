"""Whole jobs: one method over all groups, methods by a given column, sweeps over
thresholds, methods side by side."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinset.operators.components import components, single_linkage
from kinset.operators.condense import Leaves, condense, two_stage
from kinset.operators.copies import Distinct, distinct_sequences
from kinset.operators.groups import top_groups
from kinset.operators.joins import attach
from kinset.operators.labels import cluster_counts
from kinset.operators.leader import leader_clusters
from kinset.operators.linkage import linkage_clusters
from kinset.operators.mst import mst_edges
from kinset.operators.near import close_pairs, is_dense, union_all
from kinset.plans.session import settle, settle_counted

METHODS: dict[str, Callable[..., DataFrame]] = {
    "mst": single_linkage,
    "linkage": linkage_clusters,
    "leader": leader_clusters,
    "condense": condense,
    "two_stage": two_stage,
}

# The job's numeric method codes.
METHOD_CODES = {1: "mst", 2: "linkage", 3: "two_stage"}


def run_method(
    method: str, df: DataFrame, group: Sequence[str], metric: str, thres: float, **options
) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"method must be one of {sorted(METHODS)}, not {method!r}")
    if method == "condense":
        # For this method alone the threshold is the cut of the summaries.
        return condense(df, group, metric, cut=thres, **options)
    return METHODS[method](df, group, metric, thres, **options)


def route_groups(
    df: DataFrame,
    group: Sequence[str],
    metric: str,
    thres: float,
    route: str,
    methods: Sequence[str],
    options: dict[str, dict] | None = None,
) -> DataFrame:
    """Cluster each group by the method that its column ``route`` names.

    ``methods`` lists the methods in use; every record of a group must carry the
    same one of them.
    """
    for method in methods:
        if method not in METHODS:
            raise ValueError(f"method must be one of {sorted(METHODS)}, not {method!r}")
    named = F.col(route).isin(*methods)
    checked = F.when(named, F.col(route)).otherwise(F.raise_error(F.lit("no such method among methods")))
    routed = settle(df.select(*group, "id", "seq", checked.alias("_route")))
    parts = []
    for method in methods:
        mine = routed.where(F.col("_route") == method).select(*group, "id", "seq")
        parts.append(
            run_method(method, mine, group, metric, thres, **(options or {}).get(method, {}))
        )
    return union_all(parts)


def cluster_groups(
    df: DataFrame,
    group: Sequence[str],
    method: str | int = "mst",
    metric: str = "hamming",
    thres: float = 0.15,
    options: dict[str, dict] | None = None,
) -> DataFrame:
    """Cluster all groups of a table by one method: ``mst`` (1), ``linkage`` (2)
    or ``two_stage`` (3), whatever their sizes. ``options`` holds further
    arguments of the methods by name."""
    method = METHOD_CODES.get(method, method) if isinstance(method, int) else method
    if method not in METHOD_CODES.values():
        raise ValueError(f"method must be 1, 2, 3 or one of {list(METHOD_CODES.values())}")
    return run_method(method, df, group, metric, thres, **(options or {}).get(method, {}))


# Thresholds of the sweep.
SWEEP = (0.03, 0.06, 0.09, 0.12, 0.15)


def threshold_sweep(
    df: DataFrame,
    group: Sequence[str],
    metric: str,
    cuts: Sequence[float] = SWEEP,
    method: str = "linkage",
    inner: float = 0.02,
) -> DataFrame:
    """Number of clusters over all groups at each threshold.

    ``linkage`` searches the close pairs at the largest threshold once. Going
    up the thresholds, the components below each are merged into single
    vertices, so every step works on what the smaller ones left. Where close
    pairs are dense, the spanning forest is built instead: with e edges below a
    threshold it leaves records - e clusters. ``condense`` builds the leaves at
    ``inner`` once and coarsens them at every cut.
    """
    spark = df.sparkSession
    steps = spark.createDataFrame([(float(t),) for t in cuts], "thres double")
    if method == "linkage":
        records = df.count()
        distinct = distinct_sequences(df, group, metric)
        if max(cuts) > 0 and is_dense(distinct, distinct.table, max(cuts)):
            forest = mst_edges(df, group, metric, max(cuts))
            # One row per distinct height, at most one per possible distance.
            heights = forest.groupBy("dist").agg(F.count(F.lit(1)).alias("_edges"))
            counted = (
                steps.join(heights, heights["dist"] < steps["thres"], "left")
                .groupBy("thres")
                .agg(F.coalesce(F.sum("_edges"), F.lit(0)).alias("_edges"))
            )
            return counted.select(
                "thres", (F.lit(records).cast("bigint") - F.col("_edges")).alias("clusters")
            )
        return _sweep_counts(distinct, records, sorted(set(cuts)))
    if method != "condense":
        raise ValueError(f"method must be 'linkage' or 'condense', not {method!r}")
    leaves = Leaves(df, group, metric, inner)
    # Records outside any leaf (no sequence) are clusters of their own.
    alone = df.count() - leaves.distinct.records
    counts, n = [], leaves.centres.count()
    led = leaves.followers_at([t for t in cuts if t > inner])
    for t in map(float, cuts):
        counts.append((t, n + alone - (led[t].count() if t > max(inner, 0) else 0)))
    return spark.createDataFrame(counts, "thres double, clusters bigint")


def _sweep_counts(distinct: Distinct, records: int, cuts: Sequence[float]) -> DataFrame:
    spark = distinct.table.sparkSession
    clusters, counts = records - distinct.records + distinct.rows, []
    edges, n = None, 0
    for t in cuts:
        if t <= 0:
            counts.append((float(t), records))
            continue
        if edges is None:
            close = close_pairs(distinct, thres=max(cuts)).select("src", "dst", "dist")
            edges, n = settle_counted(close)
        roots, merged = settle_counted(
            components(edges.where(F.col("dist") < t)), F.col("id") != F.col("root")
        )
        clusters -= merged
        counts.append((float(t), clusters))
        later = edges.where(F.col("dist") >= t)
        for end in ("src", "dst"):
            to = roots.select(F.col("id").alias(end), "root")
            later = attach(later, to, [end], n)
            later = later.withColumn(end, F.coalesce("root", end)).drop("root")
        edges, n = settle_counted(later.where("src <> dst"))
    return spark.createDataFrame(counts, "thres double, clusters bigint")


def compare_methods(
    df: DataFrame,
    group: Sequence[str],
    metric: str,
    thres: float,
    k: int = 10,
    methods: Sequence[str] = ("mst", "linkage", "condense", "two_stage"),
    options: dict[str, dict] | None = None,
) -> DataFrame:
    """Members of the ``k`` largest groups under several methods, with a
    ``method`` column. Only these groups are clustered."""
    records = df.select(*group, "id", "seq")
    chosen = F.broadcast(top_groups(records, group, k).select(*group, F.lit(1).alias("_top")))
    rows = df.count()
    mine = settle(attach(records, chosen, list(group), rows, "inner").drop("_top"))
    parts = []
    for method in methods:
        members = run_method(method, mine, group, metric, thres, **(options or {}).get(method, {}))
        parts.append(members.withColumn("method", F.lit(method)))
    return union_all(parts)


def compare_counts(members: DataFrame, group: Sequence[str]) -> DataFrame:
    """Clusters per group and method."""
    return cluster_counts(members, ["method", *group])


__all__ = [
    "METHODS",
    "cluster_groups",
    "compare_counts",
    "compare_methods",
    "route_groups",
    "run_method",
    "threshold_sweep",
]
