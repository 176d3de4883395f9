"""Exact copies: clustering works on distinct sequences, results on records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinset.functions.distance import check_metric
from kinset.operators.joins import attach, join_keys
from kinset.plans.session import settle


@dataclass(frozen=True)
class Distinct:
    """Distinct sequences per group: group columns, seq, id (smallest), copies."""

    table: DataFrame
    group: tuple[str, ...]
    metric: str
    rows: int
    records: int
    # Largest number of distinct sequences in one group.
    widest: int
    # Some group holds sequences of different lengths.
    uneven: bool
    longest: int
    # Tables worked out once for this one, by name.
    known: dict = field(default_factory=dict, compare=False)

    def attach_to(self, df: DataFrame, dim: DataFrame, how: str = "left") -> DataFrame:
        """Join records with a table of one row per group and sequence; the
        copies are counted already, so hot sequences are known."""
        keys = [*self.group, "seq"]
        counts = self.table.select(*keys, F.col("copies").alias("_n"))
        return attach(df, dim, keys, self.records, how, counts)


def comparable(metric: str) -> Column:
    """Whether a record's sequence has distances at all."""
    present = F.col("seq").isNotNull()
    return present & (F.length("seq") > 0) if metric == "hamming" else present


def collapse(df: DataFrame, group: Sequence[str], metric: str) -> DataFrame:
    """One row per group and sequence, carrying the smallest id and the count.

    Rows without a sequence are close to nothing and are left out; so are empty
    sequences under the Hamming metric, whose distance is undefined.
    """
    return df.where(comparable(metric)).groupBy(*group, "seq").agg(
        F.min("id").cast("bigint").alias("id"), F.count(F.lit(1)).alias("copies")
    )


def distinct_sequences(
    df: DataFrame, group: Sequence[str], metric: str, on_unequal: str = "raise"
) -> Distinct:
    """Collapse copies, settle the table and measure it.

    Hamming is defined for equal lengths only: a group of mixed lengths raises,
    or with ``on_unequal='skip'`` only equal lengths are compared.
    """
    check_metric(metric)
    if on_unequal not in ("raise", "skip"):
        raise ValueError(f"on_unequal must be 'raise' or 'skip', not {on_unequal!r}")
    table = settle(collapse(df, group, metric))
    n = F.length("seq")
    per_group = table.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("copies").alias("records"),
        (F.min(n) != F.max(n)).alias("uneven"),
        F.max(n).alias("longest"),
    )
    row = per_group.agg(
        F.coalesce(F.sum("rows"), F.lit(0)),
        F.coalesce(F.sum("records"), F.lit(0)),
        F.coalesce(F.max("rows"), F.lit(0)),
        F.coalesce(F.bool_or("uneven"), F.lit(False)),
        F.coalesce(F.max("longest"), F.lit(0)),
    ).first()
    if metric == "hamming" and row[3] and on_unequal == "raise":
        raise ValueError("hamming distance needs groups of equal length; see on_unequal")
    return Distinct(table, tuple(group), metric, *row)


def restore(df: DataFrame, distinct: Distinct, assigned: DataFrame) -> DataFrame:
    """Give every record the cluster of its sequence.

    ``assigned`` maps the id of a distinct sequence to ``cluster_id``. Sequences
    it lacks, and records without a sequence, are clusters of their own.
    """
    group = distinct.group
    known = join_keys(distinct.table.select(*group, "seq", "id"), assigned, ["id"], "left")
    known = known.select(
        *group, "seq", F.coalesce("cluster_id", "id").alias("_cluster")
    )
    number = F.col("id").cast("bigint")
    usable = comparable(distinct.metric)
    members = distinct.attach_to(df.where(usable).select(*group, "id", "seq"), known)
    placed = members.select(
        *group, number.alias("id"), F.coalesce("_cluster", number).alias("cluster_id")
    )
    alone = df.where(~usable).select(*group, number.alias("id"), number.alias("cluster_id"))
    return placed.unionByName(alone)
