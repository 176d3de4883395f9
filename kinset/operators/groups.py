"""Grouping: sizes, largest groups, collected groups, order numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinset.operators.joins import join_keys, unsent
from kinset.plans.session import settle, settle_counted

def group_sizes(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Records per group."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))


def top_groups(df: DataFrame, group: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` largest groups; equal sizes are ordered by the group columns."""
    return group_sizes(df, group).orderBy(F.desc("n"), *group).limit(k)


def with_ordinal(
    df: DataFrame,
    order: Sequence[str],
    group: Sequence[str] = (),
    name: str = "ordinal",
) -> DataFrame:
    """Number the rows of each group from 0 in the order given.

    The rows are range-partitioned and sorted once, so a group may span many
    partitions and no task has to hold one. A row's number is its place among
    its group's rows in the partition, plus the group's rows in earlier ones.
    ``order`` must be unique within a group.
    """
    keys = [*group, *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = settle(placed.withColumn("_slot", F.monotonically_increasing_id()))
    placed = placed.withColumn("_span", F.shiftright("_slot", 33))
    spans, n = settle_counted(
        placed.groupBy("_span", *group).agg(F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    )
    earlier = Window.partitionBy(*group).orderBy("_span").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = spans.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    starts = starts.drop("_rows")
    if not group:
        # One row per partition.
        starts = F.broadcast(starts)
    else:
        # As many rows as groups, at least.
        starts = unsent(starts, n)
    located = join_keys(placed, starts, ["_span", *group], "inner")
    number = F.col("_slot") - F.col("_first") + F.col("_before")
    return located.select(*df.columns, number.alias(name))


def _chunks(
    df: DataFrame, group: Sequence[str], order: Sequence[str], list_rows: int
) -> DataFrame:
    numbered = with_ordinal(df, order, group, "_number")
    return numbered.withColumn("part", F.expr(f"_number div {int(list_rows)}"))


def _struct_sorted(order: Sequence[str], fields: Sequence[str]) -> Column:
    rest = [f for f in fields if f not in order]
    return F.array_sort(F.collect_list(F.struct(*order, *rest)))


def collect_groups(
    df: DataFrame,
    group: Sequence[str],
    fields: Sequence[str],
    list_rows: int,
    order: Sequence[str] = ("id",),
    name: str = "SeqList",
) -> DataFrame:
    """Records of each group as a sorted array of structs.

    A group of up to ``list_rows`` records is one row with ``part`` 0; a larger
    one is several rows, so that no row grows with the group.
    """
    chunked = _chunks(df, group, order, list_rows)
    lists = chunked.groupBy(*group, "part").agg(_struct_sorted(order, fields).alias("_list"))
    ordered = F.transform("_list", lambda r: F.struct(*[r[f].alias(f) for f in fields]))
    return lists.select(*group, "part", ordered.alias(name))


def collect_group_columns(
    df: DataFrame,
    group: Sequence[str],
    columns: dict[str, str],
    list_rows: int,
    order: Sequence[str] = ("id",),
) -> DataFrame:
    """Parallel lists per group, ``columns`` mapping source to list names.

    Position i of every list belongs to the same record; lists are split into
    parts as in ``collect_groups``.
    """
    chunked = _chunks(df, group, order, list_rows)
    lists = chunked.groupBy(*group, "part").agg(_struct_sorted(order, list(columns)).alias("_list"))
    return lists.select(
        *group, "part", *[F.col(f"_list.{source}").alias(to) for source, to in columns.items()]
    )
