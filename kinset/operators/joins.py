"""Null-safe and skew-safe joins of a table with a one-row-per-key table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinset.plans.limits import LIMITS
from kinset.plans.session import is_empty, settle


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions, F.lit(True))


def same_keys(a: str, b: str, keys: Sequence[str]) -> list[Column]:
    """Equality of ``keys`` between aliases ``a`` and ``b``; nulls are equal."""
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys, a null being equal to a null; keys appear once."""
    if not keys:
        if how in ("left_semi", "inner", "left"):
            raise ValueError("a join needs at least one key")
        return left
    renamed = right.select(
        *[F.col(k).alias(f"_right_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    on = all_of([left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    joined = left.join(renamed, on, how)
    return joined.drop(*[f"_right_{k}" for k in keys])


def unsent(table: DataFrame, rows: int) -> DataFrame:
    """``table`` (about ``rows`` rows), not to be broadcast if these are many. Numbers in order take
    so little room in files that Spark would send millions of them through the driver."""
    return table.hint("merge") if rows > LIMITS.broadcast_rows else table


def attach(
    fact: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    rows: int,
    how: str = "left",
    counts: DataFrame | None = None,
    dim_rows: int = 0,
) -> DataFrame:
    """Join ``fact`` (about ``rows`` rows) with ``dim`` (one row per key).

    Keys that hold more than 1/``hot_share`` of the fact rows are joined apart
    by broadcast: there are at most ``hot_share`` of them, so that table is small
    whatever the data, and their fact rows are not moved at all. ``counts`` (keys
    and ``_n``) saves counting the fact rows where that has been done already. ``dim_rows``
    is for tables that grow with the records: above ``broadcast_rows`` they are not broadcast.
    """
    whole, dim = dim, unsent(dim, dim_rows)
    if rows <= LIMITS.plain_join_rows:
        return join_keys(fact, dim, keys, how)
    if counts is None:
        counts = fact.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = settle(
        counts.where(F.col("_n") > rows // LIMITS.hot_share)
        .orderBy(F.desc("_n"))
        .limit(LIMITS.hot_share)
        .select(*keys)
    )
    if is_empty(hot):
        return join_keys(fact, dim, keys, how)
    hot_dim = settle(join_keys(whole, F.broadcast(hot), keys, "left_semi"))
    hot_rows = join_keys(
        join_keys(fact, F.broadcast(hot), keys, "left_semi"), F.broadcast(hot_dim), keys, how
    )
    other_rows = join_keys(join_keys(fact, F.broadcast(hot), keys, "left_anti"), dim, keys, how)
    return hot_rows.unionByName(other_rows)
