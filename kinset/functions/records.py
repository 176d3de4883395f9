"""Sequence records as structs, bracketed text and JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD_FIELDS = ("Index", "SEQUENCE_ID", "JUNCTION")


def with_record(
    df: DataFrame, columns: Sequence[str] = RECORD_FIELDS, name: str = "Seq"
) -> DataFrame:
    """Add a struct column holding index, label and sequence."""
    return df.withColumn(name, F.struct(*columns))


def to_int(text: Column, on_error: str = "fail", kind: str = "bigint") -> Column:
    """Text to a whole number; ``on_error='reject'`` gives null for bad text."""
    if on_error not in ("fail", "reject"):
        raise ValueError(f"on_error must be 'fail' or 'reject', not {on_error!r}")
    return text.cast(kind) if on_error == "fail" else text.try_cast(kind)


def strip_quotes(text: Column) -> Column:
    return F.regexp_replace(text, '"', "")


def record_fields(text: Column, on_error: str = "fail") -> Column:
    """``index,label,sequence`` to a struct; fields after the third are ignored."""
    if on_error == "fail":
        text = F.coalesce(text, F.raise_error(F.lit("a line without a record")).cast("string"))
    parts = F.split(text, ",")
    get = F.element_at if on_error == "fail" else F.try_element_at
    return F.struct(
        to_int(get(parts, F.lit(1)), on_error).alias("id"),
        get(parts, F.lit(2)).alias("label"),
        get(parts, F.lit(3)).alias("seq"),
    )


def parse_record(text: Column | str, on_error: str = "fail") -> Column:
    """Text of the form ``[index,label,sequence]`` to a struct."""
    text = F.col(text) if isinstance(text, str) else text
    return record_fields(F.regexp_replace(text, r"^\[|\]$", ""), on_error)


def to_json_records(
    id: Column | str = "id", label: Column | str = "label", seq: Column | str = "seq"
) -> Column:
    """One JSON object per record; the id is a JSON number."""
    fields = [F.col(c) if isinstance(c, str) else c for c in (id, label, seq)]
    names = ("id", "label", "seq")
    return F.to_json(F.struct(*[c.alias(n) for c, n in zip(fields, names)]))


def from_json_records(text: Column | str) -> Column:
    """JSON object to a record struct; ``1`` and ``1.0`` are the same id."""
    text = F.col(text) if isinstance(text, str) else text
    read = F.from_json(text, "id decimal(38,6), label string, seq string")
    return F.when(
        read.isNotNull(),
        F.struct(
            read["id"].cast("bigint").alias("id"),
            read["label"].alias("label"),
            read["seq"].alias("seq"),
        ),
    )
