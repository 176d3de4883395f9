"""Sequence distances as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("hamming", "edit")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    return metric


def sequence_length(seq: Column | str) -> Column:
    return F.length(_col(seq))


def same_sequence(a: Column | str, b: Column | str) -> Column:
    """Content equality; two missing sequences are equal."""
    return _col(a).eqNullSafe(_col(b))


def hamming_count(a: Column | str, b: Column | str) -> Column:
    """Number of differing positions of two strings of equal length."""
    differs = F.zip_with(
        F.split(_col(a), ""), F.split(_col(b), ""), lambda x, y: F.when(x == y, 0).otherwise(1)
    )
    return F.aggregate(differs, F.lit(0), lambda total, x: total + x)


def packed(s: Column | str, longest: int) -> Column:
    """Seven letters of a string in each whole number, for ``packed_count``; null unless all are ASCII."""
    digits = F.hex(_col(s))
    word = lambda i: F.conv(F.substring(digits, 14 * i + 1, 14), 16, 10).try_cast("bigint")
    words = F.array(*[word(i) for i in range(-(-longest // 7))]).cast("array<bigint>")
    return F.when(F.octet_length(_col(s)) == F.length(_col(s)), words)


def packed_count(a: Column | str, b: Column | str, longest: int) -> Column:
    """``hamming_count`` of two strings of equal length by their ``packed`` words."""
    return packed_letters([(F.get(_col(a), F.lit(i)), F.get(_col(b), F.lit(i))) for i in range(-(-longest // 7))])


def packed_letters(words: Sequence[tuple[Column, Column]]) -> Column:
    """``packed_count`` of the words themselves, in pairs."""
    total = F.lit(0)
    for x, y in words:
        x = x.bitwiseXOR(y)
        # Adding 0x7f sets the high bit of every byte that is not zero, and carries into no other.
        x = (x + F.lit(0x7F7F7F7F7F7F7F)).bitwiseAND(F.lit(0x80808080808080))
        total = total + F.coalesce(F.bit_count(x), F.lit(0))
    return total


def hamming_norm(a: Column | str, b: Column | str) -> Column:
    """Differing positions divided by the length.

    Unequal lengths raise, two empty strings give NaN, a null gives null.
    """
    a, b = _col(a), _col(b)
    uneven = F.raise_error(F.lit("hamming distance needs sequences of equal length"))
    return (
        F.when(F.length(a) != F.length(b), uneven.cast("double"))
        .when(F.length(a) == 0, F.lit(float("nan")))
        .otherwise(F.try_divide(hamming_count(a, b).cast("double"), F.length(a).cast("double")))
    )


def edit_dist(a: Column | str, b: Column | str) -> Column:
    """Unit-cost Levenshtein distance, not normalised."""
    return F.levenshtein(_col(a), _col(b)).cast("double")


def distance(metric: str, a: Column | str, b: Column | str) -> Column:
    return hamming_norm(a, b) if check_metric(metric) == "hamming" else edit_dist(a, b)


def edit_radius(thres: float) -> int:
    """Largest whole distance strictly below ``thres`` (-1 if there is none)."""
    whole = int(thres)
    return whole - 1 if whole >= thres else whole
