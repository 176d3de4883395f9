"""Lempel-Ziv phrase fingerprints.

A text is parsed as LZ78 does: each phrase is the longest earlier phrase plus one
more character (the last may be incomplete). The set of phrases is what a
dictionary coder learns of the text, so texts with many phrases in common
compress well together. Phrases are hashed and the smallest hashes kept; two
such signatures estimate the share of common phrases.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinset.llm.text import SpanHasher, distinct, mix

#: Hashes kept of each text.
SIZE = 64
#: Hexadecimal digits of a kept hash.
DIGITS = 8


class PhraseParser:
    """Phrases of texts; memory grows with the number of phrases of one text."""

    def __init__(self, size: int = SIZE):
        self.size = size
        self.hasher = SpanHasher(2)

    @staticmethod
    def _walk(text: str, at: int, root: dict, node: dict, added: list | None) -> tuple[list[int], dict]:
        """Ends of the phrases completed in ``text``, which begins at place ``at``."""
        ends = []
        for i, c in enumerate(text, at + 1):
            below = node.get(c)
            if below is None:
                node[c] = {}
                ends.append(i)
                if added is not None:
                    added.append((node, c))
                node = root
            else:
                node = below
        return ends, node

    def smallest(self, text: str, ends: list[int]) -> np.ndarray:
        """The smallest distinct hashes of the phrases that end at ``ends``."""
        if not text:
            return np.zeros(0, np.uint32)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not ends or ends[-1] != len(text):
            ends = [*ends, len(text)]
        stop = np.array(ends)
        start = np.concatenate([[0], stop[:-1]])
        sums = self.hasher.value_sums(mix(codes.astype(np.uint64) + np.uint64(1)))
        hashes = (self.hasher.spans(sums, start, stop) >> np.uint64(64 - 4 * DIGITS)).astype(np.uint32)
        return distinct(hashes)[: self.size]

    def parse(self, text: str) -> np.ndarray:
        root: dict = {}
        return self.smallest(text, self._walk(text, 0, root, root, None)[0])

    def parse_edited(self, text: str, keep: int, tail: str) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of ``text`` and of its first ``keep`` characters with ``tail``.

        What both begin with is parsed once: phrases learnt after it are forgotten
        before the other end is parsed.
        """
        root: dict = {}
        head, node = self._walk(text[:keep], 0, root, root, None)
        added: list = []
        own, _ = self._walk(text[keep:], keep, root, node, added)
        for at, c in reversed(added):
            del at[c]
        other, _ = self._walk(tail, keep, root, node, None)
        return self.smallest(text, head + own), self.smallest(text[:keep] + tail, head + other)


def to_text(signature: np.ndarray) -> str:
    """Hexadecimal digits of the hashes in ascending order."""
    return signature.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of common phrases: of the smallest hashes of both, how many both have.

    1 for equal signatures, two empty ones included; exact below ``size`` phrases.
    """
    both = np.concatenate([a, b])
    both.sort()
    same = both[1:] == both[:-1]
    n_distinct = len(both) - int(same.sum())
    if n_distinct == 0:
        return 1.0
    if n_distinct <= size:
        return float(same.sum() / n_distinct)
    first = np.concatenate([[True], ~same])
    last = both[np.flatnonzero(first)[size - 1]]
    return float((same & (both[1:] <= last)).sum() / size)


def likeness_of(a: str, b: str) -> Column:
    """``likeness`` of two fingerprint columns; null where either is null."""

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        pairs = zip(left, right, strict=True)
        return pd.Series(
            [None if x is None or y is None else likeness(from_text(x), from_text(y)) for x, y in pairs],
            dtype="float64",
        )

    return F.pandas_udf(run, "double")(a, b)


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of each whole text.

    A null text counts as empty; an empty text has the empty fingerprint. Equal texts
    have equal fingerprints. A column named ``out`` is replaced. No shuffle.
    """

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        parser = PhraseParser()
        for column in columns:
            yield column.map(lambda t: to_text(parser.parse(t or "")))

    return df.withColumn(out, F.pandas_udf(run, "string")(F.coalesce(F.col(text), F.lit(""))))


def with_next(df: DataFrame, order: str, parts: int) -> DataFrame:
    """Rows dealt into ranges of descending ``order``, each with the row that follows it.

    Columns added: ``_range`` (0: largest values; nulls come last), ``_after`` (true
    for the copy of the row that follows a range's last row, at the end of the range;
    the first row of all follows the last). Only one row per range is copied, so no
    window over the whole table is needed.
    """
    bounds = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    bounds = sorted(set(bounds))
    number = (
        F.size(F.filter(F.lit(bounds), lambda x: x > F.col(order))) if bounds else F.lit(0)
    )
    ranged = df.withColumn("_range", F.when(F.col(order).isNull(), len(bounds) + 1).otherwise(number))
    firsts = [
        (r["_range"], r["first"])
        for r in ranged.groupBy("_range").agg(F.max(order).alias("first")).collect()  # one row a range
    ]
    firsts.sort()
    if not firsts:
        return ranged.withColumn("_after", F.lit(False))
    wrap = {firsts[i][0]: firsts[i - 1][0] for i in range(len(firsts))}
    before = df.sparkSession.createDataFrame(
        [(a, f, wrap[a]) for a, f in firsts], f"_range int, _first {dict(df.dtypes)[order]}, _to int"
    )
    heads = (
        ranged.join(F.broadcast(before), "_range")
        .where(F.col(order).eqNullSafe(F.col("_first")))
        .select(*df.columns, F.col("_to").alias("_range"), F.lit(True).alias("_after"))
    )
    return ranged.withColumn("_after", F.lit(False)).unionByName(heads)


def edited_fingerprints(df: DataFrame, order: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of each text, of an edited form of it, and their likeness.

    The edited text ends with the beginning of the following text (descending
    ``order``; the first follows the last): its last third, floor(n/3) characters, is
    replaced by the first as many (or all) of that text. Returns ``order``, n_chars,
    edited_text, fingerprint, edited_fingerprint, near_edited and near_next.

    Null texts count as empty. Rows of one order value follow each other by text;
    a null order value comes last. A single row follows itself. Repeated rows give one
    result each. Rows are dealt once, by ranges of ``order``.
    """
    spark = df.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(order), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    dealt = (
        with_next(rows, order, parts)
        .repartition("_range")
        .sortWithinPartitions("_range", "_after", F.desc_nulls_last(order), "_text")
    )
    kind = rows.schema[order].dataType
    fields = [(order, kind), ("n_chars", T.LongType()), ("edited_text", T.StringType())]
    fields += [(c, T.StringType()) for c in ("fingerprint", "edited_fingerprint")]
    fields += [(c, T.DoubleType()) for c in ("near_edited", "near_next")]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = PhraseParser()
        out: list[tuple] = []
        held = None  # the row before: key, text
        done = None  # the row before that, but for near_next
        group, closed = None, False
        key_type = None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * len(fields)
            types = [key_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[n for n, _ in fields]
            )
            out.clear()
            return batch

        def finish(following: np.ndarray) -> None:
            nonlocal done
            if done is not None:
                *row, own, edited = done
                out.append((*row, to_text(own), to_text(edited), likeness(own, edited), likeness(own, following)))
                done = None

        for batch in batches:
            key_type = batch.schema.field(order).type
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                columns = [part.column(part.schema.get_field_index(c)).to_pylist() for c in (order, "_text", "_range", "_after")]
                for key, words, number, after in zip(*columns, strict=True):
                    if number != group:
                        group, closed, held, done = number, False, None, None
                    if closed:  # more copies of rows with the same key
                        continue
                    if held is not None:
                        n = len(held[1])
                        cut = n // 3
                        own, edited = parser.parse_edited(held[1], n - cut, words[:cut])
                        finish(own)
                        done = (held[0], n, held[1][: n - cut] + words[:cut], own, edited)
                    held = (key, words)
                    if after:
                        finish(parser.parse(words))
                        closed = True
                yield flush()

    return dealt.mapInArrow(run, schema)


