"""Fill-in-the-middle examples, cut by Fenwick trees over blocks of each text.

A text is cut into units: a word with the white space before it, and white space that ends
the text. It is divided into blocks of a fixed number of bytes, and two Fenwick trees over
its blocks hold how many units end, and how many code points begin, in each. The block in
which a unit ends is found by binary lifting: from the largest power of two down, a step is
taken while the units passed stay below the one sought, and the code points passed are
added up on the way. Within that one block the boundary is found by looking at its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinset.llm.text import each_text, fresh, slices, word_table


@dataclass(frozen=True)
class Infill:
    """Shares in percent: of texts that are cut at all, and of these in the order suffix,
    prefix, middle. ``block`` is in bytes."""

    seed: int = 42
    rate: int = 50
    suffix_first: int = 80
    block: int = 1024


#: What stands before the prefix, the suffix and the middle (fixed values).
MARKS = (b"<P>", b"<S>", b"<M>")
ADDED = "n long, form string, prefix_chars long, middle_chars long, output string"


def fenwick(counts: np.ndarray) -> np.ndarray:
    """The tree of counts: entry i (from 1) is the sum of the last i & -i of the first i counts."""
    i = np.arange(len(counts) + 1)
    sums = np.concatenate([[0], np.cumsum(counts)])
    return sums - sums[i - (i & -i)]


class BlockTree:
    """Unit ends and code points of the blocks of one text."""

    def __init__(self, units: np.ndarray, points: np.ndarray):
        self.n, self.total = len(units), int(units.sum())
        self.units, self.points = fenwick(units).tolist(), fenwick(points).tolist()

    def find(self, k: int) -> tuple[int, int, int]:
        """The block in which unit ``k`` (from 1) ends, which unit end of the block that is, and
        the code points before the block."""
        at = before = 0
        step = 1 << self.n.bit_length()
        while step:
            to = at + step
            if to <= self.n and self.units[to] < k:
                at = to
                k -= self.units[to]
                before += self.points[to]
            step >>= 1
        return at, k, before


def unit_ends(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> np.ndarray:
    """Which bytes are the last of a unit."""
    inside = in_word[data]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    # A text's last byte ends a word, or the white space that ends the text.
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    return last


def draws(seed: int, key) -> list[int]:
    """The four numbers that decide about a row: groups of 8 hexadecimal digits of a digest."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


class Cutter:
    """Cuts the texts of a sub-batch."""

    def __init__(self, how: Infill):
        self.how, self.in_word = how, word_table()

    def rows(self, keys: list, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
        """n, form, prefix_chars, middle_chars, output of each text."""
        size = np.diff(offsets)
        last = unit_ends(data, offsets, self.in_word)
        begins = (data & 0xC0) != 0x80
        blocks = -(-size // self.how.block)
        first = np.cumsum(blocks) - blocks
        within = np.arange(blocks.sum()) - np.repeat(first, blocks)
        starts = np.repeat(offsets[:-1], blocks) + within * self.how.block
        units = np.add.reduceat(last.astype(np.int64), starts) if len(starts) else starts
        points = np.add.reduceat(begins.astype(np.int64), starts) if len(starts) else starts
        raw = data.tobytes()
        for i, key in enumerate(keys):
            a, b = int(offsets[i]), int(offsets[i + 1])
            text = raw[a:b]
            own = slice(first[i], first[i] + blocks[i])
            n = int(units[own].sum())
            h = draws(self.how.seed, key)
            if not text or h[2] % 100 >= self.how.rate or any(m in text for m in MARKS):
                yield n, "plain", None, None, text
                continue
            tree = BlockTree(units[own], points[own])
            ends, chars = [], []
            for k in sorted(x % (n + 1) for x in h[:2]):
                end = char = 0
                if k:
                    block, k, char = tree.find(k)
                    at = a + block * self.how.block
                    end = at + int(np.flatnonzero(last[at : min(at + self.how.block, b)])[k - 1]) + 1
                    char += int(begins[at:end].sum())
                    end -= a
                ends.append(end)
                chars.append(char)
            prefix, middle, suffix = text[: ends[0]], text[ends[0] : ends[1]], text[ends[1] :]
            p, s, m = MARKS
            if h[3] % 100 < self.how.suffix_first:
                form, output = "spm", b"".join((s, suffix, p, prefix, m, middle))
            else:
                form, output = "psm", b"".join((p, prefix, s, suffix, m, middle))
            yield n, form, chars[0], chars[1] - chars[0], output


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", how: Infill | None = None) -> DataFrame:
    """``df`` with n (units of the text), form (plain, psm or spm), prefix_chars and middle_chars
    (code points, null if plain) and output (the example).

    A text is left plain if it is empty or holds a mark, or if the draw for its key says so. A
    null text counts as empty; a null key draws as the empty string. Rows with one key and one
    text get one example each, all the same. Columns of the result's names are replaced, others
    stay. Rows do not move; memory is a fixed multiple of a sub-batch or of the longest text.
    """
    how = how or Infill()
    added = T._parse_datatype_string(ADDED)
    others = [c for c in df.columns if c.lower() not in added.fieldNames()]
    k, t = fresh(df.columns, "k", "t")
    kept = df.select(*[F.col(f"`{c}`") for c in others])
    schema = T.StructType([*kept.schema.fields, *added.fields])
    rows = df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{key}`").alias(k), F.col(f"`{text}`").cast("string").alias(t))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(how)
        for batch in (part for whole in batches for part in slices(whole)):
            keys = batch.column(len(others)).to_pylist()
            for a, b, data, offsets in each_text(batch.column(len(others) + 1)):
                found = zip(*cutter.rows(keys[a:b], data, offsets), strict=True)
                columns = [pa.array(c, kind) for c, kind in zip(found, kinds, strict=True)]
                columns[-1] = columns[-1].view(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(a, b - a) for i in range(len(others))], *columns], names=schema.fieldNames()
                )

    return rows.mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an example was made of. No part of a cut text holds a mark, and no mark
    can begin in a part and end in the mark after it, so the marks divide the example."""
    part = F.split(F.col(output), "<[PSM]>")
    whole = F.when(F.col(form) == "psm", F.concat(part[1], part[3], part[2]))
    whole = whole.when(F.col(form) == "spm", F.concat(part[2], part[3], part[1]))
    return whole.otherwise(F.col(output))
