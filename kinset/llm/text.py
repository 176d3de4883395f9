"""Helpers for whole columns of text inside a task: words, hashes, sub-batches.

Hashes of words and word runs have 64 bits and are computed for a sub-batch at
once with prefix sums: the hash of bytes s..e is (H[e] - H[s]) * P**-s, mixed.
Memory is a fixed multiple of ``PIECE`` bytes or of the longest single text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text worked on at once; a longer text is worked on alone.
PIECE = 1 << 19
#: White space between words: tab, line feed, vertical tab, form feed, return, space.
SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def random_words(seed: int, n: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers for a seed."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(_P))


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


class SpanHasher:
    """Hashes of spans of a sequence of codes below ``n_codes``."""

    def __init__(self, n_codes: int = 256, seed: int = 7):
        self.table = random_words(seed, n_codes)
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, codes: np.ndarray) -> np.ndarray:
        return self.value_sums(self.table[codes])

    def value_sums(self, values: np.ndarray) -> np.ndarray:
        n = len(values) + 1
        if len(self.up) < n:
            self.up, self.down = powers(_P, n + n // 4), powers(_P_INV, n + n // 4)
        out = np.zeros(n, np.uint64)
        np.cumsum(values * self.up[: n - 1], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mixed hashes of the spans; their lengths count, so a prefix differs from the whole."""
        raw = (sums[ends] - sums[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


_STORE: dict[tuple, Any] = {}


def process_store(key: tuple, make: Callable[[], Any]) -> Any:
    """One object per key and worker process, kept between its tasks."""
    store = _STORE
    if key not in store:
        store[key] = make()
    return store[key]


def forget() -> None:
    """Gives back what an earlier stage's operator has kept in this worker; called by operators that
    keep nothing themselves, before they start."""
    _STORE.clear()
    trim()


def trim() -> None:
    """Returns memory that is free, but held for reuse by Arrow and the C library, to the system:
    workers live through many stages beside the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return data, offsets


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_table(spaces=SPACES) -> np.ndarray:
    """Which bytes belong to words."""
    table = np.ones(256, bool)
    table[list(spaces)] = False
    return table


def lower_table() -> np.ndarray:
    """Bytes with A-Z in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def word_spans(
    data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the rows, and how many words begin before each row
    (one more entry than rows). ``offsets`` begin at 0 of ``data``."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = in_word[data]
    # A row's first byte never continues the word of the row before.
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    if len(cuts):
        cuts = np.unique(cuts)
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        if len(cuts):
            starts = np.sort(np.concatenate([starts, cuts]))
            ends = np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each run of ``k`` words of one text; fewer words are one run."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    width = min(k, n)
    factors = random_words(11, width) | np.uint64(1)
    out = np.full(n - width + 1, width * _P % (1 << 64), np.uint64)
    for i in range(width):
        out += words[i : n - width + 1 + i] * factors[i]
    return mix(out)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct values; the input is sorted in place."""
    if len(hashes) < 2:
        return hashes
    hashes.sort()
    keep = np.ones(len(hashes), bool)
    np.not_equal(hashes[1:], hashes[:-1], out=keep[1:])
    return hashes[keep]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class WordHasher:
    """Hashes of the words of texts, by the bytes that belong to words."""

    def __init__(self, in_word: np.ndarray | None = None, lower: bool = True):
        self.in_word = word_table() if in_word is None else in_word
        self.bytes = lower_table() if lower else np.arange(256, dtype=np.uint8)
        self.hasher = SpanHasher(256)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of rows, and how many words begin before each row."""
        starts, ends, first = word_spans(data, offsets, self.in_word)
        return self.hasher.spans(self.hasher.sums(self.bytes[data]), starts, ends), first


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like ``names`` that are not among ``taken``, in any case."""
    known = {c.lower() for c in taken}
    mark = "_"
    while any(f"{mark}{n}".lower() in known for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """``df`` with its columns that begin with _ renamed, so that names made inside an operator
    cannot clash with them; ``names`` as they are then called, and what gives the old names back."""
    known, new = {c.lower() for c in df.columns}, {}
    for c in df.columns:
        if c.startswith("_"):
            new[c] = next(n for n in (f"aside{i}" for i in range(2 * len(df.columns) + 1)) if n not in known)
            known.add(new[c])
    back = {v: k for k, v in new.items()}
    return df.withColumnsRenamed(new), [new.get(n, n) for n in names], lambda out: out.withColumnsRenamed(back)


def slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that what is made of them stays small."""
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)


def each_text(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Sub-batches of a text column: first row, end row, their bytes, offsets from 0."""
    data, offsets = text_buffers(column)
    for a, b in pieces(offsets, size):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def pack(texts: list[bytes]) -> list[bytes]:
    """Texts compressed one by one, to be moved by a shuffle."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
    return [squeeze(t) for t in texts]


def unpack(blobs: list[bytes]) -> list[bytes]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    return [expand(b) for b in blobs]


def packed_texts(df, key: str, text: str, keep: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """``key`` and ``_packed``, the compressed text (null: empty) of each row that ``keep`` leaves."""
    from pyspark.sql import types as T

    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("_packed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in map(keep, slices(batch)):
                texts = part.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(pack(texts), pa.binary())], names=[key, "_packed"]
                )

    return df.select(key, text).mapInArrow(run, schema)
