"""Hard negatives by rotated one-bit codes with residual bounds.

A vector of whole numbers is turned into more dimensions than it has by a random matrix with
orthonormal columns, and of each coordinate the sign is kept: its code. The code taken back
to the vector's space is a direction g; with the code are stored its length, the alignment
<o, g> and the vector's length. So o = (<o, g> / <g, g>) g + r, and the length of r is known.
A query q is turned likewise, rounded to a few bits and cut into bit planes; counting the bits
that planes and codes share gives <q, g> up to the rounding, whose length is known. What is
left, <q, r>, lies within the product of the lengths of r and of the part of q across g, by
Cauchy-Schwarz. The interval always holds the true product, so a row whose interval misses the
scores in question is left out safely, and the others are scored with whole numbers.

Anchors and rows meet in blocks: every cell of the grid of anchor blocks and row blocks is
worked on once, its rows in a stream, with the best rows of each anchor so far in hand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinset.operators.joins import join_keys
from kinset.plans.session import settle, settle_counted


@dataclass(frozen=True)
class Codes:
    """Code bits for each dimension, bit planes of a query, anchors and rows of a cell, and the most
    parts that rows are divided into (all of them cost only)."""

    stretch: int = 4
    planes: int = 6
    anchors: int = 1024
    rows: int = 2048
    parts: int = 256
    seed: int = 13


#: Components are whole numbers of at most this size, so sums of 1000 products fit in 64 bits.
LARGEST = 1 << 26
#: Rows compared with a block of anchors at once.
STEP = 512


class Rotation:
    """Codes of vectors with ``dim`` components."""

    def __init__(self, dim: int, how: Codes):
        self.bits = 64 * max(1, -(-how.stretch * dim // 64))
        self.planes = how.planes
        noise = np.random.default_rng(how.seed).normal(size=(self.bits, max(dim, 1)))
        self.turn = np.linalg.qr(noise)[0][:, :dim]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each row of ``x``: its code, as 64-bit words, the number of its set bits, the share
        <o, g> / <g, g>, <g, g>, and the length of r."""
        signs = x @ self.turn.T >= 0
        words = np.packbits(signs, axis=1, bitorder="little").view(np.uint64)
        g = (2.0 * signs - 1) @ self.turn
        gg = np.maximum((g * g).sum(1), 1e-300)
        share = (x * g).sum(1) / gg
        rest = x - share[:, None] * g
        return words, signs.sum(1), share, gg, np.sqrt((rest * rest).sum(1))

    def ask(self, q: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each query: bit planes (query, plane, word), the bits set in each plane, the lowest
        value, the step, the length of the rounding and the length of the query."""
        turned = q @ self.turn.T
        low = turned.min(1)
        step = np.maximum((turned.max(1) - low) / ((1 << self.planes) - 1), 1e-300)
        whole = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
        planes = np.stack(
            [np.packbits((whole >> j & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for j in range(self.planes)], 1
        )
        off = turned - (low[:, None] + step[:, None] * whole)
        return planes, whole.sum(1), low, step, np.sqrt((off * off).sum(1)), np.sqrt((q * q).sum(1))

    def bounds(self, asked: tuple[np.ndarray, ...], coded: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest product of each query (row) with each coded vector (column)."""
        planes, total, low, step, rounding, length = (a[:, None] if a.ndim == 1 else a for a in asked)
        words, ones, share, gg, rest = coded
        shared = np.zeros((len(planes), len(words)), np.int64)
        for j in range(self.planes):
            for w in range(words.shape[1]):
                shared += np.bitwise_count(planes[:, j, w, None] & words[None, :, w]).astype(np.int64) << j
        # The sum over the code's signs of the rounded query is <q, g>, but for the rounding.
        about = low * (2 * ones - self.bits) + step * (2 * shared - total)
        slack = rounding * np.sqrt(self.bits)
        nearest = np.maximum(np.abs(about) - slack, 0)
        across = np.sqrt(np.maximum(length * length - nearest * nearest / gg, 0))
        wide = np.abs(share) * slack + across * rest
        size = np.sqrt(share * share * gg + rest * rest)
        wide = wide * (1 + 1e-9) + 1e-9 * length * size + 1e-6  # what doubles may lose
        middle = share * about
        return middle - wide, middle + wide


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole-number inner products of all rows of ``q`` with all of ``x``."""
    lengths = [np.sqrt((a.astype(np.float64) ** 2).sum(1).max(initial=0)) for a in (q, x)]
    if lengths[0] * lengths[1] < 1 << 52:
        # No partial sum exceeds the product of the lengths, so doubles hold all of them exactly.
        return np.rint(q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``dim`` whole numbers; shorter ones end in zeros."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    size = np.diff(offsets)
    out = np.zeros((len(size), dim), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], size)] = flat
    return out


class Best:
    """For each of ``n`` lists the first ``k`` entries by (higher score, smaller id, smaller mark)."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.list = np.zeros(0, np.int64)
        self.score, self.id, self.mark = self.list, self.list, self.list
        self.floor = np.full(n, np.iinfo(np.int64).min)

    def add(self, lists: np.ndarray, score: np.ndarray, id_: np.ndarray, mark: np.ndarray) -> None:
        lists, score, id_, mark = (
            np.concatenate(x) for x in ((self.list, lists), (self.score, score), (self.id, id_), (self.mark, mark))
        )
        order = np.lexsort((mark, id_, -score, lists))
        lists, score, id_, mark = lists[order], score[order], id_[order], mark[order]
        begin = np.searchsorted(lists, lists)
        kept = np.arange(len(lists)) - begin < self.k
        self.list, self.score, self.id, self.mark = lists[kept], score[kept], id_[kept], mark[kept]
        # Full lists take nothing below their last score.
        last = np.flatnonzero((np.arange(len(lists)) - begin)[kept] == self.k - 1)
        self.floor[self.list[last]] = self.score[last]


def grid(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, how: Codes) -> DataFrame:
    """Rows of both tables under every cell (block, cell) they take part in, anchors first."""
    a = max(1, -(-n_anchors // how.anchors))
    b = max(1, min(-(-n_rows // how.rows), how.parts))
    others = [c for c in anchors.columns if c not in rows.columns]
    nothing = [F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in others]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("_a", F.pmod("mark", F.lit(a))).withColumn("_b", every(b)).withColumn("_role", F.lit(0))
    right = rows.select("*", *nothing).withColumn("_b", F.pmod("mark", F.lit(b))).withColumn("_a", every(a))
    right = right.withColumn("_role", F.lit(1))
    both = left.unionByName(right).withColumn("_cell", F.col("_a") * F.lit(b) + F.col("_b")).drop("_a", "_b")
    both = both.select("_cell", "_role", "vec", "label", "mark", "v", *others)
    return both.repartition(max(1, min(a * b, 100_000)), "_cell").sortWithinPartitions("_cell", "_role")


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, Iterator[pa.RecordBatch]]]:
    """The anchors of each cell with a stream of its rows."""
    parts = iter(_split(batches))
    held = next(parts, None)
    while held is not None:
        cell, anchors = held[0], []
        while held is not None and held[0] == cell and held[1] == 0:
            anchors.append(held[2])
            held = next(parts, None)

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal held
            while held is not None and held[0] == cell:
                yield held[2]
                held = next(parts, None)

        stream = rows()
        if anchors:
            yield pa.Table.from_batches(anchors).combine_chunks(), stream
        for _ in stream:
            pass


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Runs of rows with one cell and role."""
    for batch in batches:
        key = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            for at in range(first, last, STEP):
                yield int(key[first]) // 2, int(key[first]) % 2, batch.slice(at, min(STEP, last - at))


def best_in_cells(both: DataFrame, dim: int, k: int, same: bool, num: int, den: int, how: Codes) -> DataFrame:
    """(anchor, anchor_mark, positive, positive_mark, positive_score, other, mark, score): the first
    ``k`` rows of each cell for its anchors.

    ``same``: rows of the anchor's label but for itself; positive is null then. Otherwise rows of
    other labels with ``den * positive_score <= num * score <= num * positive_score`` for each
    positive in the anchor's list ``positives``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = Rotation(dim, how)
        names = ["anchor", "anchor_mark", "positive", "positive_mark", "positive_score", "other", "mark", "score"]
        for anchors, stream in cells(batches):
            vec, label, mark = (anchors.column(i).to_numpy() for i in (2, 3, 4))
            q = vectors_of(anchors.column(5).combine_chunks(), dim)
            asked = turn.ask(q.astype(np.float64))
            if same:
                owner, high, low = np.arange(len(q)), None, None
                best = Best(len(q), k)
            else:
                lists = anchors.column(6).combine_chunks()
                owner = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
                named = [x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten()]
                high = named[0]
                low = -(-den * high // num)  # the least whole score that counts
                best = Best(len(owner), k)
            for batch in stream:
                ids, labels, marks = (batch.column(i).to_numpy() for i in (2, 3, 4))
                x = vectors_of(batch.column(5), dim)
                least, most = turn.bounds(asked, turn.encode(x.astype(np.float64)))
                fits = label[:, None] == labels[None]
                if same:
                    fits &= (vec[:, None] != ids[None]) | (mark[:, None] != marks[None])
                    near = fits & (most >= best.floor[:, None])
                    near &= most >= kth_largest(np.where(fits, least, -np.inf), k)[:, None]
                else:
                    some = (most[owner] >= np.maximum(low, best.floor)[:, None]) & (least[owner] <= high[:, None])
                    # Every anchor here has a positive, so each has a run of its own.
                    near = np.logical_or.reduceat(some, np.searchsorted(owner, np.arange(len(q))), axis=0) & ~fits
                a, r = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                if not len(a) or not len(r):
                    continue
                exact = np.zeros(near.shape, np.int64)
                exact[np.ix_(a, r)] = products(q[a], x[r])
                near = near[owner]
                score = exact[owner]
                near &= score >= best.floor[:, None]
                if not same:
                    near &= (score >= low[:, None]) & (score <= high[:, None])
                at, r = np.nonzero(near)
                best.add(at, score[at, r], ids[r], marks[r])
            own = owner[best.list]
            if same:
                empty = pa.nulls(len(own), pa.int64())
                positive = [empty, empty, empty]
            else:
                positive = [pa.array(named[i][best.list]) for i in (1, 2, 0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(vec[own]), pa.array(mark[own]), *positive, pa.array(best.id), pa.array(best.mark), pa.array(best.score)],
                names=names,
            )

    columns = "anchor long, anchor_mark long, positive long, positive_mark long, positive_score long, other long, mark long, score long"
    return both.mapInArrow(run, columns)


def kth_largest(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th largest number of each row, or minus infinity where there are fewer."""
    if x.shape[1] < k:
        return np.full(len(x), -np.inf)
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k]


def first_of(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each list (higher score, smaller id) over all cells, as an array of
    (score, other, mark). A list has at most ``k`` rows from each of at most ``Codes.parts`` cells."""
    entry = F.struct((-F.col("score")).alias("down"), F.col("other"), F.col("mark"))
    rows = found.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("best"))
    return rows.withColumn("best", F.transform("best", lambda b: F.struct((-b["down"]).alias("score"), b["other"].alias("other"), b["mark"].alias("mark"))))


def whole_vectors(df: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(vec, label, v, mark): the rows that take part, repeated rows once, as whole numbers. ``mark``
    tells rows apart that share a key."""
    x = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("vec"), label.cast("long").alias("label"), x.alias("x"))
    usable = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = lambda c: F.floor(F.greatest(F.least(c * F.lit(scale), F.lit(float(LARGEST))), F.lit(-float(LARGEST))))
    rows = rows.where(F.col("vec").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & usable)
    rows = rows.select("vec", "label", F.transform("x", whole).cast("array<long>").alias("v"))
    return rows.withColumn("mark", F.xxhash64("vec", "label", "v")).dropDuplicates(["vec", "label", "v"])


def hard_negatives(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    is_anchor: Callable[[Column], Column] = lambda key: key % 100 == 0,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    scale: int = 256,
    how: Codes | None = None,
) -> DataFrame:
    """For each anchor and each of its first positives, the first rows of other labels that score
    at least ``low`` percent of the positive and at most as much.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    Components become floor(scale * x), limited to 2^26 either way; a score is the inner
    product of these, the shorter vector ending in zeros; higher scores come first, ties by
    smaller key. Positives are the first other rows of the anchor's label. Rows with a null key,
    label or vector, or a null or non-finite component take no part. Repeated rows count once;
    rows that share a key but not all else are rows of their own, and count as others of an anchor
    with that key. ``label`` may be a column made of those of ``df``; ``is_anchor`` tells anchors
    by their key. Anchors without positives, and positives without negatives, give no rows. All
    rows are compared with all anchors, in blocks.
    """
    how = how or Codes()
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    rows, n = settle_counted(whole_vectors(df, key, vector, label, scale))
    asked, n_asked = settle_counted(rows.where(is_anchor(F.col("vec"))))
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    by = ["anchor", "anchor_mark"]
    found = best_in_cells(grid(asked, rows, n_asked, n, how), dim, positives, True, 100, low, how)
    best = first_of(found, by, positives).select(
        F.col("anchor").alias("vec"), F.col("anchor_mark").alias("mark"),
        F.col("best").alias("positives"),
    )
    asked, n_asked = settle_counted(join_keys(asked, best, ["vec", "mark"], "inner"))
    found = best_in_cells(grid(asked, rows, n_asked, n, how), dim, negatives, False, 100, low, how)
    lists = settle(first_of(found, [*by, "positive", "positive_mark", "positive_score"], negatives))
    out = lists.select("anchor", "positive", "positive_score", F.posexplode("best").alias("at", "b"))
    return out.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
        F.col("b.other").alias("negative_id"), "positive_score", F.col("b.score").alias("negative_score"),
    )
