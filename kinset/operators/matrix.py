"""Agglomeration of small distance matrices, by rounds of mutual nearest clusters.

A piece is a set of clusters that merge with each other only. Pieces of a bounded number of
clusters are gathered in one task each; larger ones take the rounds of ``linkage``, which make
the same merges in the same rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Digits of a score that count, so that sums taken in another order do not change the order.
DIGITS = 12
COMBINE = {"average": np.add, "complete": np.maximum, "single": np.minimum}
MERGES = "piece long, a long, b long, score double, size_a long, size_b long, _round int"


def merge_rounds(
    ids: np.ndarray,
    sizes: np.ndarray,
    value: np.ndarray,
    linkage: str,
    limit: float | None = None,
    larger_first: bool = False,
    linked: np.ndarray | None = None,
    unit: float = 1.0,
) -> list[tuple[int, int, float, int, int, int]]:
    """Merges (a, b, score, size_a, size_b, round) of the clusters ``ids``, which are in order.

    ``value[i, j]`` is the sum over member pairs (average; divided by ``unit`` for each of them),
    the largest (complete) or the smallest (single); infinite where clusters cannot be merged.
    ``linked`` tells which may be. Scores below ``limit`` merge. Equal scores are ordered by
    (smaller id, larger id), or with ``larger_first`` by the larger ids first.
    """
    value = value.copy()
    linked = np.ones(value.shape, bool) if linked is None else linked.copy()
    combine = COMBINE[linkage]
    out: list[tuple[int, int, float, int, int, int]] = []
    number = 0
    while len(ids) > 1:
        np.fill_diagonal(linked, False)
        score = value / (np.outer(sizes, sizes) * unit) if linkage == "average" else value
        score = np.where(linked, np.round(score, DIGITS), np.inf)
        # Among equal scores of a row the first choice is its smallest (or largest) partner.
        best = len(ids) - 1 - score[:, ::-1].argmin(1) if larger_first else score.argmin(1)
        rows = np.arange(len(ids))
        low = score[rows, best]
        fits = np.isfinite(low) & ((low < limit) if limit is not None else True)
        a = rows[fits & (best[best] == rows) & (rows < best)]
        if not len(a):
            break
        b = best[a]
        out += zip(ids[a].tolist(), ids[b].tolist(), low[a].tolist(), sizes[a].tolist(), sizes[b].tolist(), [number] * len(a), strict=True)
        number += 1
        for x, join in ((value, combine), (linked, np.logical_or)):
            x[a] = join(x[a], x[b])
            x[:, a] = join(x[:, a], x[:, b])
        sizes = sizes.copy()
        sizes[a] += sizes[b]
        stay = np.ones(len(ids), bool)
        stay[b] = False
        ids, sizes = ids[stay], sizes[stay]
        value, linked = value[np.ix_(stay, stay)], linked[np.ix_(stay, stay)]
    return out


def each_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each piece, which is the first column, from rows in order of it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        piece = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), len(piece)]
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            if first == last:
                continue
            if held and held[0].column(0)[0].as_py() != int(piece[first]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(first, last - first))
    if held:
        yield pa.Table.from_batches(held)


def merge_pieces(rows: DataFrame, solve: Callable[[pa.Table], Sequence[tuple]]) -> DataFrame:
    """Merges (piece, a, b, score, size_a, size_b, _round) that ``solve`` finds in each piece of
    ``rows``, whose first column ``piece`` is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["piece", "a", "b", "score", "size_a", "size_b", "_round"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32()]
        for table in each_piece(batches):
            piece = table.column(0)[0].as_py()
            found = [(piece, *m) for m in solve(table)]
            if found:
                columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    # A fixed number of tasks: adaptive execution would size them by bytes, which tell little of the work.
    tasks = 16 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks, "piece").sortWithinPartitions("piece").mapInArrow(run, MERGES)


def solve_edges(linkage: str, limit: float | None, similarity: bool) -> Callable[[pa.Table], list[tuple]]:
    """For rows (piece, a, b, size_a, size_b, value): a pair without a row is too far to merge
    (distances), or has no similarity."""
    fill = np.inf if not similarity else {"average": 0.0, "complete": -np.inf, "single": np.inf}[linkage]

    def solve(table: pa.Table) -> list[tuple]:
        a, b, size_a, size_b, given = (table.column(i).to_numpy() for i in range(1, 6))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        sizes = np.zeros(len(ids), np.int64)
        sizes[at] = np.concatenate([size_a, size_b])
        i, j = at[: len(a)], at[len(a) :]
        value = np.full((len(ids), len(ids)), fill)
        linked = np.zeros(value.shape, bool) if similarity else np.ones(value.shape, bool)
        value[i, j] = value[j, i] = given
        linked[i, j] = linked[j, i] = True
        return merge_rounds(ids, sizes, value, linkage, limit, similarity, linked)

    return solve


def _strings(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, copies and code points of rows (piece, id, copies, seq) with strings of one length."""
    ids, copies = (table.column(i).to_numpy() for i in (1, 2))
    order = np.argsort(ids)
    letters = np.array([np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in table.column(3).to_pylist()])[order]
    return ids[order], copies[order], letters


def solve_strings(limit: float) -> Callable[[pa.Table], list[tuple]]:
    """For rows (piece, id, copies, seq) with strings of one length: average linkage by mismatches."""

    def solve(table: pa.Table) -> list[tuple]:
        ids, copies, letters = _strings(table)
        mismatches = np.zeros((len(ids), len(ids)))
        for column in letters.T:
            mismatches += column[:, None] != column[None]
        return merge_rounds(ids, copies, mismatches * np.outer(copies, copies), "average", limit, unit=letters.shape[1])

    return solve


#: Distances that are worked out at a time.
CELLS = 2_000_000


def profile_rounds(
    ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray, length: int, limit: float | None = None
) -> list[tuple[int, int, float, int, int, int]]:
    """``merge_rounds`` of average linkage by mismatches, from letter counts and without a matrix.

    ``counts[i]`` has the letters of cluster i by place: two clusters agree as often as the
    products of their counts add up to. A cluster keeps its first choice as long as neither that nor
    itself is merged: the mean of two distances is never below both. Where the choice took in another
    cluster under its own name, it stays if it is as near as before. A cluster whose first choice
    is not below ``limit`` can never merge, and goes.
    """
    sizes, counts = sizes.astype(np.float64), counts.astype(np.float64)
    out: list[tuple[int, int, float, int, int, int]] = []
    gone = np.zeros(len(ids), bool)
    low, best = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64)
    ask = np.arange(len(ids))
    number = 0
    while len(ids) - gone.sum() > 1:
        step = max(1, CELLS // len(ids))
        for at in (ask[i : i + step] for i in range(0, len(ask), step)):
            pairs = sizes[at][:, None] * sizes * length
            score = np.round((pairs - counts[at] @ counts.T) / pairs, DIGITS)
            score[:, gone] = np.inf
            score[np.arange(len(at)), at] = np.inf
            best[at] = score.argmin(1)
            low[at] = score[np.arange(len(at)), best[at]]
        fits = ~gone & np.isfinite(low) & ((low < limit) if limit is not None else True)
        gone = ~fits
        rows = np.flatnonzero(fits)
        a = rows[(best[best[rows]] == rows) & (rows < best[rows])]
        if not len(a):
            break
        b = best[a]
        merged = np.rint(sizes).astype(np.int64)
        out += zip(ids[a].tolist(), ids[b].tolist(), low[a].tolist(), merged[a].tolist(), merged[b].tolist(), [number] * len(a), strict=True)
        number += 1
        counts[a] += counts[b]
        sizes[a] += sizes[b]
        gone[b] = True
        grown, lost = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        grown[a], lost[b] = True, True
        rows = np.flatnonzero(~gone)
        beside = rows[grown[best[rows]] & ~grown[rows]]
        far = low[beside]
        for i in range(0, len(beside), step):
            x = beside[i : i + step]
            y = best[x]
            pairs = sizes[x] * sizes[y] * length
            far[i : i + step] = np.round((pairs - np.einsum("ij,ij->i", counts[x], counts[y])) / pairs, DIGITS)
        again = grown | lost[best]
        again[beside[far != low[beside]]] = True
        if gone.sum() * 4 > len(ids):
            stay = ~gone
            new = np.cumsum(stay) - 1
            ids, sizes, counts, low, again = ids[stay], sizes[stay], counts[stay], low[stay], again[stay]
            best, gone = new[best[stay]], np.zeros(len(ids), bool)
        ask = np.flatnonzero(again & ~gone)
    return out


def solve_profiles(limit: float | None) -> Callable[[pa.Table], list[tuple]]:
    """``solve_strings`` for pieces too large for a matrix; ``limit`` None merges all."""

    def solve(table: pa.Table) -> list[tuple]:
        ids, copies, letters = _strings(table)
        columns = []
        for column in letters.T:
            kinds = np.unique(column)
            columns.append((column[:, None] == kinds) * copies[:, None])
        return profile_rounds(ids, copies, np.concatenate(columns, 1), letters.shape[1], limit)

    return solve


def _first_choices(a: np.ndarray, b: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """The edges, by number, that are the first choice of both their ends: of n clusters each takes
    the edge with the smallest (score, a, b)."""
    order = np.lexsort((b, a, score))
    back = np.arange(len(order))[::-1]
    first = np.full(n, len(order))
    for end in (a, b):
        mine = np.full(n, len(order))
        # The last one written, which is the first in order, stays.
        mine[end[order][::-1]] = back
        first = np.minimum(first, mine)
    at = np.arange(len(order))
    return order[(first[a[order]] == at) & (first[b[order]] == at)]


def _renamed(a: np.ndarray, b: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges after merges in order of their ends, and where they were; loops are left out."""
    a, b = np.minimum(to[a], to[b]), np.maximum(to[a], to[b])
    order = np.lexsort((b, a))
    order = order[a[order] != b[order]]
    return a[order], b[order], order


def edge_rounds(
    ids: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, value: np.ndarray, linkage: str, limit: float | None = None
) -> list[tuple[int, int, float, int, int, int]]:
    """``merge_rounds`` from the pairs a < b (indexes into ``ids``) that may merge, without a matrix.

    A pair without an edge is too far. Two clusters have an edge as long as all their member pairs
    do (single linkage: any).
    """
    sizes, known = sizes.copy(), sizes[a] * sizes[b]
    out: list[tuple[int, int, float, int, int, int]] = []
    number = 0
    while len(a):
        score = np.round(value / (sizes[a] * sizes[b]) if linkage == "average" else value, DIGITS)
        fits = np.isfinite(score) & ((score < limit) if limit is not None else True)
        if linkage != "average":
            # What is too far stays so; a mean can still fall.
            a, b, value, known, score = a[fits], b[fits], value[fits], known[fits], score[fits]
            fits = np.ones(len(a), bool)
        at = np.flatnonzero(fits)
        chosen = at[_first_choices(a[at], b[at], score[at], len(ids))]
        if not len(chosen):
            break
        x, y = a[chosen], b[chosen]
        out += zip(ids[x].tolist(), ids[y].tolist(), score[chosen].tolist(), sizes[x].tolist(), sizes[y].tolist(), [number] * len(x), strict=True)
        number += 1
        to = np.arange(len(ids))
        to[y] = x
        sizes[x] += sizes[y]
        a, b, order = _renamed(a, b, to)
        if not len(a):
            break
        start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        value, known = COMBINE[linkage].reduceat(value[order], start), np.add.reduceat(known[order], start)
        a, b = a[start], b[start]
        if linkage != "single":
            whole = known == sizes[a] * sizes[b]
            a, b, value, known = a[whole], b[whole], value[whole], known[whole]
    return out


def solve_sparse(linkage: str, limit: float | None) -> Callable[[pa.Table], list[tuple]]:
    """``solve_edges`` of distances for pieces of many clusters and few edges."""

    def solve(table: pa.Table) -> list[tuple]:
        a, b, size_a, size_b, given = (table.column(i).to_numpy() for i in range(1, 6))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        sizes = np.zeros(len(ids), np.int64)
        sizes[at] = np.concatenate([size_a, size_b])
        return edge_rounds(ids, sizes, at[: len(a)], at[len(a) :], given, linkage, limit)

    return solve


def letter_rounds(
    ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray, length: int, a: np.ndarray, b: np.ndarray, limit: float
) -> list[tuple[int, int, float, int, int, int]]:
    """``profile_rounds`` that looks at the pairs a < b (indexes into ``ids``) and what becomes of them only.

    These must be all pairs below ``limit``. A mean over two merged clusters is below it only if one
    of their own means was, so pairs of clusters that reach it are dropped for good.
    """
    sizes, counts = sizes.astype(np.float64), counts.astype(np.float64)
    step = max(1, CELLS // counts.shape[1])

    def means(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = np.empty(len(a))
        for i in range(0, len(a), step):
            x, y = a[i : i + step], b[i : i + step]
            pairs = sizes[x] * sizes[y] * length
            found[i : i + step] = np.round((pairs - np.einsum("ij,ij->i", counts[x], counts[y])) / pairs, DIGITS)
        return found

    out: list[tuple[int, int, float, int, int, int]] = []
    score, number = means(a, b), 0
    while True:
        fits = score < limit
        a, b, score = a[fits], b[fits], score[fits]
        if not len(a):
            return out
        chosen = _first_choices(a, b, score, len(ids))
        x, y = a[chosen], b[chosen]
        merged = np.rint(sizes).astype(np.int64)
        out += zip(ids[x].tolist(), ids[y].tolist(), score[chosen].tolist(), merged[x].tolist(), merged[y].tolist(), [number] * len(x), strict=True)
        number += 1
        counts[x] += counts[y]
        sizes[x] += sizes[y]
        to, grown = np.arange(len(ids)), np.zeros(len(ids), bool)
        to[y], grown[x] = x, True
        a, b, order = _renamed(a, b, to)
        start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])
        a, b, score = a[start], b[start], score[order][start]
        again = grown[a] | grown[b]
        score[again] = means(a[again], b[again])


def solve_letters(limit: float) -> Callable[[pa.Table], list[tuple]]:
    """For rows (piece, a, b, copies, seq): strings of one length (a = b, their id) and the pairs
    a < b of them below ``limit`` (no seq). Average linkage by letter counts."""

    def solve(table: pa.Table) -> list[tuple]:
        own = pc.equal(table.column(1), table.column(2))
        ids, copies, letters = _strings(table.filter(own).select([0, 1, 3, 4]))
        pairs = table.filter(pc.invert(own))
        a, b = (np.searchsorted(ids, pairs.column(i).to_numpy()) for i in (1, 2))
        columns = []
        for column in letters.T:
            kinds = np.unique(column)
            columns.append((column[:, None] == kinds) * copies[:, None])
        return letter_rounds(ids, copies, np.concatenate(columns, 1), letters.shape[1], a, b, limit)

    return solve


def dense_rounds(
    ids: np.ndarray,
    sizes: np.ndarray,
    value: np.ndarray,
    linkage: str,
    limit: float | None = None,
    larger_first: bool = False,
    linked: np.ndarray | None = None,
) -> list[tuple[int, int, float, int, int, int]]:
    """``merge_rounds`` within the memory of ``value``, which is overwritten, for large matrices.

    A cluster keeps its first choice as long as neither that nor itself is merged: the value of a
    union is never below both. So in each round only the others look for theirs again. With single linkage
    it can be as low as one of them under a smaller name, so there all do.
    """
    combine, flat = COMBINE[linkage], [x if x is None else x.reshape(-1) for x in (value, linked)]
    sizes = sizes.astype(np.float64)
    out: list[tuple[int, int, float, int, int, int]] = []
    gone = np.zeros(len(ids), bool)
    low, best = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64)
    ask, number = np.arange(len(ids)), 0
    while len(ids):
        step = max(1, CELLS // 4 // len(ids))
        for at in (ask[i : i + step] for i in range(0, len(ask), step)):
            score, rows = value[at], np.arange(len(at))
            if linkage == "average":
                score /= sizes[at][:, None] * sizes
            np.round(score, DIGITS, out=score)
            score[:, gone] = np.inf
            if linked is not None:
                score[~linked[at]] = np.inf
            score[rows, at] = np.inf
            best[at] = len(ids) - 1 - score[:, ::-1].argmin(1) if larger_first else score.argmin(1)
            low[at] = score[rows, best[at]]
        fits = ~gone & np.isfinite(low) & ((low < limit) if limit is not None else True)
        rows = np.flatnonzero(fits)
        a = rows[(best[best[rows]] == rows) & (rows < best[rows])]
        if not len(a):
            break
        b = best[a]
        whole = np.rint(sizes).astype(np.int64)
        out += zip(ids[a].tolist(), ids[b].tolist(), low[a].tolist(), whole[a].tolist(), whole[b].tolist(), [number] * len(a), strict=True)
        number += 1
        for x, join in ((value, combine), (linked, np.logical_or)):
            if x is None:
                continue
            for i in range(0, len(a), step):
                x[a[i : i + step]] = join(x[a[i : i + step]], x[b[i : i + step]])
            for i in range(0, len(ids), step):
                part = x[i : i + step]
                part[:, a] = join(part[:, a], part[:, b])
        sizes[a] += sizes[b]
        gone[b] = True
        moved = gone.copy()
        moved[a] = True
        again = moved | moved[best] | (linkage == "single")
        if gone.sum() * 4 > len(ids):
            stay = np.flatnonzero(~gone)
            new, n = np.cumsum(~gone) - 1, len(stay)
            for k, x in enumerate((value, linked)):
                if x is not None:
                    # Each row moves up, onto rows that have been moved.
                    for i, row in enumerate(stay.tolist()):
                        flat[k][i * n : (i + 1) * n] = x[row, stay]
            value, linked = (x if x is None else x[: n * n].reshape(n, n) for x in flat)
            ids, sizes, low, again = ids[stay], sizes[stay], low[stay], again[stay]
            best, gone = new[best[stay]], np.zeros(n, bool)
        ask = np.flatnonzero(again & ~gone)
    return out


#: Columns of a pair that are packed, and those of a run of packed pairs beside the group columns.
PAIR = ("a", "b", "size_a", "size_b", "value")
RUN = "_n long, _ends array<long>, _pairs binary"


def pack_pairs(batches: Iterator[pa.RecordBatch], most: int, least: int) -> Iterator[pa.RecordBatch]:
    """Rows (group columns, _key, then ``PAIR``) with runs of rows of one ``_key`` put into one row: its first row's
    columns, the number of pairs, their ends and the pairs, compressed. Shorter runs than ``least`` stay rows
    and have null for these three."""
    held: list[pa.RecordBatch] = []

    def packed() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        columns = {}
        for name in PAIR:
            code = table.column(name).combine_chunks().dictionary_encode()
            code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
            kind = next(k for k in (np.uint8, np.uint16, np.uint32) if len(code.dictionary) <= np.iinfo(k).max)
            index = code.indices.to_numpy(zero_copy_only=False).astype(kind)
            columns[name] = pa.DictionaryArray.from_arrays(pa.array(index), code.dictionary)
        batch = pa.RecordBatch.from_pydict(columns)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            out.write_batch(batch)
        ends = np.unique(np.concatenate([columns[c].dictionary.to_numpy() for c in ("a", "b")]))
        first = held[0].slice(0, 1)
        new = [pa.array([len(table)], pa.int64()), pa.array([ends], pa.list_(pa.int64())), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
        return pa.RecordBatch.from_arrays([*first.columns, *new], names=[*first.schema.names, "_n", "_ends", "_pairs"])

    def loose(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = [pa.nulls(len(batch), k) for k in (pa.int64(), pa.list_(pa.int64()), pa.binary())]
        return pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "_n", "_ends", "_pairs"])

    for batch in batches:
        key = batch.column("_key").to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        short: list[pa.RecordBatch] = []
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(first, last - first)
            if held and held[0].column("_key")[0].as_py() != int(key[first] if last > first else 0):
                yield packed()
                held = []
            if held or last - first >= least:
                held.append(part)
                if sum(map(len, held)) >= most:
                    yield packed()
                    held = []
            elif last > first:
                short.append(part)
        if short:
            yield loose(pa.Table.from_batches(short).combine_chunks().to_batches()[0])
    if held:
        yield packed()


def _codes(run: pa.Buffer) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each column of ``PAIR`` of a run of packed pairs its values and which of them the pairs have."""
    table = pa.ipc.open_stream(run).read_all()
    columns = [table.column(c).combine_chunks() for c in PAIR]
    columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return [(c.dictionary.to_numpy(), c.indices.to_numpy()) for c in columns]


def unpacked(run: pa.Buffer) -> list[np.ndarray]:
    """The columns ``PAIR`` of a run of packed pairs."""
    return [values[at] for values, at in _codes(run)]


def solve_packed(linkage: str, limit: float | None, similarity: bool) -> Callable[[pa.Table], list[tuple]]:
    """``solve_edges`` for rows (piece, ``PAIR``, _pairs) of runs of packed pairs and of pairs that are not packed."""
    fill = np.inf if not similarity else {"average": 0.0, "complete": -np.inf, "single": np.inf}[linkage]

    def solve(table: pa.Table) -> list[tuple]:
        loose = table.filter(pc.is_null(table.column("_pairs")))
        runs = table.column("_pairs").drop_null()

        def parts() -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
            if len(loose):
                yield [(x := loose.column(c).to_numpy(), np.arange(len(x))) for c in PAIR]
            for run in runs:
                yield _codes(run.as_buffer())

        ids = np.unique(np.concatenate([np.unique(x) for a, b, *_ in parts() for x, _ in (a, b)]))
        n = len(ids)
        value, sizes = np.full((n, n), fill), np.zeros(n, np.int64)
        linked = np.zeros((n, n), bool) if similarity else None
        for a, b, *others in parts():
            i, j = (np.searchsorted(ids, x)[at] for x, at in (a, b))
            sizes[i], sizes[j], x = (x[at] for x, at in others)
            value[i, j] = value[j, i] = x
            if similarity:
                linked[i, j] = linked[j, i] = True
        if similarity and linked.sum() == n * (n - 1):
            linked = None
        return dense_rounds(ids, sizes, value, linkage, limit, similarity, linked)

    return solve
