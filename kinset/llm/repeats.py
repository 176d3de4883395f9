"""Repeated byte strings by the common-prefix interval tree of suffix arrays.

Texts are cut into segments by anchor (``anchors``), and the distinct segments of an
anchor are compared: their suffixes of at least ``length`` bytes are sorted, common
prefixes of neighbours computed, and a scan with a stack yields the intervals of
suffixes that share a prefix. An interval whose suffixes do not all have the same byte
before them is a maximal repeat: it cannot be extended to the left without losing an
occurrence, nor to the right. Every occurrence is put out, under the longest repeat
that begins there; the repeat that an interval lies in is its parent, so shorter
repeats of the same place follow from the parents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinset.llm.anchors import Unit, classes_of, cut_spans, merged, put_together, segments, take_apart, text_buffers_of, text_rows
from kinset.llm.text import SpanHasher
from kinset.operators.joins import attach, join_keys
from kinset.plans.session import settle

#: Bytes of an anchor's n-gram.
GRAM = 80
#: Bytes of segments whose suffixes are sorted together (whole anchors).
BATCH = 1 << 20
#: Bytes compared at once: as digits of base 257, 7 fit in 64 bits, 0 being the end.
DIGITS = 7


def suffix_order(contents: list[bytes], group: np.ndarray, length: int, hasher: SpanHasher):
    """The suffixes of at least ``length`` bytes that share a group and their first
    ``length`` bytes with another: sorted, with content, start, and common prefix with the
    suffix before (0 where the first ``length`` bytes or the group differ)."""
    data, offsets = text_buffers_of(contents)
    size = np.diff(offsets)
    n = np.maximum(size - length + 1, 0)
    content = np.repeat(np.arange(len(contents)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = offsets[content] + start
    head = hasher.spans(hasher.sums(data), at, at + length)
    order = np.lexsort((head, group[content]))
    h, g = head[order], group[content[order]]
    same = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    order = order[keep]
    if len(order) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    new = np.concatenate([[True], ~same])[keep]
    rank = np.cumsum(new)
    content, start, at = content[order], start[order], at[order]
    # What follows the first ``length`` bytes, as numbers that sort as the bytes do.
    left = size[content] - start - length
    words = max(-(-int(left.max()) // DIGITS), 1)
    padded = np.concatenate([data, np.zeros(DIGITS, np.uint8)]).astype(np.uint64)
    tails = np.zeros((words, len(order)), np.uint64)
    for w in range(words):
        for d in range(DIGITS):
            i = w * DIGITS + d
            there = i < left
            byte = np.where(there, padded[np.minimum(at + length + i, len(data))] + np.uint64(1), np.uint64(0))
            tails[w] = tails[w] * np.uint64(257) + byte
    final = np.lexsort((*tails[::-1], rank))
    content, start, rank, tails, left = content[final], start[final], rank[final], tails[:, final], left[final]
    common = np.zeros(len(order), np.int64)
    differ = tails[:, 1:] != tails[:, :-1]
    full = np.where(differ.any(0), differ.argmax(0), words)
    common[1:] = full * DIGITS
    part = np.flatnonzero(full < words)
    if len(part):
        # Digits in which the differing numbers agree from the front.
        x, y = tails[full[part], part], tails[full[part], part + 1]
        agree = np.zeros(len(part), np.int64)
        for d in range(1, DIGITS):
            scale = np.uint64(257 ** (DIGITS - d))
            agree += x // scale == y // scale
        common[1:][part] += agree
    common[1:] = np.minimum(common[1:], np.minimum(left[1:], left[:-1])) + length
    common[1:][rank[1:] != rank[:-1]] = 0
    common[0] = 0
    return content, start, common


def intervals(common: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Repeats of sorted suffixes: (group of each suffix or -1; length and parent of groups).

    ``before`` numbers what stands before each suffix; a text's beginning has a number of
    its own. A scan from left to right keeps the open intervals on a stack. An interval
    is a repeat if ``before`` differs within it; each suffix belongs to its innermost repeat.
    """
    n = len(common)
    change = np.zeros(n + 1, np.int64)
    change[1:n] = np.cumsum(before[1:] != before[:-1])
    changes = change.tolist()
    depth = common.tolist() + [0]
    first, last, lengths = [], [], []
    stack: list[tuple[int, int]] = []  # common prefix, first suffix
    for i in range(1, n + 1):
        begin = i - 1
        d = depth[i] if i < n else 0
        while stack and stack[-1][0] > d:
            length, begin = stack.pop()
            if changes[i - 1] != changes[begin]:
                first.append(begin)
                last.append(i - 1)
                lengths.append(length)
        if d and (not stack or stack[-1][0] < d):
            stack.append((d, begin))
    if not first:
        return np.full(n, -1), *[np.zeros(0, np.int64)] * 3
    # Inner intervals close first, so an outer one never overwrites them.
    group, parent = np.full(n, -1), np.full(len(first), -1)
    outer = np.full(n, -1)
    for number in range(len(first) - 1, -1, -1):
        a, b = first[number], last[number] + 1
        parent[number] = outer[a]
        outer[a:b] = number
        group[a:b] = number
    return group, np.array(lengths), parent, np.array(first)


def repeats_of_segments(rows: DataFrame, length: int) -> DataFrame:
    """(gram, seg, start, size, repeat, parent): the longest repeat at each place of distinct
    segments where one begins. ``rows``: gram, seg, times, content, by anchor in order; a row
    has the number of occurrences of a segment, or its content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher(256, seed=43)
        names = ["gram", "seg", "start", "size", "repeat", "parent"]
        held: dict[tuple[int, int], list] = {}
        volume, last = 0, None

        def finish() -> pa.RecordBatch | None:
            keys = [k for k, (_, c) in held.items() if c is not None]
            if not keys:
                return None
            times = np.array([held[k][0] for k in keys])
            contents = [held[k][1] for k in keys]
            grams = np.array([k[0] for k in keys], np.int64)
            segs = np.array([k[1] for k in keys], np.int64)
            # A segment that occurs more than once is a repeat as a whole.
            whole = np.flatnonzero(times > 1)
            size = np.array([len(c) for c in contents])
            rows = [(whole, np.zeros(len(whole), np.int64), size[whole], segs[whole], np.zeros(len(whole), np.int64))]
            _, group = np.unique(grams, return_inverse=True)
            company = np.bincount(group)[group] > 1
            some = np.flatnonzero(company | np.array([repeats_itself(c, length) for c in contents]))
            if len(some):
                picked = [contents[i] for i in some]
                content, start, common = suffix_order(picked, group[some], length, hasher)
                byte = np.array([picked[c][s - 1] if s else -1 - c for c, s in zip(content.tolist(), start.tolist(), strict=True)], np.int64)
                belongs, lengths, parent, first = intervals(common, byte)
                hit = np.flatnonzero(belongs >= 0)
                if len(hit):
                    number = mix_ids(segs[some][content[first]], start[first], lengths)
                    up = np.where(parent[belongs[hit]] >= 0, number[parent[belongs[hit]]], 0)
                    rows.append((some[content[hit]], start[hit], lengths[belongs[hit]], number[belongs[hit]], up))
            which, start, size, repeat, parent = (np.concatenate(x) for x in zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(grams[which]), pa.array(segs[which]), pa.array(start.astype(np.int32)),
                 pa.array(size.astype(np.int32)), pa.array(repeat), pa.array(parent)], names=names,
            )

        for batch in batches:
            grams, segs, times = (batch.column(i).to_pylist() for i in range(3))
            contents = batch.column(3)
            for i, gram in enumerate(grams):
                if gram != last and volume > BATCH:
                    if (done := finish()) is not None:
                        yield done
                    held, volume = {}, 0
                last = gram
                entry = held.setdefault((gram, segs[i]), [0, None])
                if times[i] is not None:
                    entry[0] = times[i]
                elif entry[1] is None:
                    entry[1] = contents[i].as_py()
                    volume += len(entry[1])
        if (done := finish()) is not None:
            yield done

    return rows.mapInArrow(run, "gram long, seg long, start int, size int, repeat long, parent long")


def repeats_itself(content: bytes, length: int) -> bool:
    """Whether a segment may hold two equal windows: only if it has a period."""
    return len(content) > length and content.find(content[:16], 1) >= 0 or any(
        content.find(content[i : i + 16], i + 1) >= 0 for i in range(16, len(content) - length, 16)
    )


def mix_ids(seg: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    from kinset.llm.text import mix

    h = mix(seg.view(np.uint64) + start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mix(h + size.astype(np.uint64)).view(np.int64)


def find_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200):
    """Repeats of at least ``length`` bytes in the texts of ``df``.

    Returns the facts and classes of ``anchors.classes_of`` and the occurrences (rep, at,
    size, repeat, parent) within the representatives of equal texts: place in bytes, length,
    number of the repeat and of the one it is part of (0: none). A repeat is maximal within
    the segment of its anchor; longer ones show as overlapping occurrences.
    """
    unit = Unit(False, length, min(GRAM, length))
    docs = text_rows(df, key, text)
    facts, classes = classes_of(docs, unit)
    cut = settle(segments(docs, unit, classes))
    distinct, contents, levels = take_apart(cut, unit)
    rows = distinct.select("gram", "seg", "times", F.lit(None).cast("binary").alias("content")).unionByName(
        contents.select("gram", "seg", F.lit(None).cast("long").alias("times"), "content")
    )
    rows = rows.repartition("gram").sortWithinPartitions("gram")
    found = repeats_of_segments(rows, length)
    by_segment = settle(
        found.groupBy("gram", "seg").agg(F.collect_list(F.struct("start", "size", "repeat", "parent")).alias("r"))
    )
    moved = lambda r: F.struct((r["start"] + F.col("off")).alias("start"), r["size"].alias("size"), r["repeat"].alias("repeat"), r["parent"].alias("parent"))
    by_segment = put_together(by_segment, levels, {"r": lambda: F.transform("_r", moved)}).withColumnRenamed("r", "_r")
    # One row for each key on the right, so Spark can split the rows of a frequent one.
    occurrences = join_keys(cut.select("gram", "seg", "rep", "lo"), by_segment, ["gram", "seg"], "inner")
    return unit, facts, classes, occurrences


def remove_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, whole_characters: bool = False
) -> DataFrame:
    """``df`` with ``kept`` (bytes that remain), n_bytes, n_removed, n_spans, span_starts and
    span_ends: every byte covered by a string of ``length`` bytes that also begins at another
    place of any text is removed. Overlaps count, and strings are judged on the input.

    A null text counts as empty; texts shorter than ``length`` lose nothing; of equal texts
    of that length nothing remains. Repeated rows count as equal texts. Rows with a null key
    are left as they are and not compared. Columns of the result's names are replaced, others
    stay. With ``whole_characters`` spans shrink to whole UTF-8 characters.
    """
    unit, facts, classes, occurrences = find_repeats(df, key, text, length)
    places = occurrences.select(
        "rep", F.explode(F.transform("_r", lambda r: F.struct((F.col("lo") + r["start"]).alias("s"), r["size"].alias("n")))).alias("x")
    )
    # Starts of a text with the longest string there: at most one for each of its bytes.
    spans = places.groupBy("rep", "x.s").agg(F.max("x.n").alias("n")).groupBy("rep").agg(
        F.collect_list(F.col("s")).alias("starts"), F.collect_list(F.expr("s + n")).alias("ends")
    )
    single = classes.where("copies = 1").join(spans, "rep").select(F.col("rep").alias("_id"), "key", "starts", "ends")
    equal = classes.where(f"copies > 1 and n >= {length}").select("key", "n")
    many = attach(facts, equal.withColumnRenamed("n", "_m"), ["key"], facts.count(), "inner").where("n = _m").distinct()
    whole = many.select(
        "_id", "key", F.array(F.lit(0)).alias("starts"), F.array(F.col("n").cast("int")).alias("ends")
    )

    def cut(part: bytes, starts: list[int], ends: list[int]) -> tuple:
        s, e = merged(np.array(starts, np.int64), np.array(ends, np.int64))
        s, e = s.tolist(), e.tolist()
        if whole_characters:
            inside = lambda i: i < len(part) and part[i] & 0xC0 == 0x80
            s = [next(j for j in range(i, i + 4) if not inside(j)) for i in s]
            e = [next(j for j in range(i, i - 4, -1) if not inside(j)) for i in e]
            s, e = map(list, zip(*[(i, j) for i, j in zip(s, e, strict=True) if i < j], strict=True)) if s else (s, e)
        kept, at = [], 0
        for i, j in zip(s, e, strict=True):
            kept.append(part[at:i])
            at = j
        kept.append(part[at:])
        return b"".join(kept), len(part), sum(e) - sum(s), len(s), s, e

    schema = "kept binary, n_bytes long, n_removed long, n_spans long, span_starts array<int>, span_ends array<int>"
    return cut_spans(df, key, text, unit, single.unionByName(whole), cut, schema)
