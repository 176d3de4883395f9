"""Finding where texts may repeat each other: anchors, segments, removal spans.

A text is a sequence of symbols (bytes or words). In every window of ``length``
symbols the n-gram with the smallest hash (the last one at a tie) is the window's
anchor, so equal windows have their anchor at the same place. Anchors whose n-gram
occurs once in the corpus are dropped; for the others the segment, which is all
windows with that anchor, is cut out of its text. Two equal windows always lie in
segments with the same anchor n-gram, so segments of one anchor are compared with
each other only.

Equal texts are reduced to one representative first. What moves between tasks is
one small row per anchor, the texts that have repeated anchors (compressed), and
their segments; equal segments of a task are handed on once. An anchor with very many
distinct segments, such as one inside a passage that stands in many surroundings, is taken
apart: equal windows hold it at one place, so windows with the anchor in their first half and
in their second half are compared apart, and only with those that agree on all words around
the anchor which these windows share. What a task compares is bounded that way. Only distinct
segments are taken apart; what is found out about the parts is put together for the segment.

Texts, segments and n-grams are told apart by hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinset.llm.text import (
    SpanHasher,
    WordHasher,
    each_text,
    forget,
    fresh,
    mix,
    pack,
    signed,
    slices,
    unpack,
    word_spans,
    word_table,
)
from kinset.operators.joins import attach
from kinset.plans.session import is_empty, settle

#: Symbols whose windows are looked at together.
STRIDE = 1 << 20
#: Bits of the filter that keeps texts without a repeat from being moved; a fixed size.
FILTER_BITS = 1 << 23
#: Distinct segments of one anchor that a task compares; with more they are taken apart (cost only).
CROWD = 1000
#: Shares into which the rows of a frequent n-gram are split, and n-grams that can be frequent.
SHARES, FREQUENT = 64, 1000


@dataclass(frozen=True)
class Unit:
    """What repeats are made of: bytes, or words of the text as it stands."""

    words: bool
    length: int
    gram: int

    @property
    def span(self) -> int:
        return self.length - self.gram + 1


class Symbols:
    """Symbols of texts as running hash sums."""

    def __init__(self, unit: Unit):
        forget()
        self.unit = unit
        self.bytes, self.places = SpanHasher(256, seed=31), SpanHasher(2)
        self.word_hasher = WordHasher(lower=False) if unit.words else None

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash sums over all symbols of rows, and how many come before each row."""
        if self.word_hasher is None:
            return self.bytes.sums(data), offsets
        hashes, first = self.word_hasher.of(data, offsets)
        return self.places.value_sums(hashes), first

    @property
    def hasher(self) -> SpanHasher:
        return self.bytes if self.word_hasher is None else self.places

    def keys(self, sums: np.ndarray, first: np.ndarray) -> np.ndarray:
        """One number per row; equal rows have equal numbers."""
        return signed(self.hasher.spans(sums, first[:-1], first[1:]))


def anchors(sums: np.ndarray, first: np.ndarray, hasher: SpanHasher, unit: Unit):
    """Anchors of all rows: row, n-gram hash, place, first and last start of its windows
    (places count from the row's beginning)."""
    total, w, g = len(sums) - 1, unit.span, unit.gram
    row_of_start, at, starts = [], [], []
    for base in range(0, max(total - unit.length + 1, 0), STRIDE):
        stop = min(base + STRIDE, total - unit.length + 1)  # window starts base..stop-1
        grams = np.arange(base, stop + w - 1)
        h = hasher.spans(sums, grams, grams + g)
        low = (h & ~np.uint64((1 << 22) - 1)) | np.arange((1 << 22) - 1, (1 << 22) - 1 - len(h), -1).astype(np.uint64)
        size = 1
        while size * 2 <= w:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < w:
            low = np.minimum(low[: stop - base], low[w - size : w - size + stop - base])
        place = base + (1 << 22) - 1 - (low[: stop - base] & np.uint64((1 << 22) - 1)).astype(np.int64)
        own = np.arange(base, stop)
        row = np.searchsorted(first, own, side="right") - 1
        inside = own + unit.length <= first[row + 1]
        row_of_start.append(row[inside])
        at.append(place[inside])
        starts.append(own[inside])
    if not at:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, none, none
    row, place, start = (np.concatenate(x) for x in (row_of_start, at, starts))
    if len(row) == 0:
        return row, row.view(np.uint64), row, row, row
    new = np.ones(len(row), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    i = np.flatnonzero(new)
    last = np.append(i[1:], len(row)) - 1
    r, p = row[i], place[i]
    begin = first[r]
    return r, hasher.spans(sums, p, p + g), p - begin, start[i] - begin, start[last] - begin


def describe(docs: DataFrame, unit: Unit) -> DataFrame:
    """(_id, key, n): key and number of symbols of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(unit)
        for batch in batches:
            keys, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in each_text(batch.column(1)):
                sums, first = symbols.of(data, offsets)
                keys.append(symbols.keys(sums, first))
                n.append(np.diff(first))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(keys)), pa.array(np.concatenate(n))],
                names=["_id", "key", "n"],
            )

    return docs.mapInArrow(run, "_id long, key long, n long")


def anchor_rows(docs: DataFrame, unit: Unit, frequent: list[int] = ()) -> DataFrame:
    """(gram, key, at, share): anchors of each text, once per task and text. ``at`` packs where the
    first and the last window of the anchor begin, in 31 bits each (a text has fewer than 2^31
    symbols). Rows of the ``frequent`` n-grams, of which there are few, have one of several shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, seen, often = Symbols(unit), set(), np.array(sorted(frequent), np.int64)
        for batch in batches:
            for _, _, data, offsets in each_text(batch.column(1)):
                sums, first = symbols.of(data, offsets)
                keys = symbols.keys(sums, first)
                row, gram, _, lo, hi = anchors(sums, first, symbols.hasher, unit)
                new = np.array([not (k in seen or seen.add(k)) for k in keys.tolist()], bool)
                keep = new[row]
                at = ((lo << 31) | hi)[keep]
                gram, key = signed(gram[keep]), keys[row[keep]]
                share = np.where(np.isin(gram, often), (mix(key.view(np.uint64)) % np.uint64(SHARES)).astype(np.int32), 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram), pa.array(key), pa.array(at), pa.array(share.astype(np.int32))],
                    names=["gram", "key", "at", "share"],
                )

    return docs.mapInArrow(run, "gram long, key long, at long, share int")


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bits (a fixed number) set at the hashes of the ids in the only column."""
    parts = 16
    per_part = FILTER_BITS // parts

    def bits_of(ids: np.ndarray) -> np.ndarray:
        return (mix(ids.view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[bits_of(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))] = True
        blobs = [zlib.compress(np.packbits(bits[i * per_part : (i + 1) * per_part]).tobytes(), 1) for i in range(parts)]
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bits = np.frombuffer(zlib.decompress(blob), np.uint8)
                found[part] = found[part] | bits if part in found else bits
        blobs = [zlib.compress(b.tobytes(), 1) for b in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "bits"])

    import zlib

    schema = "part int, bits binary"
    rows = ids.mapInArrow(make, schema).repartition(parts, "part").mapInArrow(join, schema).collect()
    out = np.zeros((parts, per_part // 8), np.uint8)
    for r in rows:
        out[r["part"]] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out.ravel()


def matching(batch: pa.RecordBatch, key: str, bits: np.ndarray, wanted: bool = True) -> pa.RecordBatch:
    """Rows whose id may be in the filter, or (``wanted`` false) those whose id is not."""
    ids = batch.column(batch.schema.get_field_index(key)).cast(pa.int64())
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    at = mix(ids.fill_null(0).to_numpy().view(np.uint64)) % np.uint64(FILTER_BITS)
    hit = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1
    return batch.filter(pa.array((hit.astype(bool) & known) == wanted))


def rows_in(df: DataFrame, key: str, bits: np.ndarray, wanted: bool = True) -> DataFrame:
    """``matching`` rows of a table."""
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield matching(part, key, shared.value, wanted)

    return df.mapInArrow(run, df.schema)


class Slicer:
    """Cuts runs of symbols out of one text."""

    def __init__(self, unit: Unit):
        self.unit, self.inside = unit, word_table()

    def symbols(self, text: bytes):
        """What ``cut`` takes: the text, or the places of its words."""
        if not self.unit.words:
            return text, None, None
        data = np.frombuffer(text, np.uint8)
        starts, ends, _ = word_spans(data, np.array([0, len(data)]), self.inside)
        return text, starts, ends

    def cut(self, symbols, lo: int, hi: int) -> bytes:
        text, starts, ends = symbols
        if starts is None:
            return text[lo:hi]
        return b" ".join([text[s:e] for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)])


def segments(docs: DataFrame, unit: Unit, classes: DataFrame) -> DataFrame:
    """(gram, seg, rep, lo, size, content): segments of all anchors that occur more than once.

    ``seg`` is the hash of the content, which is null where the same task has handed it
    on already. ``classes``: key, n, rep, copies.
    """
    # Each task sums up an n-gram before it is moved.
    sums = anchor_rows(docs, unit).groupBy("gram").agg(
        F.min("key").alias("_a"), F.max("key").alias("_b"), F.min("at").alias("_c"), F.max("at").alias("_d"),
        F.count(F.lit(1)).alias("n"),
    )
    several = settle(sums.where("_a <> _b or _c <> _d").select("gram", "n"))
    total = several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Fewer than FREQUENT n-grams can have so large a share of the rows.
    often = [r["gram"] for r in several.where(F.col("n") > total // FREQUENT).orderBy(F.desc("n")).limit(FREQUENT).collect()]
    shares = F.when(F.col("n") > total // FREQUENT, SHARES).otherwise(1)
    several = several.select("gram", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    # Copies of a text in several tasks fall together in the set.
    found = anchor_rows(docs, unit, often).join(several, ["gram", "share"])
    per_text = found.groupBy("key").agg(F.collect_set(F.struct("gram", "at")).alias("found"))
    # One list for a text, no longer than the text.
    lists = settle(per_text.join(classes.select("key", "rep"), "key").select("rep", "found", "key"))
    bits = id_filter(lists.select("rep"))
    texts = packed_with_key(docs, unit, bits)
    joined = texts.join(lists, (texts["_id"] == lists["rep"]) & (texts["_key"] == lists["key"]))
    joined = joined.select("rep", "_packed", F.col("found.gram").alias("grams"), F.col("found.at").alias("ats"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slicer, places, seen = Slicer(unit), SpanHasher(256, seed=41), set()
        names = ["gram", "seg", "rep", "lo", "size", "content"]
        for batch in batches:
            for first in range(0, batch.num_rows, 100):
                part = batch.slice(first, 100)
                out: list[list] = [[], [], [], [], []]
                packed = unpack(part.column(1).to_pylist())
                for rep, text, grams, ats in zip(
                    part.column(0).to_pylist(), packed, part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True
                ):
                    symbols = slicer.symbols(text)
                    for gram, at in zip(grams, ats, strict=True):
                        lo, hi = at >> 31, (at & (1 << 31) - 1) + unit.length
                        for x, v in zip(out, (gram, rep, lo, hi - lo, slicer.cut(symbols, lo, hi)), strict=True):
                            x.append(v)
                grams, reps, los, sizes, contents = out
                if not grams:
                    continue
                data, offsets = text_buffers_of(contents)
                segs = signed(places.spans(places.sums(data), offsets[:-1], offsets[1:]))
                new = [not ((s, g) in seen or seen.add((s, g))) for s, g in zip(segs.tolist(), grams, strict=True)]
                if len(seen) > 2_000_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams, pa.int64()), pa.array(segs), pa.array(reps, pa.int64()), pa.array(los, pa.int32()), pa.array(sizes, pa.int32()),
                     pa.array([c if n else None for c, n in zip(contents, new, strict=True)], pa.binary())],
                    names=names,
                )

    return joined.mapInArrow(run, "gram long, seg long, rep long, lo int, size int, content binary")


def halves(own: DataFrame, unit: Unit) -> DataFrame:
    """(gram, seg, least, times, g2, s2, low, high, off, size, content): both parts of distinct
    segments. ``own``: gram, seg, least, times, low, high, content, where the windows have their
    anchor ``low`` to ``high`` symbols from their beginning.

    A part has the windows of one half of that range. All of them hold the symbols between the
    beginning of the last and the end of the first that the range allows; equal windows agree on
    these, so with n-gram and range they make the part's new number ``g2``. ``s2`` numbers the part
    itself; off and size tell its place in the segment. The content is null where the same
    task has handed it on already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, inside, hasher, seen = Symbols(unit), word_table(), SpanHasher(256, seed=41), set()
        names = ["gram", "seg", "least", "times", "g2", "s2", "low", "high", "off", "size", "content"]
        for batch in (part for whole in batches for part in slices(whole, 1000)):
            columns = [batch.column(i).to_numpy() for i in range(6)]
            data, offsets = text_buffers_of(batch.column(6).to_pylist())
            raw, byte_sums = data.tobytes(), hasher.sums(data)
            sums, first = symbols.of(data, offsets)
            # All windows of a segment have its anchor.
            row, _, place, _, last = anchors(sums, first, symbols.hasher, unit)
            if unit.words:
                starts, ends, _ = word_spans(data, offsets, inside)
            gram, seg, least, times, low, high = (c[row] for c in columns)
            middle = (low + high) // 2
            for lo, hi in ((low, middle), (middle + 1, high)):
                begin, stop = np.maximum(place - hi, 0), np.minimum(place - lo, last) + unit.length
                fits = stop - begin >= unit.length
                r, lo, hi, b, e, p = (x[fits] for x in (row, lo, hi, begin, stop, place))
                core = symbols.hasher.spans(sums, first[r] + p - lo, first[r] + p - hi + unit.length)
                where = lo.astype(np.uint64) << np.uint64(32) | hi.astype(np.uint64)
                g2 = mix(mix(gram[fits].view(np.uint64) + where) + core)
                if unit.words:
                    x, y = starts[first[r] + b], ends[first[r] + e - 1]
                else:
                    x, y = offsets[r] + b, offsets[r] + e
                s2 = mix(hasher.spans(byte_sums, x, y) + (p - b).astype(np.uint64))
                pairs = zip(g2.tolist(), s2.tolist(), strict=True)
                new = [not (k in seen or seen.add(k)) for k in pairs]
                content = [raw[i:j] if n else None for i, j, n in zip(x.tolist(), y.tolist(), new, strict=True)]
                out = [gram[fits], seg[fits], least[fits], times[fits], signed(g2), signed(s2), lo, hi, b.astype(np.int32), (e - b).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(content, pa.binary())], names=names)
            if len(seen) > 1_000_000:
                seen.clear()

    columns = "gram long, seg long, least long, times long, g2 long, s2 long, low int, high int, off int, size int, content binary"
    return own.select("gram", "seg", "least", "times", "low", "high", "content").mapInArrow(run, columns)


def take_apart(cut: DataFrame, unit: Unit) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """What is to be compared of the segments ``cut``: distinct segments or parts (gram, seg, times,
    least), their contents (gram, seg, content), and for each time that crowded anchors were taken
    apart the table (gram, seg, least, g2, s2, off, size) of segments and their parts.

    ``least`` is the smallest rep that holds a segment, ``times`` how often it occurs. Anchors with
    more than ``CROWD`` distinct segments are taken apart by ``halves`` until they have fewer; when
    the range is one place, a part is one window and equal windows are one part. Each segment has
    at most two parts each time, and each of its windows is in one of them.
    """
    counts = cut.groupBy("gram", "seg").agg(F.count(F.lit(1)).alias("times"), F.min("rep").alias("least"))
    counts = settle(counts.withColumn("low", F.lit(0)).withColumn("high", F.lit(unit.span - 1)))
    contents = cut.where("content is not null").select("gram", "seg", "content")
    done, levels = [], []
    while True:
        crowded = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"), F.first("low").alias("_l"), F.first("high").alias("_h"))
        crowded = settle(crowded.where((F.col("_n") > CROWD) & (F.col("_l") < F.col("_h"))).select("gram"))
        if is_empty(crowded):
            done.append((counts, contents))
            break
        done.append(tuple(x.join(crowded, "gram", "left_anti") for x in (counts, contents)))
        own = contents.join(crowded, "gram", "left_semi").dropDuplicates(["gram", "seg"])
        parts = settle(halves(own.join(counts, ["gram", "seg"]), unit))
        levels.append(parts.select("gram", "seg", "least", "g2", "s2", "off", "size"))
        counts = parts.groupBy(F.col("g2").alias("gram"), F.col("s2").alias("seg"), "low", "high")
        counts = settle(counts.agg(F.sum("times").alias("times"), F.min("least").alias("least")))
        contents = parts.where("content is not null").select(F.col("g2").alias("gram"), F.col("s2").alias("seg"), "content")
    distinct, whole = (reduce(DataFrame.unionByName, frames) for frames in zip(*done, strict=True))
    return distinct.select("gram", "seg", "times", "least"), whole, levels


def put_together(found: DataFrame, levels: list[DataFrame], lists: dict[str, Callable[[], Column]]) -> DataFrame:
    """``found`` (gram, seg and other columns) for parts and segments, from that of the parts.

    ``lists`` makes the arrays of a segment from one of its parts: from the part's columns,
    off, size and least, and the columns of ``found``, whose names begin with _. Arrays of the
    parts are joined up.
    """
    for parts in reversed(levels):
        child = found.select(F.col("gram").alias("g2"), F.col("seg").alias("s2"), *[F.col(c).alias(f"_{c}") for c in found.columns if c not in ("gram", "seg")])
        got = attach(parts, child, ["g2", "s2"], parts.count(), "inner")
        got = got.select("gram", "seg", "least", *[make().alias(c) for c, make in lists.items()])
        up = got.groupBy("gram", "seg", "least").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in lists])
        found = settle(found.unionByName(up.select(*found.columns)))
    return found


def text_buffers_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.cumsum([0] + [len(t) for t in texts])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def packed_with_key(docs: DataFrame, unit: Unit, bits: np.ndarray) -> DataFrame:
    """(_id, _key, _packed): id, key and compressed text of each row that the filter lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(unit)
        for batch in (matching(part, "_id", shared.value) for whole in batches for part in slices(whole)):
            for a, b, data, offsets in each_text(batch.column(1)):
                keys = symbols.keys(*symbols.of(data, offsets))
                raw = data.tobytes()
                texts = [raw[s:e] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(keys), pa.array(pack(texts), pa.binary())],
                    names=["_id", "_key", "_packed"],
                )

    return docs.mapInArrow(run, "_id long, _key long, _packed binary")


def classes_of(docs: DataFrame, unit: Unit) -> tuple[DataFrame, DataFrame]:
    """Facts (_id, key, n) of every row, and the classes of equal texts (key, n, rep, copies)."""
    facts = settle(describe(docs, unit))
    classes = facts.groupBy("key", "n").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return facts, settle(classes)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans."""
    if len(starts) == 0:
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    i = np.flatnonzero(new)
    return starts[i], reach[np.append(i[1:], len(starts)) - 1]


def cut_spans(
    df: DataFrame, key: str, text: str, unit: Unit, spans: DataFrame, cut: Callable, columns: str
) -> DataFrame:
    """``df`` with the results of ``cut(text, starts, ends)`` for each row as new columns.

    ``spans``: _id, key and the lists starts and ends of what to remove, for the texts
    that lose something. Only rows that may lose something are moved. ``columns`` is the
    schema of the results; they replace columns of their names.
    """
    from pyspark.sql import types as T

    added = T._parse_datatype_string(columns)
    taken = {c.lower() for c in added.fieldNames()}
    others = [c for c in df.columns if c.lower() not in taken]
    i_, k_, s_, e_ = names = fresh(df.columns, "id", "keys", "starts", "ends")
    kept = df.select(*[F.col(f"`{c}`") for c in others])
    schema = T.StructType([*kept.schema.fields, *added.fields])
    by_id = settle(
        spans.groupBy(F.col("_id").alias(i_)).agg(
            F.collect_list("key").alias(k_), F.collect_list("starts").alias(s_), F.collect_list("ends").alias(e_)
        )
    )
    bits = id_filter(by_id.select(i_))
    moved = rows_in(kept, key, bits).withColumn(i_, F.col(f"`{key}`").cast("long")).join(by_id, i_, "left").drop(i_)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in zip(names[1:], ("array<long>", "array<array<int>>", "array<array<int>>"), strict=True)]
    still = kept.select("*", *nothing)
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(unit)
        for batch in (part for whole in batches for part in slices(whole)):
            n = len(others)
            keys, starts, ends = (batch.column(n + i).to_pylist() for i in range(3))
            column = batch.column(batch.schema.get_field_index(text))
            out: list[tuple] = []
            for a, b, data, offsets in each_text(column):
                own = symbols.keys(*symbols.of(data, offsets)).tolist()
                raw = data.tobytes()
                for i in range(a, b):
                    part = raw[offsets[i - a] : offsets[i - a + 1]]
                    which = keys[i].index(own[i - a]) if keys[i] and own[i - a] in keys[i] else -1
                    if which < 0:
                        out.append(cut(part, [], []))
                    else:
                        out.append(cut(part, starts[i][which], ends[i][which]))
            new = list(zip(*out, strict=True)) if out else [()] * len(added.fields)
            from pyspark.sql.pandas.types import to_arrow_type

            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(n)],
                 *[pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(new, added.fields, strict=True)]],
                names=[*others, *added.fieldNames()],
            )

    def run_still(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(matching(part, key, shared.value, False) for batch in batches for part in slices(batch))

    return moved.mapInArrow(run, schema).unionByName(still.mapInArrow(run_still, schema))


def text_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    key, text = f"`{key}`", f"`{text}`"
    return df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")
    )
