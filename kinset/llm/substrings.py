"""Removing word runs that an earlier document holds, by suffix automata.

The reference text of each document is that of all documents with a smaller key. It is
kept in shards: a shard holds the segments of one anchor (see ``anchors``; parts of them
where an anchor is crowded), and a run of
``length`` words that two documents share lies in the same shard for both. In a shard
the distinct segments come in the order of the smallest key that holds them. Each is
streamed through the automaton of those before it, which gives for every word the
longest run ending there that the automaton knows (matching statistics); then the
segment joins the automaton, unless all of it is known.

The shards are not broadcast: the reference here is the whole corpus, and sending all
of it to all documents would grow with its square. A shard goes, once, to the task that
has the segments which may match it. ``RunAutomaton`` itself takes any shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinset.llm.anchors import Slicer, Unit, classes_of, cut_spans, merged, put_together, segments, take_apart, text_rows
from kinset.operators.joins import attach, join_keys
from kinset.plans.session import settle

#: Words of an anchor's n-gram.
GRAM = 16


class RunAutomaton:
    """A suffix automaton over words of several texts."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]

    def add(self, words: list[bytes]) -> None:
        """Adds a text; runs do not reach from one text into the next."""
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _extend(self, last: int, word: bytes) -> int:
        step, link, size = self.next, self.link, self.size
        known = step[last].get(word)
        if known is not None and size[known] == size[last] + 1:
            return known
        if known is not None:
            return self._split(last, word, known)
        new = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        at = last
        while at >= 0 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if at >= 0:
            to = step[at][word]
            link[new] = to if size[to] == size[at] + 1 else self._split(at, word, to)
        return new

    def _split(self, at: int, word: bytes, to: int) -> int:
        """A copy of state ``to`` for the shorter runs that reach it from ``at``."""
        step, link, size = self.next, self.link, self.size
        copy = len(step)
        step.append(dict(step[to]))
        link.append(link[to])
        size.append(size[at] + 1)
        while at >= 0 and step[at].get(word) == to:
            step[at][word] = copy
            at = link[at]
        link[to] = copy
        return copy

    def matches(self, words: list[bytes]) -> list[int]:
        """For each word the length of the longest known run that ends with it."""
        step, link, size = self.next, self.link, self.size
        at, n, out = 0, 0, []
        for word in words:
            to = step[at].get(word)
            while to is None and at:
                at = link[at]
                n = size[at]
                to = step[at].get(word)
            if to is not None:
                at, n = to, n + 1
            out.append(n)
        return out


def known_runs(rows: DataFrame, length: int) -> DataFrame:
    """(gram, seg, least, starts, ends): the words of each distinct segment, as spans, that
    runs of segments with smaller keys cover. ``rows``: gram, seg, least, content, by anchor in
    order; ``least`` is the smallest key that holds the segment, content may come in another row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "seg", "least", "starts", "ends"]
        held: dict[int, list] = {}
        last = None
        out: list[tuple] = []

        def finish() -> None:
            automaton = RunAutomaton() if len(held) > 1 else None
            of_key: list[list[bytes]] = []
            previous = None
            for seg, (least, content) in sorted(held.items(), key=lambda x: x[1][0]):
                starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if automaton is not None:
                    if least != previous:  # runs of the same document do not count
                        for words in of_key:
                            automaton.add(words)
                        of_key, previous = [], least
                    words = content.split(b" ")
                    stop = np.flatnonzero(np.array(automaton.matches(words)) >= length) + 1
                    starts, ends = merged(stop - length, stop)
                    if len(stop) < len(words) - length + 1:
                        of_key.append(words)
                out.append((last, seg, least, starts.tolist(), ends.tolist()))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            grams, segs, leasts = (batch.column(i).to_pylist() for i in range(3))
            contents = batch.column(3)
            for i, gram in enumerate(grams):
                if gram != last:
                    finish()
                    held, last = {}, gram
                    if len(out) > 5000:
                        yield flush()
                entry = held.setdefault(segs[i], [None, None])
                if leasts[i] is not None:
                    entry[0] = leasts[i]
                elif entry[1] is None:
                    entry[1] = contents[i].as_py()
        finish()
        if out:
            yield flush()

    return rows.mapInArrow(run, "gram long, seg long, least long, starts array<int>, ends array<int>")


def remove_known_runs(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """``df`` with ``kept`` (the words that remain, joined by one space), n_words, n_removed,
    span_starts and span_ends (in words): every word covered by ``length`` consecutive words that
    also occur, as a run, in a document with a smaller key. Runs are judged on the input.

    Words are runs without white space, as they stand. A null or empty text has none. Of rows
    with equal words only those with the smallest key keep runs of their own; rows that repeat
    this key are one document. Rows with a null key keep all words and are not compared. Columns
    of the result's names are replaced, others stay.
    """
    unit = Unit(True, length, min(GRAM, length))
    docs = text_rows(df, key, text)
    facts, classes = classes_of(docs, unit)
    cut = settle(segments(docs, unit, classes))
    distinct, contents, levels = take_apart(cut, unit)
    rows = distinct.select("gram", "seg", "least", F.lit(None).cast("binary").alias("content")).unionByName(
        contents.select("gram", "seg", F.lit(None).cast("long").alias("least"), "content")
    )
    found = settle(known_runs(rows.repartition("gram").sortWithinPartitions("gram"), length))
    # A part that an earlier document holds is known as a whole.
    known = F.col("_least") < F.col("least")
    shifted = lambda c: lambda: F.transform(c, lambda x: x + F.col("off"))
    found = put_together(found, levels, {
        "starts": lambda: F.when(known, F.array("off")).otherwise(shifted("_starts")()),
        "ends": lambda: F.when(known, F.array(F.col("off") + F.col("size"))).otherwise(shifted("_ends")()),
    })
    # One row for each key on the right, so Spark can split the rows of a frequent one.
    occurrences = join_keys(cut.select("gram", "seg", "rep", "lo", "size"), found, ["gram", "seg"], "inner")
    # The document that holds a segment first loses what still earlier ones hold of it, others all.
    first = F.col("rep") == F.col("least")
    moved = lambda c: F.transform(c, lambda x: x + F.col("lo"))
    places = occurrences.where(~first | (F.size("starts") > 0)).select(
        "rep", F.when(first, moved("starts")).otherwise(F.array("lo")).alias("s"),
        F.when(first, moved("ends")).otherwise(F.array(F.col("lo") + F.col("size"))).alias("e"),
    )
    spans = places.groupBy("rep").agg(
        F.flatten(F.collect_list("s")).alias("starts"), F.flatten(F.collect_list("e")).alias("ends")
    )
    single = spans.join(classes, "rep").select(F.col("rep").alias("_id"), "key", "starts", "ends")
    equal = classes.where(f"copies > 1 and n >= {length}").select("key", "rep")
    many = attach(facts, equal, ["key"], facts.count(), "inner").where("_id <> rep").distinct()
    whole = many.select("_id", "key", F.array(F.lit(0)).alias("starts"), F.array(F.col("n").cast("int")).alias("ends"))

    slicer = Slicer(unit)

    def keep(part: bytes, starts: list[int], ends: list[int]) -> tuple:
        s, e = merged(np.array(starts, np.int64), np.array(ends, np.int64))
        s, e = s.tolist(), e.tolist()
        symbols = slicer.symbols(part)
        n = len(symbols[1])
        kept = [slicer.cut(symbols, i, j) for i, j in zip([0, *e], [*s, n], strict=True) if i < j]
        return b" ".join(kept).decode(), n, sum(e) - sum(s), s, e

    schema = "kept string, n_words long, n_removed long, span_starts array<int>, span_ends array<int>"
    return cut_spans(df, key, text, unit, single.unionByName(whole), keep, schema)
