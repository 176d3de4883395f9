"""Encoding and decoding with a SentencePiece BPE model.

Every prefix of a text has exactly one last token: the last one of the prefix's
own encoding. An automaton names the tokens that end at each place; among them
only one fits, the one that is compatible with the last token of the prefix
before it. Two tokens are compatible when their texts side by side encode to
just these two, which their derivations show: going up the right edge of the
left token and the left edge of the right one in the order of the merges, no
merge across the border comes first. The table is filled from left to right and
the ids are read from it backwards, in time proportional to the text.

No piece of such a model has a space mark after another character, nor a line
feed beside other characters (checked on loading), so no merge crosses the start
of a run of spaces or a line's end: texts are cut there, and the results of
recent units are kept in a cache of bounded size.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kinset.llm.text import process_store, trim

MARK = "▁"
UNKNOWN = -1
#: Units kept in each of the two halves of the cache, and the longest ones kept.
CACHE, CACHED_LENGTH = 250_000, 40
#: Pairs of tokens, and steps of the automaton, kept.
PAIRS, STEPS = 600_000, 600_000


class Automaton:
    """Finds the words that end at each place of a text, the longest first."""

    def __init__(self, words: dict[str, int]):
        self.go: list[dict[str, int]] = [{}]
        ends: list[tuple[int, int] | None] = [None]
        for word, value in words.items():
            at = 0
            for c in word:
                if (to := self.go[at].get(c)) is None:
                    to = self.go[at][c] = len(self.go)
                    self.go.append({})
                    ends.append(None)
                at = to
            ends[at] = (len(word), value)
        self.back = [0] * len(self.go)
        self.found: list[tuple[tuple[int, int], ...]] = [()] * len(self.go)
        own = [list(x.items()) for x in self.go]
        self.steps, layer = 0, [0]
        while layer:
            below = []
            for at in layer:
                for c, to in own[at]:
                    self.back[to] = self.step(self.back[at], c) if at else 0
                    end = ends[to]
                    self.found[to] = ((end,) if end else ()) + self.found[self.back[to]]
                    below.append(to)
            layer = below

    def step(self, at: int, c: str) -> int:
        """The state after ``c`` where ``at`` has no step of its own kept."""
        from_ = at
        while (to := self.go[at].get(c)) is None and at:
            at = self.back[at]
        to = to or 0
        if self.steps < STEPS and from_ and to:
            self.steps += 1
            self.go[from_][c] = to
        return to


class PieceModel:
    """The tables of a model: pieces, merge order, derivations, automaton."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.vocab_size()
        if lib.encode("  a  ", out_type=str) and lib.decode(lib.encode(" Ａ b ")) != " Ａ b ":
            raise ValueError("only models with the identity normaliser are supported")
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.byte_ids = [0] * 256
        self.byte_of: dict[int, int] = {}
        self.control = {i for i in range(n) if lib.is_control(i)}
        self.unk = lib.unk_id()
        normal = []
        for i in range(n):
            if lib.is_byte(i):
                value = int(self.pieces[i][3:5], 16)
                self.byte_ids[value], self.byte_of[i] = i, value
            elif i not in self.control and i != self.unk and not lib.is_unused(i):
                normal.append(i)
                if MARK in self.pieces[i].lstrip(MARK) or len(self.pieces[i]) > 1 and "\n" in self.pieces[i]:
                    raise ValueError(f"piece {i} has a space mark or line feed inside")
        #: Text of each id; None for bytes.
        self.surface: list[str | None] = [
            None if i in self.byte_of else "" if i in self.control else
            " ⁇ " if i == self.unk else self.pieces[i].replace(MARK, " ")
            for i in range(n)
        ]
        order = sorted(normal, key=lambda i: -lib.get_score(i))
        #: Merge order; pieces of one score share a rank, and the leftmost merges first.
        self.rank: dict[int, int] = {}
        last, rank = None, -1
        for i in order:
            if lib.get_score(i) != last:
                last, rank = lib.get_score(i), rank + 1
            self.rank[i] = rank
        self.id_of = {self.pieces[i]: i for i in normal}
        #: Children of each piece in its own derivation; pieces that their own merges do
        #: not reach never occur in an encoding.
        self.parts: dict[int, tuple[int, int] | None] = {}
        for i in normal:
            text = self.pieces[i]
            tree = None if len(text) == 1 else self.derive(text)
            if len(text) == 1 or (tree is not None and tree[0] == i):
                self.parts[i] = tree[1] if tree else None
        self.automaton = Automaton({self.pieces[i]: i for i in self.parts})
        self._edges: dict[tuple[int, bool], list[int]] = {}
        self._fits: dict[int, bool] = {}

    def merge(self, text: str) -> list[tuple[int, tuple[int, int] | None, str]]:
        """The symbols that merging by (rank, place) leaves, with their last parts."""
        symbol: list = [(self.id_of.get(c, UNKNOWN), None, c) for c in text]
        after, before = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        queue: list[tuple[int, int, int, str]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < len(text):
                whole = symbol[a][2] + symbol[b][2]
                if (i := self.id_of.get(whole)) is not None:
                    heapq.heappush(queue, (self.rank[i], a, i, whole))

        for a in range(len(text) - 1):
            offer(a)
        while queue:
            _, a, i, whole = heapq.heappop(queue)
            if symbol[a] is None or after[a] >= len(text):
                continue
            b = after[a]
            if symbol[a][2] + symbol[b][2] != whole:
                continue
            symbol[a], symbol[b] = (i, (symbol[a][0], symbol[b][0]), whole), None
            after[a] = after[b]
            if after[b] < len(text):
                before[after[b]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [s for s in symbol if s is not None]

    def derive(self, text: str):
        left = self.merge(text)
        return left[0] if len(left) == 1 else None

    def edge(self, token: int, right: bool) -> list[int]:
        """A token's pieces along one border, from the character up to the token."""
        key = (token, right)
        if (found := self._edges.get(key)) is None:
            found, at = [token], token
            while (two := self.parts.get(at)) is not None:
                at = two[right]
                found.append(at)
            self._edges[key] = found = found[::-1]
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether the texts of two tokens side by side encode to the two."""
        if left < 0 or right < 0:
            return True
        key = left << 20 | right
        if (known := self._fits.get(key)) is not None:
            return known
        a, b = self.edge(left, True), self.edge(right, False)
        i = j = 0
        rank, pieces, id_of, never = self.rank, self.pieces, self.id_of, 1 << 60
        ok = True
        while True:
            up_a = rank[a[i + 1]] if i + 1 < len(a) else never
            up_b = rank[b[j + 1]] if j + 1 < len(b) else never
            across = id_of.get(pieces[a[i]] + pieces[b[j]])
            # At equal rank the leftmost goes first: left token, border, right token.
            if across is not None and rank[across] < up_a and rank[across] <= up_b:
                ok = False
                break
            if up_a == up_b == never:
                break
            if up_a <= up_b:
                i += 1
            else:
                j += 1
        if len(self._fits) > PAIRS:
            self._fits.clear()
        self._fits[key] = ok
        return ok

    def encode_unit(self, unit: str) -> list[int]:
        """Ids of a text in which space marks stand only at the front.

        Runs of spaces are merged outright: their pieces share one score, and then the
        place decides, which two tokens side by side do not show.
        """
        if unit.startswith(MARK + MARK):
            return self._merged(unit)
        n = len(unit)
        last, size = [UNKNOWN] * (n + 1), [1] * (n + 1)
        go, found, step = self.automaton.go, self.automaton.found, self.automaton.step
        known, fits, state = self._fits, self.fits, 0
        for end, c in enumerate(unit, 1):
            to = go[state].get(c)
            state = step(state, c) if to is None else to
            for length, token in found[state]:
                if begin := end - length:
                    if (left := last[begin]) >= 0:
                        ok = known.get(left << 20 | token)
                        if ok is None:
                            ok = fits(left, token)
                        if not ok:
                            continue
                last[end], size[end] = token, length
                break
        ids: list[int] = []
        at = n
        while at:
            token = last[at]
            if token < 0:
                ids.extend(self.byte_ids[b] for b in reversed(unit[at - 1].encode()))
            else:
                ids.append(token)
            at -= size[at]
        return ids[::-1]

    def _merged(self, unit: str) -> list[int]:
        out: list[int] = []
        for i, _, text in self.merge(unit):
            out.extend([i] if i >= 0 else (self.byte_ids[b] for b in text.encode()))
        return out

    def decode_unit(self, ids: list[int]) -> str:
        """Text of ids, with space marks as spaces; bytes that are no UTF-8 become U+FFFD."""
        try:
            return "".join([self.surface[i] for i in ids])
        except TypeError:  # bytes among them
            pass
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            out.append(self.surface[i])
        if run:
            out.append(_utf8(run))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of a whole sequence: the space put before the first word goes."""
        text = self.decode_unit(ids)
        first = next((i for i in ids if i not in self.control), None)
        marked = first is not None and first not in self.byte_of and self.pieces[first].startswith(MARK)
        return text[1:] if marked else text


def _utf8(run: bytearray) -> str:
    """Each byte that begins no whole character becomes U+FFFD of its own."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


class UnitCoder:
    """Encodes texts unit by unit, keeping the ids (as bytes) of recent units, and the decoded text of
    those few that do not decode to themselves.

    A line without neighbouring spaces is cut at its spaces; its first unit has no
    mark unless it begins the text. Other lines are cut by pattern.
    """

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        #: Ids and odd texts of units, without and with a mark: of late, and from before.
        self.young, self.old = [{}, {}], [{}, {}]
        self.odd, self.old_odd = [{}, {}], [{}, {}]

    def unit(self, unit: str, marked: int) -> bytes:
        if (ids := self.old[marked].get(unit)) is None:
            numbers = self.model.encode_unit(MARK + unit if marked else unit)
            ids = array("i", numbers).tobytes()
            if (text := self.model.decode_unit(numbers)) != self.plain([unit], marked):
                self.odd[marked][unit] = text
        elif unit in self.old_odd[marked]:
            self.odd[marked][unit] = self.old_odd[marked][unit]
        if len(unit) <= CACHED_LENGTH:
            self.young[marked][unit] = ids
        return ids

    def plain(self, units: list[str], marked: int) -> str:
        """What units decode to unless one of them is odd."""
        return " " + " ".join(units) if marked else "".join(units).replace(MARK, " ")

    def units(self, units: list[str], marked: int) -> tuple[bytes, str]:
        table = self.young[marked]
        try:
            ids = [table[u] for u in units]
        except KeyError:
            ids = [table.get(u) or self.unit(u, marked) for u in units]
        odd = self.odd[marked]
        if not odd or odd.keys().isdisjoint(units):
            return b"".join(ids), self.plain(units, marked)
        texts = [odd[u] if u in odd else self.plain([u], marked) for u in units]
        return b"".join(ids), "".join(texts)

    def text(self, text: str) -> tuple[bytes, str]:
        if not text:
            return b"", ""
        for marked in (0, 1):
            if max(len(self.young[marked]), len(self.odd[marked])) >= CACHE:
                self.old[marked], self.young[marked] = self.young[marked], {}
                self.old_odd[marked], self.odd[marked] = self.odd[marked], {}
        parts, plain = [], MARK not in text
        for i, line in enumerate(text.split("\n")):
            if i:
                parts.append(self.units(["\n"], 0))
            if plain and "  " not in line and line[-1:] != " " and line[:1] != " ":
                units = line.split(" ")
                if i == 0:
                    parts.append(self.units(units, 1))
                elif line:
                    parts.append(self.units(units[:1], 0))
                    if len(units) > 1:
                        parts.append(self.units(units[1:], 1))
            else:
                line = line.replace(" ", MARK)
                parts.append(self.units(self.cut(line if i else MARK + line), 0))
        return b"".join([p[0] for p in parts]), "".join([p[1] for p in parts])[1:]


def encode_texts(
    df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """``df`` with the ids of each whole text and the text decoded from them.

    No begin or end ids. A null or empty text has no ids and decodes to the empty
    text. Rows are independent: repeated rows give repeated results, an empty
    table an empty one, other columns stay; ``ids`` and ``decoded`` replace columns
    of these names. The model file must be at ``model_path`` on every worker.
    """
    others = [c for c in df.columns if c not in (ids, decoded)]
    kinds = {f.name: f for f in df.schema.fields}
    schema = df.select(*others).schema.add(ids, T.ArrayType(T.IntegerType())).add(decoded, T.StringType())
    assert text in kinds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        coder = process_store(("pieces", model_path), lambda: UnitCoder(model_path))
        for batch in batches:
            where = batch.schema.get_field_index(text)
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                found = [coder.text(t or "") for t in part.column(where).to_pylist()]
                ends = np.cumsum([0] + [len(b) // 4 for b, _ in found]).astype(np.int32)
                flat = np.frombuffer(b"".join([b for b, _ in found]), np.int32)
                new = {
                    ids: pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    decoded: pa.array([d for _, d in found], pa.string()),
                }
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in others] + list(new.values()),
                    names=others + list(new),
                )

    return df.select(*df.columns).mapInArrow(run, schema)


def decode_ids(df: DataFrame, model_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the text of a column of ids (null: null). Ids outside the model fail."""
    from pyspark.sql import functions as F

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = PieceModel(model_path)
        for column in columns:
            yield column.map(lambda x: None if x is None else model.decode([int(i) for i in x]))

    return df.withColumn(decoded, F.pandas_udf(run, "string")(ids))
