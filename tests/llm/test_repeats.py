import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinset.llm import repeats, substrings
from kinset.llm.anchors import Symbols, Unit, anchors
from kinset.llm.repeats import intervals, remove_repeats, suffix_order
from kinset.llm.substrings import RunAutomaton, remove_known_runs
from kinset.llm.text import SpanHasher


def model(rows, length):
    """Per row: kept bytes and maximal removed runs, from all windows of all rows."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for n, (_, t) in enumerate(texts):
        for at in range(len(t) - length + 1):
            seen.setdefault(t[at : at + length], set()).add((n, at))
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for at in range(len(t) - length + 1):
            if len(seen[t[at : at + length]]) > 1:
                gone[at : at + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(g and (n == 0 or not gone[n - 1]) for n, g in enumerate(gone))
        out.append((i, len(t), sum(gone), runs, kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [200, 30])
def test_repeats(docs, corpus, length):
    got = remove_repeats(docs, length=length)
    assert got.columns[: len(docs.columns)] == docs.columns
    rows = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()]
    assert sorted(rows, key=str) == model(corpus, length)


def test_whole_characters(spark):
    text = "ab" + "é漢" * 30
    df = spark.createDataFrame([(1, "x" + text), (2, "é" + text + "!"), (3, None)], "doc_id long, text string")
    for r in remove_repeats(df, length=40, whole_characters=True).collect():
        bytes(r.kept).decode()


def test_empty_and_null_keys(spark, nothing):
    assert remove_repeats(nothing).collect() == [] and remove_known_runs(nothing).collect() == []
    df = spark.createDataFrame([(None, "a" * 300), (1, "b" * 10)], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in remove_repeats(df).collect()} == {(None, 0), (1, 0)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc\x00", min_size=4, max_size=14).map(str.encode), min_size=1, max_size=6, unique=True))
def test_interval_tree(contents):
    length, hasher = 4, SpanHasher(256, seed=43)
    content, start, common = suffix_order(contents, np.zeros(len(contents), int), length, hasher)
    pairs = list(zip(content.tolist(), start.tolist(), strict=True))
    prefix = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    suffix = lambda p: contents[p[0]][p[1] :]
    for i in range(1, len(pairs)):
        k = prefix(suffix(pairs[i]), suffix(pairs[i - 1]))
        assert common[i] == (k if k >= length else 0)
    byte = np.array([contents[c][s - 1] if s else -1 - c for c, s in pairs] or [0], np.int64)[: len(pairs)]
    group, lengths, parent, first = intervals(common, byte)
    found = {}
    for g in range(len(lengths)):
        inside = [p for n, p in enumerate(pairs) if _within(g, group[n], parent)]
        found[suffix(inside[0])[: lengths[g]]] = set(inside)
    # All maximal repeats with all their occurrences.
    want = {}
    for p in pairs:
        for k in range(length, len(suffix(p)) + 1):
            want.setdefault(suffix(p)[:k], set()).add(p)
    want = {
        w: at for w, at in want.items()
        if len(at) > 1
        and len({contents[c][s + len(w)] if s + len(w) < len(contents[c]) else -1 - c for c, s in at}) > 1
        and len({contents[c][s - 1] if s else -1 - c for c, s in at}) > 1
    }
    assert found == want


def _within(g, at, parent):
    while at >= 0 and at != g:
        at = parent[at]
    return at == g


def test_equal_windows_have_equal_anchors():
    rng = random.Random(0)
    shared = bytes(rng.choice(b"ab ") for _ in range(90))
    data = np.frombuffer(b"".join([b"xyz" * 9, shared, b"q" * 70, shared, b"!"]), np.uint8)
    unit, offsets = Unit(False, 40, 12), np.array([0, 27 + 90 + 5, len(data)])
    symbols = Symbols(unit)
    sums, first = symbols.of(data, offsets)
    row, gram, place, lo, hi = anchors(sums, first, symbols.hasher, unit)
    by_window = {}
    for r, g, p, a, b in zip(row, gram, place, lo, hi, strict=True):
        for s in range(a, b + 1):
            assert s <= p <= s + 28
            window = data[offsets[r] + s :][:40].tobytes()
            by_window.setdefault(window, set()).add((g, p - s))
    assert all(len(v) == 1 for v in by_window.values())
    assert sum(hi - lo + 1) == sum(max(n - 39, 0) for n in np.diff(offsets))


def known_model(rows, length):
    texts = [(i, (t or "").split()) for i, t in rows]
    first = {}
    for i, w in texts:
        for at in range(len(w) - length + 1):
            key = tuple(w[at : at + length])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for at in range(len(w) - length + 1):
            if first[tuple(w[at : at + length])] < i:
                gone[at : at + length] = [True] * length
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("length", [50, 6])
def test_known_runs(docs, corpus, length):
    rows = remove_known_runs(docs, length=length).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows) == known_model(corpus, length)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12), max_size=5), st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=15))
def test_automaton(texts, words):
    automaton = RunAutomaton()
    for t in texts:
        automaton.add(t)
    known = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    want = [max((k for k in range(1, e + 1) if tuple(words[e - k : e]) in known), default=0) for e in range(1, len(words) + 1)]
    assert automaton.matches(words) == want


@pytest.fixture(scope="module")
def crowd():
    """A passage of 30 words in 1200 surroundings; some of them come again with the passage."""
    rng = random.Random(8)
    passage = " ".join(f"licence{i}" for i in range(30))
    around = lambda: (" ".join(f"{rng.randrange(10**6):x}" for _ in range(40)), " ".join(f"{rng.randrange(10**6):x}" for _ in range(40)))
    pairs = [around() for _ in range(1200)]
    pairs += [(f"{i} {a}", f"{b} {i}") for i, (a, b) in enumerate(pairs[:9])]
    pairs += [(a, "x" + b) for a, b in pairs[20:25]]
    return [(i, f"{a} {passage} {b}") for i, (a, b) in enumerate(pairs)]


def _most_segments(monkeypatch, module, name):
    """Notes the most distinct segments of one n-gram in the rows given to ``name``."""
    most, real = [], getattr(module, name)

    def spy(rows, length):
        most.append(rows.groupBy("gram").agg(F.countDistinct("seg").alias("n")).agg(F.max("n")).first()[0])
        return real(rows, length)

    monkeypatch.setattr(module, name, spy)
    return most


def test_crowded_anchor_of_known_runs(spark, crowd, monkeypatch):
    most = _most_segments(monkeypatch, substrings, "known_runs")
    rows = remove_known_runs(spark.createDataFrame(crowd, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows) == known_model(crowd, 50)
    assert most[0] <= 1000


def test_crowded_anchor_of_repeats(spark, crowd, monkeypatch):
    most = _most_segments(monkeypatch, repeats, "repeats_of_segments")
    short = [(i, t.replace("licence", "l")) for i, t in crowd]
    rows = remove_repeats(spark.createDataFrame(short, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows), key=str) == model(short, 200)
    assert most[0] <= 1000


@pytest.mark.parametrize("crowd", [1, 3])
def test_every_anchor_crowded(docs, corpus, monkeypatch, crowd):
    from kinset.llm import anchors as module

    monkeypatch.setattr(module, "CROWD", crowd)
    rows = remove_known_runs(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows) == known_model(corpus, 50)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs).collect()]
    assert sorted(got, key=str) == model(corpus, 200)


def test_long_windows(spark):
    """Windows so long that an anchor stands more than 256 symbols from where its windows begin."""
    rng = random.Random(9)
    words = lambda n: " ".join(f"{rng.randrange(10**6):x}" for _ in range(n))
    passages = [words(410 + 40 * i) for i in range(6)]
    rows = [(2 * i + j, f"{words(30)} {p} {words(30)}") for i, p in enumerate(passages) for j in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = remove_known_runs(df, length=400).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == known_model(rows, 400)
    found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df, length=400).collect()]
    assert sorted(found, key=str) == model(rows, 400)
