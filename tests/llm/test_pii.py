import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinset.llm.pii import KINDS, LearnOptions, base_matches, candidates, estimate, find, find_personal_data, luhn, said_by, train
from kinset.llm.queries import op12_personal_data

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def right(kind, match):
    digits = [int(c) for c in match if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if right(k, m[0])]


def line(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def card(rng):
    digits = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
    return next(digits + str(d) for d in range(10) if luhn(digits + str(d)))


@pytest.fixture(scope="module")
def mails():
    """Texts with personal data in plain and wider forms, and look-alikes; the true spans."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghiéü") for _ in range(rng.randrange(2, 8)))
    some = lambda n: " ".join(word() for _ in range(n))
    num = lambda n: "".join(str(rng.randrange(1, 10)) for _ in range(n))
    rows = []
    for i in range(1200):
        parts, true, false = [some(rng.randrange(1, 30))], [], []
        for _ in range(rng.randrange(4)):
            c = card(rng)
            kind, lead, span, real = rng.choice([
                ("email", "mail", f"{word()}.{num(2)}@mail{num(1)}.example.com".replace("é", "e").replace("ü", "u"), True),
                ("email", "contact", f"joe{num(2)} [at] example [dot] com", True),
                ("email", "write", f"ann{num(2)} at example dot org", True),
                ("email", some(1), f"meet{num(1)} at q7 dot {num(2)}x", False),
                ("ip", some(1), f"{num(2)}.{num(2)}.{num(1)}.1{num(2)}", True),
                ("ip", "host", f"2001:db8:{num(4)}::{num(3)}", True),
                ("ip", "version", f"{num(1)}.9{num(2)}.4{num(2)}.{num(1)}", False),
                ("card", "card", c, True),
                ("card", "card", f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}", True),
                ("card", "order", str(int(c) + 1), False),
                ("phone", "call", f"+1 ({num(3)}) 555-{num(4)}", True),
                ("phone", "tel", f"({num(3)}) 555-{num(4)}", True),
                ("phone", "date", f"2021-{num(3)}-1999", False),
            ])
            at = len(" ".join([*parts, lead])) + 1
            parts += [lead, span, some(rng.randrange(1, 9))]
            (true if real else false).append((kind, at, at + len(span)))
        rows.append((i, " ".join(parts), true, false))
    return rows


def test_base_matches():
    rng = random.Random(1)
    for _ in range(20000):
        text = "".join(rng.choice("a@.1 -+(2)9é%:") for _ in range(rng.randrange(40)))
        found = [(k, s, e) for k, s, e, _ in base_matches(text)]
        assert found == [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text)], text
        assert [(k, s, e) for k, s, e, ok in base_matches(text) if ok] == base(text), text
        kept = [(s, e) for _, s, e, how in candidates(text) if how < 1]
        assert all(b <= c for (_, b), (c, _) in zip(kept, kept[1:]))  # noqa: B905


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1.2." * 100_000, "+" * 400_000, "a:" * 200_000, "(1" * 200_000, " at a.b" * 60_000):
        candidates(text)
    assert [x[:3] for x in candidates("a" * 300_000 + "@b.c")] == [(0, 0, 300_004)]


def test_held_out_accuracy(spark, mails):
    """Fitted on half of the rows, without any label; the others are found."""
    df = spark.createDataFrame([(i, t, 1) for i, t, _, _ in mails], "doc_id long, text string, spans int").repartition(4)
    model = train(df.where("doc_id % 2 = 0"))
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in find(df.where("doc_id % 2 = 1"), model).collect()}
    assert sorted(got) == [i for i, *_ in mails if i % 2]
    true = {(i, *s) for i, _, t, _ in mails if i % 2 for s in t}
    false = {(i, *s) for i, _, _, f in mails if i % 2 for s in f}
    found = {(i, *s) for i, spans in got.items() for s in spans}
    assert len(true & found) > 0.97 * len(true) and len(false & found) < 0.05 * len(false)
    assert len(found - true) < 0.05 * len(found)
    for i, text, _, _ in mails:
        if i % 2:
            assert set(base(text)) <= set(got[i]) and got[i] == sorted(got[i], key=lambda s: (KINDS.index(s[0]), s[1]))


def test_same_again(spark, mails):
    df = spark.createDataFrame([(i, t) for i, t, _, _ in mails], "doc_id long, text string")
    a, b = (train(df.repartition(n), options=LearnOptions(rows=200, rounds=40)) for n in (2, 7))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.votes, b.votes) and a.fitted_on == 200
    assert ((a.votes.sum(3) - 1).__abs__() < 1e-9).all()


def test_estimate():
    """Votes of labelers of known reliability: shares and prior are recovered, as a plain loop does."""
    rng = np.random.default_rng(2)
    real = rng.random(20000) < 0.3
    shares = np.array([[[0.7, 0.2, 0.1], [0.1, 0.7, 0.2], [0.5, 0.4, 0.1], [0.6, 0.3, 0.1], [0.2, 0.6, 0.2]],
                       [[0.1, 0.2, 0.7], [0.05, 0.45, 0.5], [0.1, 0.1, 0.8], [0.1, 0.5, 0.4], [0.1, 0.2, 0.7]]])
    said = np.stack([[rng.choice(3, p=shares[int(y), j]) for j in range(5)] for y in real])
    codes, n = np.unique(said @ 3 ** np.arange(4, -1, -1), return_counts=True)
    assert (said_by(codes) @ 3 ** np.arange(4, -1, -1) == codes).all()
    prior, got, posterior = estimate(said_by(codes), n.astype(float), 200)
    assert abs(prior - 0.3) < 0.02 and np.abs(got - shares).max() < 0.04
    _, _, alone = estimate(said, np.ones(len(said)), 200)
    assert np.abs(alone - posterior[np.searchsorted(codes, said @ 3 ** np.arange(4, -1, -1))]).max() < 1e-4
    assert ((alone > 0.5) == real).mean() > 0.9


def test_edges(spark, docs, nothing):
    got = find_personal_data(docs).collect()
    assert len(got) == docs.count() and all(r.spans == [] for r in got if not r.text)
    assert find_personal_data(nothing).collect() == []
    odd = spark.createDataFrame([(None, "a@b.c"), (None, None), (1, ""), (1, "a@b.c +12345678901"), (2, "x" * 200_000 + " a@b.c")], "doc_id long, text string")
    found = sorted(((r.doc_id, [(s.kind, s.start, s.end, s.base) for s in r.spans]) for r in find_personal_data(odd).collect()), key=str)
    assert found == sorted([
        (None, [("email", 0, 5, True)]), (None, []), (1, []),
        (1, [("email", 0, 5, True), ("phone", 6, 18, True)]), (2, [("email", 200_001, 200_006, True)]),
    ], key=str)


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = op12_personal_data(spark, SF)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5 + ["string"] * 2
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(line(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in want) for x in KINDS]
        assert {line([s]) for s in want} <= set(r.spans.split(",")) | {""}
