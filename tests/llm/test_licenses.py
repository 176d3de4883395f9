import re
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinset.llm.licenses import BASE, ROOTS, rules, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def model(text):
    """Base places, and the labels and best weight of rules after suppression."""
    words = words_of(text)
    line = " " + " ".join(words) + " "
    base = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    found = []
    for n, r in enumerate(rules()):
        if r.keyword in line:
            for m in re.finditer(f" (?:{r.pattern})(?= )", line):
                start = line[: m.start()].count(" ")
                found.append((start, -(start + m.group().count(" ")), -r.priority, n, r))
    kept = []
    for n, m in enumerate(sorted(found, key=lambda x: x[:4])):
        inside = any(o[1] <= m[1] and o[2] <= m[2] for o in sorted(found, key=lambda x: x[:4])[:n])
        if not inside:
            kept.append(m[4])
    labels = {x for _, x in base} | {r.label for r in kept}
    score = max([r.weight for r in kept] + ([0.5] if base else [0.0]))
    places = [i for i, _ in base]
    return (len(words), len(base), min(places, default=None), max(places, default=None),
            ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score)


TEXTS = [
    None, "", " ", "one", "Licensed under CC BY-NC 4.0.", "cc by cc by, CC\nBY", "All rights reserved. ALL RIGHTS RESERVED",
    "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0 (the License); see the license for the specific language governing permissions and limitations",
    "SPDX-License-Identifier: MIT", "general public license general public license", "no mit licence here, see the BSD 3-Clause license",
    "Copyright (c) 2020 by X. All rights reserved. " * 40, "all rights" + " reserved" * 3, "éall rights reserved", "cc byé cc by",
]


def test_rules_have_roots():
    assert len(rules()) > 300
    for r in rules():
        shown = r.pattern.replace("licen[sc]e", "license")
        assert any(root.strip() in r.keyword or root.strip() in shown for root in ROOTS)
        re.compile(r.pattern)


def test_equals_model(spark, corpus):
    texts = TEXTS + [t for _, t in corpus]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    for r in scan_licenses(df).collect():
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)
        assert got == model(texts[r.doc_id]), texts[r.doc_id]
    assert scan_licenses(df.limit(0)).collect() == []


PARTS = ["licensed under", "the", "gnu", "general public license", "version 3", "cc by", "nc", "4.0", "MIT license", "all rights", "reserved", "see", "copyright 2020", "x"]


@pytest.mark.parametrize("seed", [0])
def test_random_texts(spark, seed):
    texts = []

    @settings(max_examples=60, deadline=None, derandomize=True, database=None)
    @given(st.lists(st.sampled_from(PARTS), max_size=14))
    def make(parts):
        texts.append(" ".join(parts))

    make()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in scan_licenses(df).collect():
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)
        assert got == model(texts[r.doc_id]), texts[r.doc_id]


NOTICES = [
    "Distributed under the Expat License.", "Released under the X11 License", "the expat licence, the MIT licence and the X11 licence",
    "Unauthorised copying of this work is strictly prohibited", "unauthorised use prohibited", "unauthorized use prohibited",
    "IN NO EVENT SHALL THE COPYRIGHT HOLDERS be", "in no event shall contributors",
    "See the License for the specific language governing permissions and limitations.",
]


def test_prefilter_loses_no_match(spark, corpus, monkeypatch):
    texts = NOTICES + TEXTS + [t for _, t in corpus]
    ungated = [replace(r, keyword="") for r in rules()]
    monkeypatch.setitem(globals(), "rules", lambda: ungated)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in scan_licenses(df).collect():
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)
        assert got == model(texts[r.doc_id]), texts[r.doc_id]
        assert r.doc_id >= len(NOTICES) or r.score > 0


@settings(max_examples=400, deadline=None, derandomize=True, database=None)
@given(st.data())
def test_matches_hold_their_keyword(data):
    r = data.draw(st.sampled_from(rules()))
    assert r.keyword in " " + data.draw(st.from_regex(r.pattern, fullmatch=True)) + " "
