import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinset.llm.infill import BlockTree, Infill, fill_in_middle, restored
from kinset.llm.queries import op11_infill

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def model(key, text, rate=50, share=80):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < share:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def taken(rows):
    return sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows), key=str)


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_equals_model(docs, corpus, block):
    made = fill_in_middle(docs.withColumn("n", F.lit("x")).withColumn("_k", F.lit(1)), how=Infill(rate=100, block=block))
    got = made.withColumn("again", restored()).collect()
    assert set(made.columns) == {*docs.columns, "_k", "n", "form", "prefix_chars", "middle_chars", "output"}
    assert sorted(taken(got), key=str) == sorted(((i, *model(i, t, 100)) for i, t in corpus), key=str)
    assert all(r.again == (r.text or "") for r in got) and all(r._k == 1 for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_marks_and_edges(spark, nothing):
    texts = ["<P> a b", "a <S>", "<", "a< b <c <", "S> x M>", " ", "\n \t", "x", " x ", "é  漢字\x0b", "<M", "x" * 3000 + " " * 3000 + "é" * 2000, None, ""]
    rows = [(i, t) for i in (*range(40), None) for t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fill_in_middle(df, how=Infill(rate=100, block=16)).withColumn("again", restored()).collect()
    assert all(r.again == (r.text or "") for r in got)
    assert sorted(taken(got), key=str) == sorted(((i, *model(i, t, 100)) for i, t in rows), key=str)
    assert fill_in_middle(nothing).collect() == []


def test_tree():
    rng = np.random.default_rng(3)
    for n in range(1, 40):
        units, points = rng.integers(0, 3, n), rng.integers(1, 9, n)
        tree = BlockTree(units, points)
        ends = np.repeat(np.arange(n), units)
        assert tree.total == len(ends)
        for k, block in enumerate(ends.tolist(), 1):
            assert tree.find(k) == (block, k - units[:block].sum(), points[:block].sum())


def test_query(spark):
    """The registered query over its whole table, digests included."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [(r.doc_id, *model(r.doc_id, r.text)[:4], sha(model(r.doc_id, r.text)[4]), sha(r.text or "")) for r in texts]
    got = op11_infill(spark, SF)
    assert dict(got.dtypes) == {
        "doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint",
        "output_sha256": "string", "restored_sha256": "string",
    }
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len({r[2] for r in want}) == 3
