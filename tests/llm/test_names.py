"""Columns of the caller's with the names that operators use inside, or add."""

import ast
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import kinset.llm
from kinset.llm.infill import fill_in_middle
from kinset.llm.licenses import scan_licenses
from kinset.llm.mixing import mix_sources, mixed_rows
from kinset.llm.pii import find_personal_data
from kinset.llm.repeats import remove_repeats
from kinset.llm.substrings import remove_known_runs

SF = "/root/testdata/sf0.001"
ADDED = ["size", "source_size", "target", "taken", "placed", "shard", "place", "cut", "rejected", "spans", "n", "form", "output"]


def names_inside() -> list[str]:
    """All names with an underscore in front that stand in the sources as column names."""
    found = set()
    for path in Path(kinset.llm.__file__).parent.glob("*.py"):
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Constant) and isinstance(node.value, str):
                found |= {w for w in node.value.replace(",", " ").split() if w.startswith("_") and w.isidentifier()}
            if isinstance(node, ast.Call) and getattr(node.func, "id", "") == "fresh":
                found |= {f"_{x.value}" for x in node.args if isinstance(x, ast.Constant)}
    return sorted(found)


@pytest.fixture(scope="module")
def clashing(spark, corpus):
    names = names_inside()
    assert {"_w", "_base", "_left", "_row", "_at", "_keys", "_starts"} <= set(names)
    df = spark.createDataFrame([(i, t, "s") for i, t in corpus if i is not None and i < 75], "doc_id long, text string, source string")
    return df.select("*", *[F.lit(f"mine {n}").alias(n) for n in [*names, *ADDED]]).repartition(2)


RUNS = {
    "repeats": (remove_repeats, []),
    "known": (remove_known_runs, []),
    "licenses": (scan_licenses, []),
    "mix": (mix_sources, ["size", "source_size", "target", "taken", "placed"]),
    "mixed": (lambda df: mixed_rows(df.drop("lang")), ["shard", "place"]),
    "infill": (fill_in_middle, ["n", "form", "output"]),
    "personal": (find_personal_data, ["spans"]),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_other_columns_keep_their_values(clashing, name):
    run, replaced = RUNS[name]
    out = run(clashing)
    mine = [c for c in clashing.columns if c not in ("doc_id", "text", "source", *replaced)]
    rows = out.select("doc_id", *mine).collect()
    assert rows and all(r[c] == f"mine {c}" for r in rows for c in mine)


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages(spark, clashing, stage):
    docs = clashing.withColumn("lang", F.lit("en")).withColumn("n_chars", F.lit(1).cast("long"))
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, SF)
    assert out.columns == docs.columns
    mine = [c for c in clashing.columns if c.startswith("_") or c in ADDED]
    rows = out.collect()
    assert rows and all(r[c] == f"mine {c}" for r in rows for c in mine)
