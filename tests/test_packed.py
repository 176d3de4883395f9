import random

import models
import numpy as np
import pytest
from kinset import distance_pairs
from kinset.operators import linkage, matrix
from kinset.operators.linkage import agglomerate
from kinset.plans.limits import LIMITS
from pyspark.sql import functions as F

SCHEMA = "g int, id long, seq string"


def merges(pairs, *args):
    return sorted((r.g, r.step, r.left_id, r.right_id, round(r.height, 9), r["size"]) for r in agglomerate(pairs, ["g"], *args).collect())


@pytest.mark.parametrize("kind,thres,mode", [("average", 0.4, "similarity"), ("average", None, "distance"), ("complete", None, "distance")])
def test_packed_pairs_merge_as_rows_do(spark, monkeypatch, kind, thres, mode):
    rows = models.random_rows(71, n=70, groups=2) + [(9, 900, "AC"), (9, 901, "AG")]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = distance_pairs(df, ["g"], "edit" if kind == "complete" else "hamming", on_unequal="skip")
    if mode == "similarity":
        # A missing pair has no similarity.
        pairs = pairs.withColumn("dist", 1 - F.col("dist")).where("(src + dst) % 5 <> 0")
    pairs = pairs.cache()
    want = merges(pairs, kind, thres, mode)
    monkeypatch.setattr(LIMITS, "packed_least", 3)
    monkeypatch.setattr(LIMITS, "packed_pairs", 100)
    dense, taken = linkage._dense_groups, []
    monkeypatch.setattr(linkage, "_dense_groups", lambda *a: taken.append(dense(*a)) or taken[-1])
    assert merges(pairs, kind, thres, mode) == want
    assert len(taken[0][0]) == 1 and taken[0][1].count() < 70
    # What does not fit in a matrix is unpacked.
    monkeypatch.setattr(LIMITS, "dense_cells", 1)
    assert merges(pairs, kind, thres, mode) == want


def test_tiles_give_each_pair_once(spark, tight):
    rng = random.Random(72)
    rows = [(i % 2, i, "".join(rng.choice("ACé" if i % 7 == 0 else "AC") for _ in range(9))) for i in range(70)]
    got = [(r.g, r.src, r.dst, round(r.dist, 9)) for r in distance_pairs(spark.createDataFrame(rows, SCHEMA), ["g"], "hamming").collect()]
    assert sorted(got) == sorted((*k, round(d, 9)) for k, d in models.pairs(rows, "hamming").items())


def test_dense_rounds_equal_those_of_the_whole_matrix():
    rng = np.random.default_rng(73)
    for turn in range(120):
        n, similar, kind = int(rng.integers(2, 40)), bool(turn % 2), ("average", "complete", "single")[turn % 3]
        far = np.triu(rng.integers(1, 7, (n, n)) / 18, 1)
        sizes, ids = rng.integers(1, 3, n), np.sort(rng.choice(1000, n, replace=False))
        value = (far + far.T - similar) * (np.outer(sizes, sizes) if kind == "average" else 1)
        limit = (None, -0.8 if similar else 0.2)[turn // 6 % 2]
        args = ids, sizes, value, kind, limit, similar
        assert matrix.dense_rounds(*args[:2], value.copy(), *args[3:]) == matrix.merge_rounds(*args)
