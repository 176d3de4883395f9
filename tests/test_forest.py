import random

import models
import numpy as np
from kinset import mst_edges
from kinset.operators import mst
from kinset.plans.limits import LIMITS

SCHEMA = "g int, id long, seq string"


def test_forest_from_small_radii_first(spark, monkeypatch):
    """Where most pairs are close the forest needs few of them: those of small radii, and later
    those that leave the largest component."""
    monkeypatch.setattr(LIMITS, "bucket_rows", 10)
    monkeypatch.setattr(LIMITS, "edges_per_row", 2, raising=False)
    seen, real = [], mst.spanning_forest
    monkeypatch.setattr(mst, "spanning_forest", lambda edges, group: seen.append(edges.count()) or real(edges, group))
    rng = random.Random(61)
    rows = [(n % 2, i, f"{x:04d}") for n, (i, x) in enumerate(zip(rng.sample(range(9999), 240), rng.sample(range(9999), 240)))]
    # These reach the others by the widest radius only.
    rows += [(0, 20001, "ab01"), (0, 20000, "cd99"), (1, 20002, "xyzw")]
    got = mst_edges(spark.createDataFrame(rows, SCHEMA), ["g"], "hamming", 0.8).collect()
    assert sorted((r.src, r.dst, round(r.dist, 9)) for r in got) == models.kruskal(rows, "hamming", 0.8)
    close = sum(d < 0.8 for d in models.pairs(rows, "hamming").values())
    assert len(seen) == 3 and sum(seen) * 3 < close


def test_ordered_forest_takes_edges_in_order():
    rng = np.random.default_rng(62)
    for _ in range(200):
        a, b = rng.integers(0, rng.integers(2, 40), (2, rng.integers(1, 90))) * 7
        up, want = {x: x for x in (*a, *b)}, []
        for x, y in zip(a, b):
            x, y = (up[x], up[y])
            want.append(x != y)
            up = {k: min(x, y) if v in (x, y) else v for k, v in up.items()}
        kept, root = mst._ordered_forest(a, b)
        assert kept.tolist() == want
        assert root.tolist() == [up[x] for x in a]
