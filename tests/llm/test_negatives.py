import numpy as np
import pytest
from pyspark.sql import functions as F

from kinset.llm.negatives import Best, Codes, Rotation, hard_negatives, products
from kinset.llm.queries import op13_hard_negatives

SF = "/root/testdata/sf0.001"


def model(rows, every=100, k=5):
    """Plain lists: rows of (id, vector, label)."""
    good = [(i, tuple(np.floor(256 * np.array(v, float)).astype(int)), y) for i, v, y in rows
            if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    good = sorted(set(good))
    out = []
    for a in good:
        if a[0] % every:
            continue
        score = lambda b: int(sum(x * y for x, y in zip(a[1], b[1])))  # noqa: E731, B023, B905
        others = sorted((-score(b), b[0], b[2] == a[2]) for b in good if b != a)
        for p in [x for x in others if x[2]][:k]:
            fits = [x for x in others if not x[2] and 80 * -p[0] <= 100 * -x[0] <= 100 * -p[0]][:k]
            out += [(a[0], p[1], r, x[1], -p[0], -x[0]) for r, x in enumerate(fits, 1)]
    return sorted(out)


def taken(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[rng.integers(6)] + rng.normal(size=16) * rng.choice([0.05, 0.6, 2])).tolist(), int(rng.integers(4))) for i in range(600)]
    rows += [(600 + i, rows[0][1], i % 2) for i in range(20)]  # ties
    rows += [(700, [0.0] * 16, 0), (800, [-x for x in rows[0][1]], 1), (900, [1.0] * 3, 1), (1000, [], 2)]
    rows += [(1100, None, 1), (1200, [None] * 16, 1), (1300, [float("nan")] * 16, 1), (1400, [float("inf")] * 16, 0), (1500, [1.0] * 16, None)]
    rows += [(None, [1.0] * 16, 1), rows[5], rows[100], (1700, [1.0] * 16, 77)]
    return rows


@pytest.mark.parametrize("how", [Codes(), Codes(stretch=1, planes=2, anchors=3, rows=50), Codes(stretch=2, rows=7, parts=9)])
def test_equals_brute_force(spark, vectors, how):
    df = spark.createDataFrame([(i, v, y, 1, "x") for i, v, y in vectors], "vec_id long, embedding array<double>, label int, mark int, _cell string")
    for every in (100, 7):
        got = taken(hard_negatives(df.repartition(3), is_anchor=lambda key, e=every: key % e == 0, how=how))
        assert got == model(vectors, every) and got
    assert taken(hard_negatives(df.limit(0), how=how)) == []


def test_rows_that_share_a_key(spark):
    """Rows with one key and different vectors are rows of their own."""
    rng = np.random.default_rng(1)
    rows = [(i // 3, rng.normal(size=8).tolist(), i % 2) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = taken(hard_negatives(df, is_anchor=lambda key: key % 5 == 0))
    assert got == model(rows, 5)
    assert taken(hard_negatives(df.where("vec_id = 0"), is_anchor=lambda key: key % 5 == 0)) == model(rows[:3], 5)


def test_large_components(spark):
    rows = [(i, [1e6 * ((i * 7919) % 101 - 50), -1e300 if i % 9 == 0 else 3.0], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    limit = [(i, [max(min(x, 2.0**26 / 256), -(2.0**26) / 256) for x in v], y) for i, v, y in rows]
    assert taken(hard_negatives(df, is_anchor=lambda key: key % 10 == 0)) == model(limit, 10)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    for dim, how in ((1, Codes()), (8, Codes(stretch=1)), (64, Codes()), (70, Codes(planes=1))):
        x = np.floor(rng.normal(size=(300, dim)) * rng.choice([0.5, 30, 4000], (300, 1)))
        q = np.concatenate([x[:40], np.floor(rng.normal(size=(20, dim)) * 256)])
        turn = Rotation(dim, how)
        least, most = turn.bounds(turn.ask(q), turn.encode(x))
        exact = q @ x.T
        assert (least <= exact).all() and (exact <= most).all()
    # The intervals are narrower than what lengths alone tell.
    x = rng.normal(size=(500, 64)) * 256
    turn = Rotation(64, Codes())
    least, most = turn.bounds(turn.ask(x[:50]), turn.encode(x))
    lengths = np.sqrt((x * x).sum(1))
    assert ((most - least) / (2 * lengths[:50, None] * lengths[None])).mean() < 0.5


def test_products_are_whole():
    x = np.array([[1 << 26, -(1 << 26), 3]] * 2)
    assert products(x, x).tolist() == [[2 * (1 << 52) + 9] * 2] * 2


def test_best():
    best = Best(2, 2)
    best.add(np.array([0, 0, 0, 1]), np.array([5, 7, 5, 1]), np.array([9, 4, 3, 2]), np.zeros(4, int))
    assert list(zip(best.list, best.score, best.id, strict=True)) == [(0, 7, 4), (0, 5, 3), (1, 1, 2)]
    assert best.floor[0] == 5 and best.floor[1] < -(1 << 60)


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    moved = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in rows]
    got = op13_hard_negatives(spark, SF)
    assert taken(got) == model(moved)
    assert [t for _, t in got.select("rank", "anchor_id", "negative_score").dtypes] == ["int", "bigint", "bigint"]
