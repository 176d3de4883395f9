import numpy as np

from kinset.llm.lattice import Lattice, LatticeHash, near_vectors, nearest_e8, shortest_e8


def model(rows, cosine):
    good = [(i, np.array([*v, *[0.0] * (16 - len(v))], float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    links = unit @ unit.T >= cosine
    np.fill_diagonal(links, False)
    label = np.array([i for i, _ in good])
    while True:
        new = np.array([min([label[n], *label[links[n]]]) for n in range(len(good))])
        if (new == label).all():
            break
        label = new
    out = {i: (int(d), int(c)) for (i, _), d, c in zip(good, links.sum(1), label, strict=True)}
    return out | {i: (0, i) for i, _ in rows if i not in out}


def test_equals_brute_force(spark, monkeypatch):
    import kinset.llm.lattice as m

    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    vectors = [b + rng.normal(size=16) * s for b in base for s in (0, 0.05, 0.08, 0.1)] + [base[0] * 3] * 5
    vectors += [base[1] + rng.normal(size=16) * 0.02 for _ in range(60)]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [None] * 16), (904, [float("nan")] * 16), (905, [float("inf")] * 16), (906, [1.0] * 3), (None, [2.0] * 16)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, unit int").repartition(4)
    want = model(rows, 0.95)
    for part in (2000, 20):
        monkeypatch.setattr(m, "PART", part)
        got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df).collect()}
        assert got == want
    assert near_vectors(df.limit(0)).collect() == []


def test_two_vectors_under_one_key(spark):
    """Vectors near both vectors of key 5; each key's component holds all that its vectors reach."""
    rng = np.random.default_rng(4)
    a, b, c = rng.normal(size=(3, 16))
    near = lambda v: (v + rng.normal(size=16) * 0.02).tolist()
    rows = [(5, a.tolist()), (5, b.tolist()), (9, near(a)), (10, near(b)), (3, near(b)), (7, c.tolist()), (8, near(c)), (5, a.tolist()), (12, rng.normal(size=16).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect())
    assert got == sorted([(5, 2, 3, False), (5, 2, 3, False), (5, 2, 3, False), (9, 2, 3, False), (10, 2, 3, False), (3, 2, 3, True),
                          (7, 1, 7, True), (8, 1, 7, False), (12, 0, 12, True)])


def test_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    n = rng.normal(size=a.shape)
    n -= (n * a).sum(1)[:, None] * a
    n /= np.linalg.norm(n, axis=1)[:, None]
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * n
    how = Lattice()
    hashes, met = LatticeHash(64, 0.95, how), np.zeros(len(a), bool)
    for table in range(how.tables):
        x, y = hashes.keys(a, table), hashes.keys(b, table)
        met |= (x == y[:, :1]).any(1) | (y == x[:, :1]).any(1)
    assert met.mean() > 0.97


def test_lattice():
    roots = shortest_e8()
    assert len(roots) == 240 and np.allclose((roots**2).sum(1), 2) and len(np.unique(roots, axis=0)) == 240
    x = np.random.default_rng(1).normal(size=(500, 8)) * 2
    p = nearest_e8(x)
    assert np.allclose(p * 2, np.rint(p * 2)) and np.allclose(p.sum(1) % 2, 0)
    d = ((x - p) ** 2).sum(1)
    assert (d <= 1 + 1e-9).all()
    for r in roots:
        assert (d <= ((x - p - r) ** 2).sum(1) + 1e-9).all()
