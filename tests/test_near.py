import random

import pytest

import models
from kinset import distance_pairs, near_pairs, nearest, sequence_members
from kinset.functions.distance import packed, packed_count
from kinset.operators.copies import distinct_sequences
from kinset.operators.near import both_ways, candidate_load, expand_copies
from kinset.operators.signatures import segment_cuts
from kinset.plans.limits import LIMITS

SCHEMA = "g int, id long, seq string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def as_map(df):
    rows = df.collect()
    out = {(r.g, r.src, r.dst): round(r.dist, 9) for r in rows}
    assert len(out) == len(rows)
    return out


def expected(rows, metric, thres):
    return {k: round(d, 9) for k, d in models.pairs(rows, metric).items() if d < thres}


@pytest.mark.parametrize("seed", [1])
@pytest.mark.parametrize("thres", [0.2, 0.51])
@pytest.mark.parametrize("strategy", ["auto", "block", "pivot", "allpairs"])
def test_hamming_strategies(spark, seed, thres, strategy):
    rows = models.random_rows(seed)
    got = near_pairs(table(spark, rows), ["g"], "hamming", thres, strategy)
    assert as_map(got) == expected(rows, "hamming", thres)


@pytest.mark.parametrize(
    "thres,strategy",
    [(0.2, "block"), (0.51, "block"), (1.5, "block"), (0.51, "pivot"), (0.51, "allpairs")],
)
def test_hamming_crowded(spark, tight, thres, strategy):
    rows = models.random_rows(5, n=60, groups=2)
    got = near_pairs(table(spark, rows), ["g"], "hamming", thres, strategy)
    assert as_map(got) == expected(rows, "hamming", thres)


@pytest.mark.parametrize("seed", [3])
@pytest.mark.parametrize("thres", [0.14, 1.0, 3])
@pytest.mark.parametrize("strategy", ["segment", "pivot"])
def test_edit_strategies(spark, seed, thres, strategy):
    rows = models.random_rows(seed, length=1, spread=8)
    got = near_pairs(table(spark, rows), ["g"], "edit", thres, strategy)
    assert as_map(got) == expected(rows, "edit", thres)


@pytest.mark.parametrize("strategy", ["segment", "pivot"])
def test_edit_crowded(spark, tight, strategy):
    rows = models.random_rows(6, n=60, groups=2, length=4, spread=3)
    got = near_pairs(table(spark, rows), ["g"], "edit", 3, strategy)
    assert as_map(got) == expected(rows, "edit", 3)


def test_edit_segments_follow_what_varies(spark, tight):
    """Shared beginnings and ends: cuts fall where the strings differ, results stay the same."""
    rng = random.Random(7)
    rows = [
        (i % 2 or None, i, "CASSLG" * (i % 2 + 1) + "".join(rng.choices("ACDE", k=rng.randrange(9, 12))) + "YEQYF")
        for i in range(70)
    ]
    rows += [(1, 100, ""), (1, 101, "CA"), (1, 102, "CAS"), (1, 103, rows[1][2] + "A"), (1, 104, rows[1][2][1:])]
    for i in range(2, 12):
        at = rng.randrange(4, 16)
        rows.append((rows[i][0], 200 + i, rows[i][2][:at] + rng.choice(["", "A", "DD"]) + rows[i][2][at + 1 :]))
    df = table(spark, rows)
    assert as_map(near_pairs(df, ["g"], "edit", 3)) == expected(rows, "edit", 3)
    distinct = distinct_sequences(df, ["g"], "edit")
    for r in segment_cuts(distinct, 2).collect():
        assert len(r._cuts) == 4 and r._cuts[0] == 0 and r._cuts[-1] == r._n
        assert sorted(set(r._cuts)) == r._cuts
        # Lengths that only one string has tell nothing; they are cut evenly.
        if r._n in ((26, 27, 28) if r.g else (20, 21, 22)):
            assert r._cuts[1] > 6 * (2 if r.g else 1) - 1 and r._cuts[2] < r._n - 4
    fitted = candidate_load(distinct, distinct.table, 3)
    distinct.known["cuts", 2] = None
    assert fitted < candidate_load(distinct, distinct.table, 3) / 2


def test_threshold_is_strict_and_zero_joins_nothing(spark):
    rows = [(0, 1, "AAAA"), (0, 2, "AAAT"), (0, 3, "AAAT")]
    df = table(spark, rows)
    assert near_pairs(df, ["g"], "hamming", 0.25).count() == 0
    assert [tuple(r) for r in near_pairs(df, ["g"], "hamming", 0.26).collect()] == [
        (0, 1, 2, 0.25, 1, 2)
    ]
    assert near_pairs(df, ["g"], "hamming", 0).count() == 0


def test_unequal_lengths(spark):
    rows = [(0, 1, "AAAA"), (0, 2, "AAAT"), (0, 3, "AAA"), (1, 4, "A")]
    df = table(spark, rows)
    with pytest.raises(ValueError, match="equal length"):
        near_pairs(df, ["g"], "hamming", 0.5)
    for strategy in ("block", "pivot", "allpairs"):
        got = near_pairs(df, ["g"], "hamming", 0.5, strategy, on_unequal="skip")
        assert as_map(got) == {(0, 1, 2): 0.25}


def test_no_group_columns_and_null_groups(spark):
    df = spark.createDataFrame([(1, "AAAA"), (2, "AAAT")], "id long, seq string")
    assert near_pairs(df, [], "hamming", 0.3).count() == 1
    df = table(spark, [(None, 1, "AAAA"), (None, 2, "AAAT"), (0, 3, "AAAC")])
    assert as_map(near_pairs(df, ["g"], "hamming", 0.3)) == {(None, 1, 2): 0.25}


def test_bad_arguments(spark):
    df = table(spark, [(0, 1, "A")])
    for args in (("other", 1), ("hamming", 1, "segment"), ("edit", 1, "block"), ("edit", 1, "x")):
        with pytest.raises(ValueError):
            near_pairs(df, ["g"], *args)


def test_distance_table(spark, tight):
    rows = models.random_rows(8, n=30)
    df = table(spark, rows)
    full = distance_pairs(df, ["g"], "hamming")
    want = {k: round(d, 9) for k, d in models.pairs(rows, "hamming").items()}
    assert as_map(full) == want
    assert both_ways(full).count() == 2 * len(want)


def test_expand_copies(spark):
    rows = models.random_rows(9, n=30)
    df = table(spark, rows)
    got = expand_copies(df, ["g"], "hamming", near_pairs(df, ["g"], "hamming", 0.3))
    want = sorted((i, j) for d, i, j in models.record_edges(rows, "hamming") if d < 0.3)
    assert sorted((r.src, r.dst) for r in got.collect()) == want
    first = {}
    for g, i, s in sorted(rows, key=lambda r: r[1]):
        first.setdefault((g, s), i)
    named = sequence_members(df, ["g"], "hamming").collect()
    assert {r.id: r.seq_id for r in named} == {i: first[g, s] for g, i, s in rows}


@pytest.mark.parametrize("metric,k", [("hamming", 1), ("hamming", 3), ("edit", 2)])
def test_nearest(spark, metric, k):
    rows = models.random_rows(11, n=30)
    got = {}
    for r in nearest(table(spark, rows), ["g"], metric, k).collect():
        got.setdefault(r.id, []).append((r["rank"], round(r.dist, 9), r.nearest))
    want = {}
    for items in models.by_group(rows).values():
        for i, s in items:
            near = sorted((round(models.DIST[metric](s, t), 9), j) for j, t in items if j != i)
            if near:
                want[i] = [(n + 1, d, j) for n, (d, j) in enumerate(near[:k])]
    assert {i: sorted(v) for i, v in got.items()} == want


def test_packed_letters_count_mismatches(spark):
    rng = random.Random(5)
    rows = []
    for n in (1, 7, 8, 9, 17, 24):
        for letters in ("AC", "ACGT~\x00", "Aé漢😀"):
            rows += [tuple("".join(rng.choice(letters) for _ in range(n)) for _ in range(2)) for _ in range(8)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", packed_count(packed("a", 24), packed("b", 24), 24).alias("n"), packed("a", 24).alias("w")).collect()
    for r in got:
        if (r.a + r.b).isascii():
            assert r.n == sum(x != y for x, y in zip(r.a, r.b, strict=True))
        assert (r.w is None) == (not r.a.isascii())


def test_blocks_of_letters_outside_ascii(spark, tight):
    rng = random.Random(6)
    rows = [(0, i, "".join(rng.choice("Aé😀\n") for _ in range(6))) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.src, r.dst): r.dist for r in near_pairs(df, ["g"], "hamming", 0.4).collect()}
    assert got == {(i, j): d for (_, i, j), d in models.pairs(rows, "hamming").items() if d < 0.4}


@pytest.mark.parametrize("metric,thres", [("hamming", 0.26), ("edit", 2.0)])
def test_pivots_do_not_meet_whole_large_groups(spark, monkeypatch, metric, thres):
    """Random digits are about equally far from any pivot: bands alone leave most pairs."""
    import random

    import kinset.operators.near as near
    from kinset.plans.limits import LIMITS

    rng = random.Random(4)
    rows = [(i % 2, i, "id" + "".join(rng.choice("0123456789") for _ in range(6))) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, id long, seq string")
    want = sorted(map(tuple, near.near_pairs(df, ["g"], metric, thres, "allpairs").collect()))
    monkeypatch.setattr(LIMITS, "bucket_rows", 40)
    met = []
    meet = near._meet

    def counted(a, b, group, keys, keep, *rest):
        on = near.all_of([*near.same_keys("a", "b", group), *[near.F.col(f"a.{k}") == near.F.col(f"b.{k}") for k in keys]])
        met.append(a.alias("a").join(b.alias("b"), on).count())
        return meet(a, b, group, keys, keep, *rest)

    monkeypatch.setattr(near, "_meet", counted)
    got = near.near_pairs(df, ["g"], metric, thres, "pivot")
    assert sorted(map(tuple, got.collect())) == want and len(want) > 0
    # All pairs in both orders are 45,000.
    assert sum(met) < 15_000, met


def test_nearest_sends_no_table_of_the_records(spark, monkeypatch):
    monkeypatch.setattr(LIMITS, "broadcast_rows", 5)
    rows = models.random_rows(12, n=40)
    found = nearest(table(spark, rows), ["g"], "hamming", 1)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.dist for r in found.collect()} == {
        i: min(models.hamming(s, t) for j, t in items if j != i)
        for items in models.by_group(rows).values() for i, s in items if len(items) > 1
    }
