"""Close pairs: threshold pairs, nearest neighbours, the full distance table.

All searches run on distinct sequences. Results name a sequence by the smallest
id of its copies.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinset.functions.distance import check_metric, distance, hamming_count, packed, packed_letters
from kinset.operators.copies import Distinct, distinct_sequences
from kinset.operators.groups import group_sizes, with_ordinal
from kinset.operators.joins import all_of, attach, join_keys, same_keys, unsent
from kinset.operators.signatures import PACKED, signature
from kinset.plans.limits import LIMITS
from kinset.plans.session import is_empty, settle, settle_counted, spread

STRATEGIES = ("auto", "block", "segment", "pivot", "allpairs")


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _meet(
    a: DataFrame,
    b: DataFrame,
    group: Sequence[str],
    keys: Sequence[str],
    keep: Column,
    dist: Column,
    carry: Sequence[str],
    flip: Column | None = None,
) -> DataFrame:
    """Join two sides on group and keys, and keep the pairs that pass ``keep``.

    Rows are sorted by the keys in the order given, so a hash had better come first.
    """
    on = [
        *[F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys],
        *same_keys("a", "b", group),
        keep,
    ]
    flip = F.lit(False) if flip is None else flip
    ends = []
    for c in ("id", *carry):
        first, second = F.col(f"a.{c}"), F.col(f"b.{c}")
        src, dst = ("src", "dst") if c == "id" else (f"src_{c}", f"dst_{c}")
        ends.append(F.when(flip, second).otherwise(first).alias(src))
        ends.append(F.when(flip, first).otherwise(second).alias(dst))
    joined = a.alias("a").join(b.alias("b"), all_of(on))
    return joined.select(*[F.col(f"a.{g}").alias(g) for g in group], *ends, dist.alias("dist"))


def _bucket(group: Sequence[str], keys: Sequence[str]) -> Column:
    return F.xxhash64(*group, *keys)


def _loads(a: DataFrame, b: DataFrame | None, comp: bool) -> DataFrame:
    """Rows of either side per bucket, and whether one component fills it. ``b`` None: both sides are ``a``."""
    counted = []
    for side, first in ((a, 1),) if b is None else ((a, 1), (b, 0)):
        counted.append(
            side.select(
                "_bucket",
                F.lit(first).cast("bigint").alias("_first"),
                *([F.col("comp").alias("_comp")] if comp else []),
                *([F.col("_closed")] if "_closed" in side.columns else []),
            )
        )
    both = union_all(counted)
    return both.groupBy("_bucket").agg(
        F.sum("_first").alias("_na"),
        F.sum("_first" if b is None else 1 - F.col("_first")).alias("_nb"),
        (F.min("_comp") == F.max("_comp") if comp else F.lit(False)).alias("_single"),
        (F.bool_and("_closed") if "_closed" in both.columns else F.lit(False)).alias("_all_close"),
    )


def _tiles(side: DataFrame, own: str, own_count: str, other: str, other_count: str) -> DataFrame:
    """Spread a crowded bucket over tiles of bounded size: each row has one tile
    on its own axis and visits every tile of the other side's axis."""

    def axis(count: str) -> Column:
        return F.ceil(F.col(count) / F.lit(LIMITS.bucket_rows)).cast("bigint")

    return side.withColumn(own, F.pmod(F.xxhash64("id"), axis(own_count))).withColumn(
        other, F.explode(F.sequence(F.lit(0).cast("bigint"), axis(other_count) - 1))
    )


def close_pairs(
    distinct: Distinct,
    left: DataFrame | None = None,
    right: DataFrame | None = None,
    thres: float | None = None,
    within: int | None = None,
    carry: Sequence[str] = (),
    comp: bool = False,
    links_only: bool = False,
    only: Column | None = None,
) -> DataFrame:
    """Pairs of sequences closer than ``thres`` (or within a whole distance).

    With one table: each unordered pair once, ``src`` < ``dst``. With ``right``:
    pairs of a ``left`` (src) and a ``right`` (dst) sequence.

    ``comp`` keeps only pairs whose ``comp`` columns differ. ``links_only`` lets
    a bucket in which all are close be linked through its smallest id instead of
    pair by pair, for callers that need connectivity and no distances. ``only`` is
    a condition on the carried columns of ``a`` and ``b`` that all close pairs meet;
    other pairs are not measured.
    """
    group, metric = distinct.group, distinct.metric
    left = spread(distinct.table if left is None else left)
    two_sided = right is not None
    right = spread(right) if two_sided else None
    columns = [*group, "id", *carry, *(["comp"] if comp and "comp" not in carry else [])]
    # The smaller side may be broadcast only if it has few rows; each of them has several keys.
    fewest = left.count() if two_sided else distinct.rows

    def held(side: DataFrame) -> DataFrame:
        return unsent(side, 8 * fewest)

    sig = signature(metric, thres, within, distinct)
    carried = [*carry, *(["comp"] if comp and "comp" not in carry else [])]
    different = F.col("a.comp") != F.col("b.comp") if comp else F.lit(True)
    different = different if only is None else different & only

    def pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], swapped: bool = False):
        if two_sided:
            keep = F.lit(True)
            if sig.repeats and swapped:
                # Equal lengths meet in the other direction already.
                keep = F.col("a._len") < F.col("b._len")
            flip = F.lit(swapped)
        else:
            keep = sig.one_way("a", "b")
            flip = F.col("a.id") > F.col("b.id") if sig.repeats else None
        return _meet(
            a, b, group, keys, keep & different & sig.close("a", "b"), sig.dist("a", "b"),
            carried, flip,
        )

    found = []

    def search(a: DataFrame, b: DataFrame | None, swapped: bool = False) -> None:
        """``b`` None: both sides of the join are ``a``."""
        keys = list(sig.keys)
        first = True
        while True:
            if first and distinct.widest <= LIMITS.bucket_rows:
                found.append(pairs(a, held(a if b is None else b), keys, swapped))
                return
            hashed = ["_bucket", *keys]
            if first and sig.calm:
                a, b = (s if s is None else s.withColumn("_bucket", _bucket(group, keys)) for s in (a, b))
                found.append(pairs(a, held(a if b is None else b), hashed, swapped))
                return
            first = False
            marked = [
                s.withColumn("_bucket", _bucket(group, keys)).withColumn(
                    "_closed", sig.closed() if sig.refine else F.lit(False)
                )
                for s in ((a,) if b is None else (a, b))
            ]
            # The keys are worked out once for counting and for both sides of the join.
            marked = [settle(m) for m in marked]
            ma, mb = marked[0], marked[-1]
            loads = _loads(ma, None if b is None else mb, comp)
            crowded = settle(
                loads.where(
                    (F.col("_na") > 0)
                    & (F.col("_nb") > 0)
                    & (F.col("_na").cast("double") * F.col("_nb") > LIMITS.bucket_rows**2)
                )
            )
            if is_empty(crowded):
                found.append(pairs(ma, held(mb), hashed, swapped))
                return
            rows = distinct.rows * 8
            flagged = [
                attach(m, crowded, ["_bucket"], rows, counts=crowded.withColumn("_n", F.col(n)))
                for m, n in zip(marked, ("_na", "_nb"))
            ]
            fa, fb = flagged[0], flagged[-1]
            calm = F.col("_na").isNull()
            found.append(pairs(fa.where(calm), held(fb.where(calm)), hashed, swapped))
            live = F.col("_na").isNotNull() & ~F.col("_single")
            # Crowded buckets that cannot be split any further.
            final = live & F.col("_all_close") if sig.refine else live
            if links_only and sig.refine and not two_sided:
                found.append(_stars(fa.where(final), group, carried))
            else:
                ta = _tiles(fa.where(final), "_ta", "_na", "_tb", "_nb")
                tb = _tiles(fb.where(final), "_tb", "_nb", "_ta", "_na")
                found.append(pairs(ta, tb, [*hashed, "_ta", "_tb"], swapped))
            if not sig.refine:
                return
            deeper = live & ~F.col("_all_close")
            keep = [*group, "id", *carried]
            a = settle(sig.refine(fa.where(deeper), keep))
            b = None if b is None else settle(sig.refine(fb.where(deeper), keep))
            if is_empty(a):
                return

    if not two_sided:
        index = sig.index(left, columns)
        if sig.repeats:
            search(index, sig.probe(left, columns))
        else:
            search(index, None)
    elif sig.repeats:
        search(sig.index(left, columns), sig.probe(right, columns))
        search(sig.index(right, columns), sig.probe(left, columns), swapped=True)
    else:
        search(sig.index(left, columns), sig.probe(right, columns))
    ends = [f"{end}_{c}" for c in carried for end in ("src", "dst")]
    result = union_all(found).select(*group, "src", "dst", *ends, "dist")
    return result.dropDuplicates(["src", "dst"]) if sig.repeats else result


def _stars(rows: DataFrame, group: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Link every row of a bucket to the bucket's smallest id."""
    ends = F.struct("id", *carried)
    centres = rows.groupBy("_bucket").agg(F.min(ends).alias("_centre"))
    linked = attach(rows, settle(centres), ["_bucket"], LIMITS.plain_join_rows + 1, "inner")
    linked = linked.where(F.col("_centre.id") != F.col("id"))
    return linked.select(
        *group,
        F.col("_centre.id").alias("src"),
        F.col("id").alias("dst"),
        *[
            column
            for c in carried
            for column in (
                F.col(f"_centre.{c}").alias(f"src_{c}"),
                F.col(c).alias(f"dst_{c}"),
            )
        ],
        F.lit(None).cast("double").alias("dist"),
    )


def candidate_load(distinct: Distinct, table: DataFrame, thres: float) -> int:
    """Pairs the key join would look at, counted from bucket sizes alone."""
    sig = signature(distinct.metric, thres, distinct=distinct)
    columns = [*distinct.group, "id"]
    bucket = _bucket(distinct.group, sig.keys).alias("_bucket")
    a = sig.index(table, columns).select(bucket)
    b = sig.probe(table, columns).select(bucket) if sig.repeats else None
    per_bucket = _loads(a, b, False)
    total = per_bucket.agg(
        F.coalesce(F.sum(F.col("_na").cast("double") * F.col("_nb")), F.lit(0.0))
    ).first()[0]
    return int(total / 2)


def is_dense(distinct: Distinct, table: DataFrame, thres: float, per_row: int | None = None) -> bool:
    """Whether meeting all key partners would cost far more than the rows: more than ``pairs_per_row``
    for each, or ``per_row`` if that is less."""
    if distinct.widest <= LIMITS.bucket_rows:
        return False
    limit = LIMITS.pairs_per_row if per_row is None else min(per_row, LIMITS.pairs_per_row)
    return candidate_load(distinct, table, thres) > limit * distinct.rows


def _every_pair(distinct: Distinct, carry: Sequence[str]) -> DataFrame:
    """All pairs within groups, for results that are all pairs by definition.

    Where pairs are many, groups are met tile by tile, each two tiles once.
    """
    group, metric, longest = distinct.group, distinct.metric, distinct.longest
    table = spread(distinct.table)
    fast = metric == "hamming" and 0 < longest <= PACKED
    if fast:
        # Lengths are equal within a group; letters outside ASCII are not packed.
        table = table.withColumn("_words", packed("seq", longest)).withColumn("_n", F.length("seq").cast("double"))
        words = [f"_w{i}" for i in range(-(-longest // 7))]
        table = table.withColumns({
            w: F.when(F.col("_words").isNotNull(), F.coalesce(F.get("_words", F.lit(i)), F.lit(0))) for i, w in enumerate(words)
        }).drop("_words")

    def dist() -> Column:
        slow = distance(metric, "a.seq", "b.seq")
        if not fast:
            return slow
        count = packed_letters([(F.col(f"a.{w}"), F.col(f"b.{w}")) for w in words])
        known = F.col("a._w0").isNotNull() & F.col("b._w0").isNotNull()
        return F.when(known, count.cast("double") / F.col("a._n")).otherwise(slow)

    if distinct.widest <= LIMITS.bucket_rows and distinct.widest * distinct.rows <= LIMITS.bucket_rows**2:
        table = table.withColumn("_all", F.lit(0))
        return _meet(table, table, group, ["_all"], F.col("a.id") < F.col("b.id"), dist(), carry)
    table = table.withColumn("_all", F.lit(0))
    sizes = group_sizes(table, [*group, "_all"]).withColumnRenamed("n", "_rows")
    # A number for each group, written down so that it stays the same.
    sizes = settle(sizes.withColumn("_group", F.monotonically_increasing_id()))
    counts = sizes.withColumn("_n", F.col("_rows"))
    table = attach(table, sizes, [*group, "_all"], distinct.rows, "inner", counts=counts)
    tiles = F.ceil(F.col("_rows") / F.lit(LIMITS.bucket_rows)).cast("bigint")
    table = settle(table.withColumn("_tile", F.pmod(F.xxhash64("id"), tiles)).withColumn("_last", tiles - 1))
    keys = ["_group", "_ta", "_tb"]
    # A fixed number of partitions: adaptive execution would size them by bytes, which tell little of the work.
    parts = 16 * table.sparkSession.sparkContext.defaultParallelism
    from_tile = table.withColumn("_ta", F.col("_tile")).withColumn("_tb", F.explode(F.sequence("_tile", "_last")))
    to_tile = table.withColumn("_tb", F.col("_tile")).withColumn("_ta", F.explode(F.sequence(F.lit(0).cast("bigint"), "_tile")))
    a, b = (side.repartition(parts, *keys).alias(name) for name, side in (("a", from_tile), ("b", to_tile.hint("merge"))))
    # A tile meets itself in one order, another tile in any.
    once = (F.col("a._ta") != F.col("a._tb")) | (F.col("a.id") < F.col("b.id"))
    met = a.join(b, all_of([*[F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], once]))
    turn, ends = F.col("a.id") > F.col("b.id"), []
    for c in ("id", *carry):
        src, dst = ("src", "dst") if c == "id" else (f"src_{c}", f"dst_{c}")
        ends.append(F.when(turn, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(src))
        ends.append(F.when(turn, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(dst))
    return met.select(*[F.col(f"a.{g}").alias(g) for g in group], *ends, dist().alias("dist"))


def distance_pairs(
    df: DataFrame,
    group: Sequence[str],
    metric: str,
    symmetric: bool = False,
    on_unequal: str = "raise",
) -> DataFrame:
    """The distance table of each group: every pair of distinct sequences.

    The result grows with the square of the group; see ``near_pairs`` for the others.
    """
    distinct = distinct_sequences(df, group, metric, on_unequal)
    if metric == "hamming" and distinct.uneven:
        distinct = _by_length(distinct)
    pairs = _every_pair(distinct, ("copies",)).drop("_len")
    return both_ways(pairs) if symmetric else pairs


def both_ways(pairs: DataFrame) -> DataFrame:
    """Add every pair in the other direction."""
    turned = {"src": "dst", "dst": "src", "src_copies": "dst_copies", "dst_copies": "src_copies"}
    back = pairs.select(*[F.col(turned.get(c, c)).alias(c) for c in pairs.columns])
    return pairs.unionByName(back)


def _by_length(distinct: Distinct) -> Distinct:
    """Make the length a group column, so that only equal lengths meet."""
    return Distinct(
        distinct.table.withColumn("_len", F.length("seq")),
        (*distinct.group, "_len"),
        distinct.metric, distinct.rows, distinct.records, distinct.widest, False, distinct.longest,
    )


def _pivot_pairs(distinct: Distinct, thres: float, carry: Sequence[str]) -> DataFrame:
    """Metric pruning: two strings within d of each other have distances to any
    third one that differ by at most d.

    Two pivots per group give whole distances; bands of width d+1 on both are
    the join key, so close strings lie in the same or neighbouring bands. Most strings
    of a large group are about equally far from any pivot, so bands grow with the group:
    there the strings meet on the keys of ``close_pairs``, and the distances to the pivots
    decide which of them are compared.
    """
    group, metric = distinct.group, distinct.metric
    table = spread(distinct.table).withColumn("_all", F.lit(0))
    keys = [*group, "_all"]
    mark = F.xxhash64("seq")
    pivots = table.groupBy(*keys).agg(
        F.min_by("seq", mark).alias("_p1"),
        F.max_by("seq", mark).alias("_p2"),
        F.count(F.lit(1)).alias("_n"),
    )
    pivots = settle(pivots)
    table = attach(table, pivots.drop("_n"), keys, distinct.rows, counts=pivots)
    if metric == "hamming":
        d = F.floor(F.lit(thres) * F.length("seq"))
        measure = hamming_count
    else:
        d = F.lit(signature(metric, thres).radius)
        measure = F.levenshtein
    table = table.withColumn("_d", d.cast("bigint"))
    for i in ("1", "2"):
        table = table.withColumn(f"_m{i}", measure("seq", f"_p{i}").cast("bigint"))
        table = table.withColumn(f"_b{i}", F.floor(F.col(f"_m{i}") / (F.col("_d") + 1)))
    table = table.drop("_p1", "_p2")
    if distinct.widest > LIMITS.bucket_rows:
        apart = [F.abs(F.col(f"a._m{i}") - F.col(f"b._m{i}")) <= F.col("a._d") for i in ("1", "2")]
        seen = [*carry, "_m1", "_m2", "_d"]
        found = close_pairs(distinct, table, thres=thres, carry=seen, only=all_of(apart))
        return found.drop(*[f"{end}_{c}" for end in ("src", "dst") for c in ("_m1", "_m2", "_d")])
    wide = table
    for i in ("1", "2"):
        wide = wide.withColumn(
            f"_b{i}", F.explode(F.sequence(F.col(f"_b{i}") - 1, F.col(f"_b{i}") + 1))
        )
    keep = F.col("a.id") < F.col("b.id")
    for i in ("1", "2"):
        keep = keep & (F.abs(F.col(f"a._m{i}") - F.col(f"b._m{i}")) <= F.col("a._d"))
    dist = distance(metric, "a.seq", "b.seq")
    return _meet(wide, table, group, ["_b1", "_b2"], keep & (dist < thres), dist, carry)


def near_pairs(
    df: DataFrame,
    group: Sequence[str],
    metric: str,
    thres: float,
    strategy: str = "auto",
    on_unequal: str = "raise",
) -> DataFrame:
    """Pairs of distinct sequences of one group at distance strictly below
    ``thres``, with the number of copies of either.

    All strategies give the same rows. ``auto`` takes ``block`` for Hamming and
    ``segment`` for edit distance.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
    if (strategy, check_metric(metric)) in (("block", "edit"), ("segment", "hamming")):
        raise ValueError(f"strategy {strategy!r} does not fit the {metric} metric")
    distinct = distinct_sequences(df, group, metric, on_unequal)
    if metric == "hamming" and distinct.uneven and strategy in ("pivot", "allpairs"):
        distinct = _by_length(distinct)
    if strategy == "allpairs":
        pairs = _every_pair(distinct, ("copies",)).where(F.col("dist") < thres)
    elif thres <= 0:
        # Nothing is strictly closer than zero.
        pairs = close_pairs(distinct, within=0, carry=("copies",)).where(F.lit(False))
    elif strategy == "pivot":
        pairs = _pivot_pairs(distinct, thres, ("copies",))
    else:
        pairs = close_pairs(distinct, thres=thres, carry=("copies",))
    return pairs.select(*group, "src", "dst", "dist", "src_copies", "dst_copies")


def expand_copies(
    df: DataFrame, group: Sequence[str], metric: str, pairs: DataFrame
) -> DataFrame:
    """Turn pairs of distinct sequences into pairs of records.

    Copies multiply, so the result grows with the square of their number;
    ``sequence_members`` says the same in one row per record.
    """
    distinct = distinct_sequences(df, group, metric, "skip")
    named = distinct.table.select(*group, "seq", F.col("id").alias("_seq_id"))
    records = distinct.attach_to(df.select(*group, "id", "seq"), named, "inner").select("_seq_id", F.col("id").alias("_id"))
    firsts = records.withColumnsRenamed({"_seq_id": "src", "_id": "_a"})
    seconds = records.withColumnsRenamed({"_seq_id": "dst", "_id": "_b"})
    across = pairs.join(firsts, "src").join(seconds, "dst")
    same = distinct.table.where("copies > 1").select(
        *group, F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist")
    )
    within = same.join(firsts, "src").join(seconds, "dst").where("_a < _b")
    picked = [*group, F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst"), "dist"]
    return across.select(*picked).unionByName(within.select(*picked))


def sequence_members(df: DataFrame, group: Sequence[str], metric: str) -> DataFrame:
    """The distinct sequence of every record: ``(group, id, seq_id)``.

    ``seq_id`` is the smallest id with the record's sequence, the id under which
    ``near_pairs`` reports it. Records without a sequence are left out.
    """
    distinct = distinct_sequences(df, group, metric, "skip")
    named = distinct.table.select(*group, "seq", F.col("id").alias("seq_id"))
    records = df.select(*group, F.col("id").cast("bigint").alias("id"), "seq")
    return distinct.attach_to(records, named, "inner").select(*group, "id", "seq_id")


def nearest(
    df: DataFrame,
    group: Sequence[str],
    metric: str,
    k: int = 1,
    on_unequal: str = "raise",
) -> DataFrame:
    """The ``k`` nearest other records of each record in its group.

    Ties go to the smaller id. The radius doubles until a sequence has enough
    neighbours within it; those settled leave the search, so wide radii are
    used for outliers only.
    """
    distinct = distinct_sequences(df, group, metric, on_unequal)
    grouped = _by_length(distinct) if metric == "hamming" and distinct.uneven else distinct
    keys = grouped.group
    # With k records wanted, no more than k+1 copies of a sequence can matter.
    records = df.select(*group, F.col("id").cast("bigint").alias("id"), "seq")
    copies = with_ordinal(
        records.where(F.col("seq").isNotNull()), ["id"], [*group, "seq"], "_copy"
    )
    rows = distinct.rows
    named = distinct.table.select(*group, "seq", F.col("id").alias("_seq_id"))
    firsts = settle(
        join_keys(copies.where(F.col("_copy") <= k), unsent(named, rows), [*group, "seq"], "inner")
        .select("_seq_id", F.col("id").alias("_record"))
    )
    sizes = group_sizes(grouped.table.withColumn("_all", F.lit(0)), [*keys, "_all"])
    sizes = settle(sizes)
    pending = attach(
        grouped.table.withColumn("_all", F.lit(0)), sizes, [*keys, "_all"], grouped.rows,
        counts=sizes.withColumn("_n", F.col("n")),
    )
    pending = pending.withColumn("_want", F.least(F.lit(k), F.col("n") - 1)).where("_want > 0")
    pending = settle(pending.drop("_all", "n"))
    found = []
    radius, reach = 1, grouped.longest
    while True:
        last = radius >= reach
        hits = close_pairs(grouped, pending, grouped.table, within=min(radius, reach))
        hits = hits.where(F.col("src") != F.col("dst"))
        ranked = settle(
            _first_per(hits.select("src", "dst", "dist"), ["src"], k, "dist", "dst")
        )
        if last:
            found.append(ranked)
            break
        counts = ranked.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("_has"))
        done, n = settle_counted(
            pending.select("id", "_want").join(unsent(counts, rows), "id").where("_has >= _want").select("id")
        )
        done = unsent(done, n)
        found.append(ranked.join(done.withColumnRenamed("id", "src"), "src", "left_semi"))
        pending, waiting = settle_counted(pending.join(done, "id", "left_anti"))
        if waiting == 0:
            break
        radius *= 2
    own = distinct.table.select(
        F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist")
    )
    others = union_all(found).unionByName(own)
    firsts = unsent(firsts, rows)
    others = others.join(firsts, others["dst"] == firsts["_seq_id"]).select(
        "src", F.col("_record").alias("nearest"), "dist"
    )
    per_sequence = _first_per(others, ["src"], k + 1, "dist", "nearest")
    lists = per_sequence.groupBy("src").agg(
        F.array_sort(F.collect_list(F.struct("dist", "nearest"))).alias("_near")
    )
    known = join_keys(
        distinct.table.select(*group, "seq", F.col("id").alias("src")), unsent(lists, rows), ["src"], "left"
    )
    joined = distinct.attach_to(records, unsent(known, rows), "inner")
    mine = F.slice(F.filter("_near", lambda x: x["nearest"] != F.col("id")), 1, k)
    out = joined.select(*group, "id", F.posexplode(mine).alias("_rank", "_hit"))
    return out.select(
        *group, "id", (F.col("_rank") + 1).alias("rank"),
        F.col("_hit.nearest").alias("nearest"), F.col("_hit.dist").alias("dist"),
    )


def _first_per(
    df: DataFrame, key: Sequence[str], k: int, value: str, tie: str
) -> DataFrame:
    """The k smallest (value, tie) per key.

    For k = 1 this is a partial aggregate; otherwise rows are cut down per
    partition before they are numbered per key.
    """
    if k == 1:
        best = df.groupBy(*key).agg(F.min(F.struct(value, tie)).alias("_best"))
        return best.select(*key, f"_best.{tie}", f"_best.{value}")
    numbered = with_ordinal(df, [value, tie], key, "_number")
    return numbered.where(F.col("_number") < k).drop("_number")
