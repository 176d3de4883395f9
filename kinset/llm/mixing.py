"""Mixing sources to target weights with a splitting tree.

Every source's documents are dealt by hash into blocks, of which there are the more the more
rows there are. A source whose target is below its size takes part of its blocks: an exact
number, drawn without replacement. A source with a target above its size takes all blocks once and
draws the rest for a second time. The quotas of all sources are then split among the
output shards by a binary tree: at each node the blocks that its left half gets are
drawn from a multivariate hypergeometric distribution, so every shard gets an exact
whole number of blocks of each source and nothing is lost by rounding. Blocks are
permuted by hash, each shard takes the next ones of its quota, and rows are shuffled by
hash inside their shard. Draws depend on the seed, the source and the node alone, so
reruns agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinset.llm.text import fresh, set_aside
from kinset.plans.session import settle, settle_counted

#: Least blocks of each source, and rows of all sources above which there is a block more.
BLOCKS, BLOCK_ROWS = 1024, 100_000
#: Columns that ``mix_sources`` adds.
ADDED = ("size", "source_size", "target", "taken", "placed")
#: Least shards of a mix, and planned words above which there is a shard more.
SHARDS, SHARD_WORDS = 16, 20_000_000


def word_count(text: str | Column) -> Column:
    """Runs without white space of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``sizes`` (source, source_size) with the weight and target of each source.

    Sources in code-point order, null last, take ``weights`` in turn and share ``share`` times
    all words by weight. A target stops at ``most`` times its source's size and the excess is
    shared again by weight until none is above: the fill level per weight at which the targets
    add up. One row per source.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ranked = ranked.withColumn("full_at", F.col("cap") / F.col("weight"))
    everything = W.partitionBy()
    before = W.orderBy("full_at", F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(W.unboundedPreceding, -1)
    # Sources fill in the order of full_at. The level at which all adds up is that of the first
    # source which it does not fill; taking later ones as well would only lower it.
    ranked = (
        ranked.withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_used", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_used")) / F.col("_weights"))
    )
    open_here = F.when(F.col("_level") <= F.col("full_at"), F.col("_level"))
    level = F.max(open_here).over(everything)
    return ranked.select(
        "source", "source_size", "weight",
        F.when(level.isNull() | (F.col("full_at") < level), F.col("cap")).otherwise(F.col("weight") * level).alias("target"),
    )


def _draws(seed: int, *what: object) -> np.random.Generator:
    digest = hashlib.sha256(repr((seed, *what)).encode()).digest()
    return np.random.default_rng(int.from_bytes(digest[:8], "little"))


def split_quotas(quotas: Sequence[int], shards: int, seed: int, at: tuple[int, int] | None = None) -> np.ndarray:
    """Whole blocks of each source for each shard; columns add up to ``quotas``.

    A node of the tree covers the shards at[0]..at[1]-1; its left half gets a multivariate
    hypergeometric draw of all its blocks, in proportion to its shards.
    """
    lo, hi = at or (0, shards)
    quotas = np.asarray(quotas, np.int64)
    if hi - lo == 1:
        return quotas[None]
    mid = (lo + hi) // 2
    total = int(quotas.sum())
    n = total * (mid - lo) // (hi - lo)
    left = np.zeros_like(quotas)
    rng, rest = _draws(seed, "split", lo, hi), total
    for i, q in enumerate(quotas.tolist()):
        # One source after another: how many of the n blocks are of this source.
        left[i] = hypergeometric(rng, q, rest - q, n - int(left[:i].sum()))
        rest -= q
    return np.concatenate(
        [split_quotas(left, shards, seed, (lo, mid)), split_quotas(quotas - left, shards, seed, (mid, hi))]
    )


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    if n <= 0 or good == 0:
        return 0
    if bad == 0:
        return min(n, good)
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    mean = n * good / (good + bad)  # beyond numpy's bound: the normal limit, kept in range
    spread = np.sqrt(mean * bad / (good + bad) * (good + bad - n) / max(good + bad - 1, 1))
    return int(np.clip(round(rng.normal(mean, spread)), max(0, n - bad), min(n, good)))


def mix_sources(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, shards: int | None = None, seed: int = 17,
) -> DataFrame:
    """``df`` with size (words of the whole text), source_size, target, taken (words that the mix
    takes of the row, repeats counted) and placed, a list of (shard, place) for each time it is
    taken, ``place`` ordering the rows of a shard at random.

    ``most`` is a whole number of times; no row is taken oftener. A row is taken whole or not
    at all, so the words of a source miss its target by a part of one document: the rows of the
    block where the quota ends are taken in permuted order while they fit, and one more row,
    the nearest in size to what is missing, makes up for the rest. Null and empty texts have size 0 and are taken as often as their block. Null
    sources form one source, weighed last. Null keys and repeated rows are ordinary rows, told
    apart by their text; equal rows share their fate. Columns of the result's names are replaced.
    Without ``shards`` their number follows from the planned words.
    """
    df, (key, text, source), restore = set_aside(df, key, text, source)
    others = [c for c in df.columns if c.lower() not in ADDED]
    row = F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col(text))
    sized = df.select(*others, word_count(text).alias("size"), row.alias("_row"), F.col(source).alias("_from"))
    small, n = settle_counted(sized.select(F.col("_from").alias("_source"), "_row", "size"))
    block = F.pmod(F.xxhash64("_row", F.lit("block")), F.lit(max(BLOCKS, n // BLOCK_ROWS)))
    sized, small = (x.withColumn("_block", block) for x in (sized, small))
    blocks = small.groupBy("_source", "_block").agg(F.sum("size").alias("_words"))
    totals = small.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"))
    targets = settle(source_targets(totals, weights, share, most))
    if shards is None:
        planned = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
        shards = max(SHARDS, int(planned // SHARD_WORDS))
    plan = _plan_blocks(settle(blocks), targets, most, shards, seed)
    whole = ~F.col("_extra") | (F.col("_left") >= F.col("_words"))
    # Where a quota ends inside a block, its rows are taken in permuted order while they fit ...
    on = small["_source"].eqNullSafe(plan["_source"]) & (small["_block"] == plan["_at"])
    placed = small.join(plan.drop("_shards"), on).drop(plan["_source"])
    inside = W.partitionBy("_source", "_block").orderBy("_row", "size")
    ends = placed.where(~whole).select("_source", "_block", "_row", "size", "_left")
    ends = settle(ends.withColumn("_b", F.sum("size").over(inside)).withColumn("_fits", F.col("_b") <= F.col("_left")))
    # ... and what is still missing is made up by the row nearest to it in size.
    gaps = ends.groupBy("_source").agg(
        (F.max("_left") - F.coalesce(F.max(F.when(F.col("_fits"), F.col("_b"))), F.lit(0))).alias("_gap")
    )
    free = placed.where(~F.col("_extra")).select("_source", "_block", "_row", "size").unionByName(
        ends.where(~F.col("_fits")).select("_source", "_block", "_row", "size")
    )
    free = free.join(gaps.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")))
    off = F.abs(F.col("size") - F.col("_gap"))
    filler = free.where(off < F.col("_gap")).groupBy("_source").agg(F.min(F.struct(off.alias("off"), "_row", "_block")).alias("_f"))
    filler = settle(filler.select(F.col("_source").alias("_s"), F.col("_f._block").alias("_b"), F.col("_f._row").alias("_fill")))
    plan = plan.join(filler, plan["_source"].eqNullSafe(filler["_s"]) & (plan["_at"] == filler["_b"]), "left").drop("_s", "_b")
    rows = sized.join(
        plan, sized["_from"].eqNullSafe(plan["_source"]) & (sized["_block"] == plan["_at"])
    )
    taken = ends.where("_fits").select(F.col("_row").alias("_taken_row"), F.col("size").alias("_taken_size")).distinct()
    ended = rows.where(~whole).join(
        taken, (F.col("_row") == F.col("_taken_row")) & (F.col("size") == F.col("_taken_size")), "left"
    )
    ended = ended.withColumn("_x", F.col("_taken_row").isNotNull()).drop("_taken_row", "_taken_size")
    rows = rows.where(whole).withColumn("_x", F.col("_extra")).unionByName(ended)
    filled = ~F.col("_x") & F.col("_fill").isNotNull() & (F.col("_row") == F.col("_fill"))
    last = F.array(F.pmod(F.col("_row"), F.lit(shards)).cast("int"))
    rows = rows.withColumn("_shards", F.when(filled, F.concat(F.slice("_shards", F.lit(1), F.col("_rounds")), last)).otherwise(F.col("_shards")))
    rows = rows.withColumn("_x", F.col("_x") | filled)
    times = F.col("_rounds") + F.col("_x").cast("int")
    return restore(rows.select(
        *others, "size", "source_size", "target", (F.col("size") * times).alias("taken"),
        F.transform(
            F.slice("_shards", F.lit(1), times),
            lambda s, i: F.struct(s.alias("shard"), F.xxhash64(F.col("_row"), s, i).alias("place")),
        ).alias("placed"),
    ))


def _plan_blocks(blocks: DataFrame, targets: DataFrame, most: float, shards: int, seed: int) -> DataFrame:
    """For every block how often all of it is taken (_rounds), whether it is taken once more
    (_extra; _left words of it), and the shards of its takes."""
    facts = blocks.join(targets, blocks["_source"].eqNullSafe(targets["source"])).drop("source", "weight")
    rounds = F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(int(most)))
    turn = W.partitionBy("_source").orderBy(F.xxhash64("_block", "_source", F.lit(seed)), "_block")
    all_blocks = W.partitionBy("_source")
    before = F.sum("_words").over(turn) - F.col("_words")
    left = F.col("target") - F.col("_rounds") * F.col("source_size") - before
    facts = (
        facts.withColumn("_rounds", rounds.cast("int"))
        .withColumn("_turn", F.row_number().over(turn))
        .withColumn("_left", left)
        .withColumn("_extra", (F.col("_left") > 0) & (F.col("_words") > 0))
        .withColumn("_all", F.count(F.lit(1)).over(all_blocks))
        .withColumn("_nth", F.sum(F.col("_extra").cast("int")).over(turn))
    )
    facts = settle(facts)
    quotas = facts.groupBy("_source").agg(F.sum(F.col("_rounds") + F.col("_extra").cast("int")).alias("q"))
    # One number for each source; the tree of draws is made where it is small.
    quotas = quotas.orderBy(F.col("_source").isNull(), F.col("_source").cast("binary")).collect()
    split = split_quotas([int(r["q"]) for r in quotas], shards, seed) if quotas else np.zeros((shards, 0), int)
    ends = [(r["_source"], [int(x) for x in np.cumsum(split[:, i])]) for i, r in enumerate(quotas)]
    kind = dict(blocks.dtypes)["_source"]
    shard_ends = blocks.sparkSession.createDataFrame(ends, f"_s {kind}, _ends array<long>")
    facts = facts.join(shard_ends, facts["_source"].eqNullSafe(shard_ends["_s"]), "left")
    # Takes of a source are numbered: every round over its permuted blocks, then the extra ones;
    # a shard has the next ones up to its quota.
    shard_of = lambda number: F.size(F.filter("_ends", lambda e: e < number))
    turns = F.when(F.col("_rounds") > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("_rounds") - 1, F.lit(0))),
        lambda i: shard_of(i * F.col("_all") + F.col("_turn")),
    )).otherwise(F.array().cast("array<int>"))
    extra = F.when(F.col("_extra"), F.array(shard_of(F.col("_rounds") * F.col("_all") + F.col("_nth")))).otherwise(
        F.array().cast("array<int>")
    )
    return settle(
        facts.select(
            "_source", F.col("_block").alias("_at"), "_words", "source_size", "target", "_rounds", "_extra", "_left",
            F.concat(turns, extra).alias("_shards"),
        )
    )


def mixed_rows(df: DataFrame, names: tuple[str, str] = ("shard", "place"), **options) -> DataFrame:
    """The mix itself: the columns of ``df`` with shard and place (called ``names``), a row for each
    time a row is taken, one partition holding whole shards in shuffled order. Options as
    ``mix_sources``. Columns of ``df`` keep their values, also those with names that ``mix_sources``
    adds, but for columns called as ``names``, which are replaced."""
    shard, place = names
    kept = [c for c in df.columns if c.lower() not in (shard.lower(), place.lower())]
    clash = [c for c in kept if c.lower() in ADDED]
    own = dict(zip(clash, fresh([*df.columns, *ADDED], *clash), strict=True))
    options |= {x: own.get(options[x], options[x]) for x in ("key", "text", "source") if x in options}
    mixed = mix_sources(df.withColumnsRenamed(own), **options)
    (p,) = fresh(mixed.columns, "p")
    rows = mixed.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in kept], F.explode("placed").alias(p))
    rows = rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"{p}.shard").alias(shard), F.col(f"{p}.place").alias(place))
    return rows.repartition(F.col(shard)).sortWithinPartitions(shard, place)
