"""Similarity join of documents on their word n-grams, as a blocked matrix product.

Rows of the incidence matrix are documents with different n-gram sets, columns
are n-grams. Its product with its own transpose counts common n-grams. Only blocks
that can hold a linked pair are multiplied:

* A set of n n-grams may lack at most e = n - ceil(t n) of them in a linked set, so two
  linked sets share one of their first e + 1 n-grams in any common order (rarest first
  here, by a counting sketch of fixed size, then by hash). Half as many again are looked
  at beyond these: of the first e + 1 + e/2 at least 1 + e/2 are shared, whichever of the
  two sets ends sooner in the order. Rows below this bound link with nothing.
* A row belongs to the block of its shared first n-gram that most rows have chosen;
  large blocks are split by set size and hash, small ones around the same large one are put
  together, as each of them would meet all of it anew. Two blocks meet if they share one of the
  first n-grams and their set sizes allow a link.
* Inside a pair of blocks, rows whose n-grams are too rarely shared for the bound of
  their size are dropped, overlaps are accumulated over slices of columns, and pairs
  below the bound that follows from their sizes are discarded.

Every pair of rows lies in one pair of blocks, so links are counted once. A block
pair puts out one row for each row of it that is linked, never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinset.llm.anchors import id_filter, matching
from kinset.llm.text import (
    WordHasher,
    distinct,
    each_text,
    forget,
    mix,
    packed_texts,
    shingle_hashes,
    signed,
    slices,
    unpack,
)
from kinset.operators.components import components
from kinset.operators.joins import attach
from kinset.plans.session import settle, settle_counted

#: Cells of the counting sketch, and parts in which tasks hand it on.
CELLS, CELL_PARTS = 1 << 20, 16
#: Weight of a block; a row weighs its set's size and ROW_WEIGHT.
BLOCK, ROW_WEIGHT = 400_000, 200
#: A home below 1/RIM of a block's weight joins others around a heavier one.
RIM = 8
#: Columns multiplied at once.
COLUMNS = 4096


class Shingler:
    """The sets of distinct word n-grams of texts, as sorted hashes of 64 bits."""

    def __init__(self, words: int):
        forget()
        self.words, self.hasher = words, WordHasher()

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        hashes, first = self.hasher.of(data, offsets)
        return [
            distinct(shingle_hashes(hashes[first[i] : first[i + 1]], self.words))
            for i in range(len(offsets) - 1)
        ]

    def sets_of(self, texts: list[bytes]) -> list[np.ndarray]:
        offsets = np.cumsum([0] + [len(t) for t in texts])
        return self.sets(np.frombuffer(b"".join(texts), np.uint8), offsets)


def set_key(grams: np.ndarray) -> int:
    """One number for a set; equal sets have equal numbers."""
    if len(grams) == 0:
        return 0
    with np.errstate(over="ignore"):
        total = mix(grams ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
        return int(mix(np.array([total + np.uint64(len(grams))], np.uint64)).view(np.int64)[0])


def describe(docs: DataFrame, words: int) -> DataFrame:
    """For each row (``_id``, ``_text``) the number and key of its n-grams; further rows
    (``cell`` not null) hold the tasks' counts of n-grams by cell of the sketch."""
    per_part = CELLS // CELL_PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        names = ["_id", "n", "key", "cell", "counts"]
        shingler, seen = Shingler(words), set()
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            n, keys = [], []
            for _, _, data, offsets in each_text(batch.column(1)):
                sets = shingler.sets(data, offsets)
                own = [set_key(s) for s in sets]
                new = [s for s, k in zip(sets, own, strict=True) if not (k in seen or seen.add(k))]
                if new:
                    counts += np.bincount(np.concatenate(new) & np.uint64(CELLS - 1), minlength=CELLS)
                n += [len(s) for s in sets]
                keys += own
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.int64()),
                 pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=names,
            )
        blobs = [
            zlib.compress(counts[i * per_part : (i + 1) * per_part].astype(np.int32).tobytes(), 1)
            for i in range(CELL_PARTS)
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(CELL_PARTS, pa.int64()), pa.nulls(CELL_PARTS, pa.int64()), pa.nulls(CELL_PARTS, pa.int64()),
             pa.array(range(CELL_PARTS), pa.int32()), pa.array(blobs, pa.binary())], names=names,
        )

    return docs.mapInArrow(run, "_id long, n long, key long, cell int, counts binary")


def read_sketch(described: DataFrame) -> np.ndarray:
    """The summed counts of all tasks: ``CELLS`` numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(zlib.decompress(blob), np.int32)
                sums[cell] = sums[cell] + counts if cell in sums else counts.astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()),
             pa.array([np.minimum(v, (1 << 20) - 1).astype(np.uint32).tobytes() for v in sums.values()], pa.binary())],
            names=["cell", "counts"],
        )

    parts = described.where("cell is not null").select("cell", "counts")
    rows = parts.repartition(CELL_PARTS, "cell").mapInArrow(run, "cell int, counts binary").collect()
    sketch = np.zeros((CELL_PARTS, CELLS // CELL_PARTS), np.uint32)
    for r in rows:
        sketch[r["cell"]] = np.frombuffer(r["counts"], np.uint32)
    return sketch.ravel()


def first_grams(docs: DataFrame, words: int, num: int, den: int, sketch: np.ndarray) -> DataFrame:
    """(gram, key, n, lead): the first n-grams of each set, once per task and set; lead tells
    those by which linked sets must meet from those that are only counted."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, counts = Shingler(words), set(), shared.value
        for batch in batches:
            for _, _, data, offsets in each_text(batch.column(1)):
                grams, keys, sizes, leads = [], [], [], []
                for s in shingler.sets(data, offsets):
                    n = len(s)
                    if n == 0 or (k := set_key(s)) in seen:
                        continue
                    seen.add(k)
                    e = spare(n, num, den)
                    p = min(n, e + 1 + e // 2)
                    order = (counts[s & np.uint64(CELLS - 1)].astype(np.uint64) << np.uint64(44)) | (s >> np.uint64(20))
                    # All that are not after the p-th: n-grams of equal rank are not told apart.
                    ranked = np.partition(order, (e, p - 1))
                    take = order <= ranked[p - 1]
                    own = s[take]
                    grams.append(own)
                    leads.append(order[take] <= ranked[e])
                    keys.append((k, len(own)))
                    sizes.append(n)
                if not grams:
                    continue
                times = [c for _, c in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(grams))),
                     pa.array(np.repeat(np.array([k for k, _ in keys], np.int64), times)),
                     pa.array(np.repeat(np.array(sizes, np.int64), times)), pa.array(np.concatenate(leads))],
                    names=["gram", "key", "n", "lead"],
                )

    return docs.mapInArrow(run, "gram long, key long, n long, lead boolean")


def spare(n: int, num: int, den: int) -> int:
    """How many n-grams of a set of n may be missing in a linked set."""
    return n - -(-num * n // den)


def shared_grams(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(gram, key, n, df): first n-grams that two rows or more have, of rows that share enough."""
    several = "min(key) over (partition by gram) <> max(key) over (partition by gram)"
    some = entries.withColumn("_s", F.expr(several)).where("_s").drop("_s").dropDuplicates(["gram", "key"])
    some = settle(some)
    # The smallest linked set has m = ceil(t n) n-grams; it shows 1 + e(m)/2 shared ones at least.
    m = f"(({num} * n + {den - 1}) div {den})"
    least = F.expr(f"1 + (({m} - ({num} * {m} + {den - 1}) div {den}) div 2)")
    able = some.groupBy("key", "n").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= least).select("key")
    leads = some.where("lead").select("gram", "key", "n").join(able, "key")
    return settle(
        leads.selectExpr("gram", "key", "n", "count(1) over (partition by gram) as df").where("df > 1")
    )


def blocks_of(shared: DataFrame, num: int, den: int) -> DataFrame:
    """(key, n, block): the block of each row that has a shared first n-gram."""
    best = lambda rows, *by: rows.groupBy("key", "n").agg(F.max(F.struct(*by, "gram")).alias("_h")).select(
        "key", "n", F.col("_h.gram").alias("home")
    )
    # Rows choose their most frequent n-gram, then the one that most rows have chosen.
    chosen = best(shared, "df").groupBy(F.col("home").alias("gram")).agg(F.count(F.lit(1)).alias("votes"))
    home = settle(best(shared.join(chosen, "gram"), "votes", "df"))
    home = home.withColumn("level", F.floor(F.log("n") / float(np.log(den / num))))
    weight = F.sum(F.col("n") + ROW_WEIGHT)
    weights = settle(home.groupBy("home").agg(weight.alias("w")))
    # The heaviest home that a home shares an n-gram with.
    at = settle(shared.join(home.select("key", "home"), "key").select("gram", "home").distinct().join(weights, "home"))
    top = at.groupBy("gram").agg(F.max(F.struct("w", "home")).alias("top"))
    hubs = at.where(F.col("w") < BLOCK / RIM).join(top, "gram").groupBy("home").agg(F.max("top").alias("hub"))
    hubs = hubs.where(F.col("hub.w") >= BLOCK / RIM).select("home", F.xxhash64("hub.home", F.lit("rim")).alias("rim"))
    home = settle(home.join(hubs, "home", "left").withColumn("unit", F.when(F.col("rim").isNull(), F.col("key")).otherwise(F.col("home"))))
    # Small homes around a heavy one are put together, each of them whole.
    home = home.withColumn("home", F.coalesce("rim", "home"))
    by_level = settle(home.groupBy("home", "level").agg(weight.alias("w")))
    heavy = by_level.groupBy("home").agg(F.sum("w").alias("all")).where(F.col("all") > BLOCK)
    split = heavy.join(by_level, "home").select("home", "level", F.ceil(F.col("w") / BLOCK).alias("parts"))
    parts = F.when(F.col("parts").isNull(), F.xxhash64("home")).otherwise(
        F.xxhash64("home", "level", F.pmod(F.xxhash64("unit", F.lit(1)), F.col("parts")))
    )
    return home.join(split, ["home", "level"], "left").select("key", "n", parts.alias("block"))


def block_pairs(shared: DataFrame, placed: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): pairs of blocks to be multiplied, and each block of two rows or more with itself."""
    at = shared.join(placed.select("key", "block"), "key")
    met = at.groupBy("gram", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    gram = "min(block) over (partition by gram) <> max(block) over (partition by gram)"
    met = settle(met.withColumn("_many", F.expr(gram)).where("_many").drop("_many"))
    a, b = met.alias("a"), met.alias("b")
    fits = (F.col("b.hi") * den >= F.col("a.lo") * num) & (F.col("a.hi") * den >= F.col("b.lo") * num)
    across = (
        a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.block") < F.col("b.block")) & fits)
        .select(F.col("a.block").alias("a"), F.col("b.block").alias("b"))
        .distinct()
    )
    own = placed.groupBy("block").count().where("count > 1")
    return across.unionByName(own.select(F.col("block").alias("a"), F.col("block").alias("b")))


def multiply(sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between the rows of two blocks (``side`` 0 and 1), or among the rows of one.

    Returns two index arrays (rows of the left, rows of the right) and the matrix of links.
    """
    n = np.array([len(s) for s in sets])
    rows = np.arange(len(sets))
    alone = not side.any()
    grams = np.concatenate(sets)
    owner = np.repeat(rows, n)
    columns, inverse = np.unique(grams, return_inverse=True)
    if alone:
        common = np.bincount(inverse) > 1
    else:
        left = np.zeros(len(columns), bool)
        right = np.zeros(len(columns), bool)
        left[inverse[side[owner] == 0]] = True
        right[inverse[side[owner] == 1]] = True
        common = left & right
    keep = common[inverse]
    # A row needs at least num/den of its set in common with another row.
    able = np.bincount(owner[keep], minlength=len(sets)) * den >= n * num
    a = np.flatnonzero(able & (side == 0))
    b = a if alone else np.flatnonzero(able & (side == 1))
    links = np.zeros((len(a), len(b)), bool)
    if len(a) == 0 or len(b) == 0 or (alone and len(a) < 2):
        return a, b, links
    place = np.full(len(sets), -1)
    place[a] = np.arange(len(a))
    place_b = place if alone else np.full(len(sets), -1)
    place_b[b] = np.arange(len(b))
    keep &= able[owner]
    number = np.cumsum(common) - 1
    column, owner = number[inverse[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, int(column[-1]) + 1, COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + COLUMNS])
        c, o = column[lo:hi] - first, owner[lo:hi]
        left = np.zeros((len(a), COLUMNS), np.float32)
        if alone:
            left[place[o], c] = 1
            total += left @ left.T
        else:
            right = np.zeros((len(b), COLUMNS), np.float32)
            of_a = side[o] == 0
            left[place[o[of_a]], c[of_a]] = 1
            right[place_b[o[~of_a]], c[~of_a]] = 1
            total += left @ right.T
    overlap = total.astype(np.int64)
    links = overlap * den >= (n[a][:, None] + n[b][None, :] - overlap) * num
    if alone:
        np.fill_diagonal(links, False)
    return a, b, links


def forest(a: np.ndarray, b: np.ndarray, links: np.ndarray, rows: int) -> np.ndarray:
    """For each row the smallest row of its component within the block pair, -1 without links."""
    label = np.full(rows, -1)
    touched = np.zeros(rows, bool)
    touched[a[links.any(1)]] = True
    touched[b[links.any(0)]] = True
    at_a, at_b = np.full(rows, -1), np.full(rows, -1)
    at_a[a], at_b[b] = np.arange(len(a)), np.arange(len(b))
    for start in np.flatnonzero(touched):
        if label[start] >= 0:
            continue
        front = np.array([start])
        label[start] = start
        while len(front):
            reached = np.zeros(rows, bool)
            if len(x := at_a[front][at_a[front] >= 0]):
                reached[b[links[x].any(0)]] = True
            if len(x := at_b[front][at_b[front] >= 0]):
                reached[a[links[:, x].any(1)]] = True
            front = np.flatnonzero(reached & (label < 0))
            label[front] = start
    return label


def product(rows: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(key, root, links): sets of each block pair that are linked in it, the first set
    reached there, and how many documents each is linked with there.

    ``rows``: pair, side, key, copies, _packed, in one task for each pair. A key may come with
    texts of other sets, where rows share an id; those are passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        held: dict[int, tuple[int, int, list[bytes]]] = {}
        now = None

        def sets_of(keys: list[int]) -> list[np.ndarray]:
            blobs = [(k, blob) for k in keys for blob in held[k][2]]
            sets = shingler.sets_of(unpack([blob for _, blob in blobs]))
            if len(sets) == len(keys):
                return sets
            own = {k: s for (k, _), s in zip(blobs, sets, strict=True) if set_key(s) == k}
            return [own[k] for k in keys]

        def finish() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            keys = np.array(sorted(held))
            facts = [held[k] for k in keys.tolist()]
            side = np.array([f[0] for f in facts])
            copies = np.array([f[1] for f in facts])
            if side.any() and side.all():
                return None
            a, b, links = multiply(sets_of(keys.tolist()), side, num, den)
            if not links.any():
                return None
            degree = np.zeros(len(keys), np.int64)
            degree[a] += links @ copies[b]
            if len(a) != len(b) or (a != b).any():
                degree[b] += links.T @ copies[a]
            label = forest(a, b, links, len(keys))
            linked = np.flatnonzero(label >= 0)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys[linked]), pa.array(keys[label[linked]]), pa.array(degree[linked])],
                names=["key", "root", "links"],
            )

        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            pairs, sides, keys, copies = (c.to_pylist() for c in columns[:4])
            for i, pair in enumerate(pairs):
                if pair != now:
                    if (done := finish()) is not None:
                        yield done
                    held, now = {}, pair
                blobs = held.setdefault(keys[i], (sides[i], copies[i], []))[2]
                if (blob := columns[4][i].as_py()) not in blobs:
                    blobs.append(blob)
        if (done := finish()) is not None:
            yield done

    return rows.mapInArrow(run, "key long, root long, links long")


def with_set_key(
    df: DataFrame, text: str, words: int, name: str, keep: Callable[[pa.RecordBatch], pa.RecordBatch] = lambda part: part
) -> DataFrame:
    """The rows of ``df`` that ``keep`` leaves, with the number of each text's n-gram set (0: empty) as a
    new column ``name``."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in (keep(part) for whole in batches for part in slices(whole)):
            for a, b, data, offsets in each_text(batch.column(at)):
                keys = [set_key(s) for s in shingler.sets(data, offsets)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.int64())], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def ngram_jaccard_join(
    df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """Classes of documents linked by the Jaccard similarity of their word n-grams.

    A-Z count as a-z; words are runs without white space. A text with fewer than
    ``words`` words has its whole sequence as its only n-gram; a null or empty text has
    none and links with nothing. Two documents link when den * common >= num * all.

    Returns one row per row of ``df``: ``key``, n_shingles, component_id (smallest key
    reachable, its own included), n_links (other rows it links with directly), set_key (number
    of its set, 0 if empty) and text_group (the smallest number of a set reached by links between
    texts alone; null if empty). ``key`` must be a whole number; a row whose key is null is
    linked only through rows with the same n-grams (null component without). Repeated rows count
    as copies; rows that repeat a key with another text are one vertex, so what either links with
    is reached by both, but their texts link each for itself.
    Other columns are not read, so their names do not matter. Sets are compared by
    hashes of 64 bits.
    """
    docs = df.select(F.col(key).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    described = settle(describe(docs, words))
    facts = described.where("cell is null").select("_id", "n", "key")
    classes = facts.where("n > 0").groupBy("key", "n").agg(
        F.min("_id").alias("rep"), F.count(F.lit(1)).alias("copies")
    )
    classes, n_classes = settle_counted(classes)
    sketch = read_sketch(described)
    shared = shared_grams(first_grams(docs, words, num, den, sketch), num, den)
    placed = settle(blocks_of(shared, num, den))
    pairs = block_pairs(shared, placed, num, den).withColumn("pair", F.xxhash64("a", "b"))
    # Both ends from one pass: a union would find the pairs twice.
    end = lambda block, side: F.struct(F.col(block).alias("block"), F.lit(side).alias("side"))
    ends = pairs.select("pair", F.inline(F.when(F.col("a") == F.col("b"), F.array(end("a", 0))).otherwise(F.array(end("a", 0), end("b", 1)))))
    members = placed.join(classes.where("rep is not null").drop("n"), "key")
    wanted = settle(members.join(ends, "block").select("key", "rep", "copies", "pair", "side"))
    # Only texts that a block needs are moved.
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(wanted.select("rep")))
    packed = packed_texts(docs, "_id", "_text", lambda part: matching(part, "_id", bits.value))
    rows = wanted.join(packed, wanted["rep"] == packed["_id"]).select("pair", "side", "key", "copies", "_packed")
    rows = rows.repartition("pair").sortWithinPartitions("pair")
    linked = settle(product(rows, words, num, den))
    links = linked.select(F.col("key").alias("src"), F.col("root").alias("dst"))
    groups = components(links).select(F.col("id").alias("key"), F.col("root").alias("_group"))
    # Rows with one key and different texts join the groups of these.
    ids = facts.where("n > 0 and _id is not null").groupBy(F.col("_id").alias("_i")).agg(F.min("key").alias("dst"), F.max("key").alias("_x"))
    ids = ids.where("dst <> _x").select("_i", "dst")
    doubles = facts.where("n > 0").join(ids, F.col("_id") == F.col("_i")).select(F.col("key").alias("src"), "dst")
    doubles, n_doubles = settle_counted(doubles.where("src <> dst").distinct())
    whole = components(links.unionByName(doubles)).select(F.col("id").alias("key"), F.col("root").alias("_whole")) if n_doubles else groups.select("key", F.col("_group").alias("_whole"))
    degree = linked.groupBy("key").agg(F.sum("links").alias("_links"))
    known = settle(classes.join(groups, "key", "left").join(whole, "key", "left").join(degree, "key", "left"))
    # The smallest document of a component; sets without company are components of their own.
    smallest = known.where("_whole is not null").groupBy("_whole").agg(F.min("rep").alias("_least"))
    named = known.join(smallest, "_whole", "left").select(
        "key", "n", F.coalesce("_least", "rep").alias("component_id"), F.coalesce("_group", "key").alias("text_group"),
        (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    out = attach(facts, named, ["key", "n"], n_classes)
    return out.select(
        F.col("_id").alias(key), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", F.when(F.col("n") == 0, F.col("_id"))).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("key").alias("set_key"), "text_group",
    )
