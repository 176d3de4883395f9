"""Near-duplicate vectors by lattice hashing.

In each of several tables a vector is projected at random to a few blocks of 8 numbers,
and each block is decoded to the nearest point of the E8 lattice, the densest packing in
8 dimensions: its cells are as round as can be, so near vectors share one more often than
with other grids of the same volume. A vector is filed under its cell and looked up there
and in the neighbouring cells whose centres are next nearest. Pairs that meet are verified
by their cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinset.llm.ngram_join import forest
from kinset.llm.text import mix, random_words
from kinset.operators.components import components
from kinset.operators.joins import attach
from kinset.plans.session import settle, settle_counted


@dataclass(frozen=True)
class Lattice:
    """Tables, blocks of 8 projections in each, cells looked up besides the own, and the width
    of a cell relative to the distance of vectors at the threshold."""

    tables: int = 8
    blocks: int = 2
    probes: int = 8
    width: float = 1.9
    seed: int = 3


#: Rows of a bucket, or of a component, that are compared in one task at once.
PART = 2000


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points whose coordinates are whole with an even sum."""
    p = np.rint(x)
    off = x - p
    worst = np.abs(off).argmax(1)
    odd = np.flatnonzero(p.sum(1) % 2 != 0)
    at = worst[odd]
    p[odd, at] += np.where(off[odd, at] >= 0, 1, -1)
    return p


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: whole coordinates with an even sum, or all of them shifted by a half."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - b) ** 2).sum(1) < ((x - a) ** 2).sum(1)
    return np.where(closer[:, None], b, a)


def shortest_e8() -> np.ndarray:
    """The 240 points of E8 nearest to its origin."""
    out = []
    for i in range(8):
        for j in range(i):
            for s in (1, -1):
                for t in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = s, t
                    out.append(v)
    for bits in range(256):
        signs = np.array([1 if bits >> k & 1 else -1 for k in range(8)])
        if (signs < 0).sum() % 2 == 0:
            out.append(signs / 2)
    return np.array(out)


class LatticeHash:
    def __init__(self, dim: int, cosine: float, how: Lattice):
        rng = np.random.default_rng(how.seed)
        self.how = how
        n = 8 * how.blocks
        # A difference at the threshold has about length 1 / width in each block.
        scale = 1 / (how.width * np.sqrt(2 - 2 * cosine))
        self.project = rng.normal(0, scale / np.sqrt(8), (how.tables, dim, n))
        self.shift = rng.uniform(0, 2, (how.tables, n))
        self.around = shortest_e8()
        self.salt = random_words(97, 8 * how.blocks)

    def keys(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """Keys of the own cell and of the probed ones: a row of 1 + probes for each vector."""
        x = vectors @ self.project[table] + self.shift[table]
        parts = x.reshape(len(x), self.how.blocks, 8)
        cells = np.stack([nearest_e8(parts[:, b]) for b in range(self.how.blocks)], 1)
        # Moving to a neighbour adds 2 - 2 e.v to the squared distance of its block.
        gain = np.concatenate([(parts[:, b] - cells[:, b]) @ self.around.T for b in range(self.how.blocks)], 1)
        best = np.argpartition(-gain, self.how.probes, axis=1)[:, : self.how.probes]
        terms = (2 * cells).astype(np.int64).view(np.uint64).reshape(len(x), -1) * self.salt
        own = terms.sum(1, dtype=np.uint64)
        moves = (2 * self.around).astype(np.int64).view(np.uint64)
        moved = np.concatenate(
            [(moves * self.salt[8 * b : 8 * b + 8]).sum(1, dtype=np.uint64) for b in range(self.how.blocks)]
        )
        keys = np.concatenate([own[:, None], own[:, None] + moved[best]], 1)
        return mix(keys + np.uint64((table + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have one, and which rows these are. Vectors that are
    null, empty or zero, or have null or non-finite components, are left out."""
    rows, vectors = [], []
    for i, v in enumerate(column.to_pylist()):
        if not v or any(x is None for x in v):
            continue
        x = np.array(v, np.float64)
        top = np.abs(x).max()
        if not np.isfinite(top) or top == 0:
            continue
        x = x / top
        rows.append(i)
        vectors.append(x / np.sqrt(x @ x) + 0.0)  # no negative zeros
    return np.array(rows, np.int64), vectors


def unit_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(_id, dim, unit, digest): unit vectors as bytes; null where a row has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, vectors = usable(batch.column(1))
            units: list = [None] * batch.num_rows
            dims: list = [None] * batch.num_rows
            for i, v in zip(rows.tolist(), vectors, strict=True):
                units[i], dims[i] = v.tobytes(), len(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=["_id", "dim", "unit"]
            )

    rows = df.select(F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>"))
    return rows.mapInArrow(run, "_id long, dim int, unit binary")


def matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def file_rows(classes: DataFrame, cosine: float, how: Lattice) -> DataFrame:
    """(bucket, role, rep, unit): each vector under its own cells (role 0) and where it is
    looked up (role 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[int, LatticeHash] = {}
        for batch in batches:
            reps = batch.column(0).to_numpy()
            dims = batch.column(1).to_numpy()
            blobs = batch.column(2)
            for dim in np.unique(dims):
                if dim not in hashes:
                    hashes[dim] = LatticeHash(int(dim), cosine, how)
                mine = np.flatnonzero(dims == dim)
                for first in range(0, len(mine), 1000):
                    some = mine[first : first + 1000]
                    own = blobs.take(pa.array(some))
                    vectors = matrix(own.to_pylist())
                    for table in range(how.tables):
                        keys = hashes[dim].keys(vectors, table) + np.uint64(dim)
                        n = keys.shape[1]
                        bucket = np.concatenate([keys[:, 0], keys.ravel()])
                        role = np.repeat([0, 1], [len(some), len(some) * n]).astype(np.int32)
                        at = np.concatenate([np.arange(len(some)), np.repeat(np.arange(len(some)), n)])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(bucket.view(np.int64)), pa.array(role), pa.array(reps[some][at])],
                            names=["bucket", "role", "rep"],
                        )

    return classes.select("rep", "dim", "unit").mapInArrow(run, "bucket long, role int, rep long")


def split_large(rows: DataFrame, key: str, id_: str) -> DataFrame:
    """``rows`` with pair, one task's share of a key: all rows of small keys; of large ones
    every two parts of about ``PART`` rows meet once. part tells the rows' parts, self
    whether a share is one part only."""
    large = rows.groupBy(key).agg(F.countDistinct(id_).alias("_n")).where(F.col("_n") > PART)
    large = large.select(F.col(key).alias("_k"), F.ceil(F.col("_n") / PART).cast("int").alias("_parts"))
    rows = rows.join(large, F.col(key) == F.col("_k"), "left").drop("_k")
    parts = F.coalesce("_parts", F.lit(1))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(id_, F.lit(5)), parts).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    low, high = F.least("part", "_other"), F.greatest("part", "_other")
    return rows.withColumn("pair", F.xxhash64(key, low, high)).withColumn("alone", low == high).drop("_other", "_parts")


def groups_of(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with one key, from rows in order of it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if held and held[0].column(key)[0] != part.column(key)[0]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def met(filed: DataFrame, units: DataFrame, cosine: float) -> DataFrame:
    """(src, dst): enough links to connect what meets in buckets and is linked."""
    both = filed.groupBy("bucket").agg(F.min("rep").alias("_a"), F.max("rep").alias("_b")).where("_a <> _b")
    filed = filed.join(both.select("bucket"), "bucket")
    shares = split_large(filed, "bucket", "rep").join(units, "rep")
    shares = shares.select("pair", "rep", "role", "unit").repartition("pair").sortWithinPartitions("pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share in groups_of(batches, 0):
            reps, first = np.unique(share.column(1).to_numpy(), return_index=True)
            if len(reps) < 2:
                continue
            vectors = matrix(share.column(3).take(pa.array(first)).to_pylist())
            at = np.searchsorted(reps, share.column(1).to_numpy())
            role = share.column(2).to_numpy()
            own, asked = np.zeros(len(reps), bool), np.zeros(len(reps), bool)
            own[at[role == 0]] = True
            asked[at[role == 1]] = True
            a, b = np.flatnonzero(asked), np.flatnonzero(own)
            if len(a) == 0 or len(b) == 0:
                continue
            links = linked(vectors[a], vectors[b], cosine) & (a[:, None] != b[None, :])
            if not links.any():
                continue
            label = forest(a, b, links, len(reps))
            hit = np.flatnonzero((label >= 0) & (label != np.arange(len(reps))))
            yield pa.RecordBatch.from_arrays([pa.array(reps[hit]), pa.array(reps[label[hit]])], names=["src", "dst"])

    return shares.mapInArrow(run, "src long, dst long")


def linked(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    return a @ b.T >= cosine


def degrees(members: DataFrame, cosine: float) -> DataFrame:
    """(rep, n): for the members (component, rep, copies, unit) of components, how many other
    vectors of the component each is linked with."""
    shares = split_large(members, "component", "rep").select("pair", "alone", "part", "rep", "copies", "unit")
    shares = shares.repartition("pair").sortWithinPartitions("pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share in groups_of(batches, 0):
            reps, copies = share.column(3).to_numpy(), share.column(4).to_numpy()
            part = share.column(2).to_numpy()
            vectors = matrix(share.column(5).to_pylist())
            if share.column(1)[0].as_py():
                links = linked(vectors, vectors, cosine)
                np.fill_diagonal(links, False)
                n = links @ copies
            else:
                a, b = part == part.min(), part != part.min()
                links = linked(vectors[a], vectors[b], cosine)
                n = np.zeros(len(reps), np.int64)
                n[a], n[b] = links @ copies[b], links.T @ copies[a]
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(n.astype(np.int64))], names=["rep", "n"])

    return shares.mapInArrow(run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))


def near_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, how: Lattice | None = None
) -> DataFrame:
    """Links between vectors with a cosine of at least ``cosine``, by lattice hashing.

    Returns one row per row of ``df``: ``key``, n_links (other vectors linked directly),
    component_id (smallest key reachable by links, its own included) and kept (whether that is
    its own key). Every vector is filed and looked up. Links are found if a chain of pairs that
    meet in buckets connects their vectors: within what is so connected all pairs are compared,
    in parts. Vectors of different lengths are not linked. Equal vectors are linked and count as
    copies. Rows that repeat a key with another vector are one vertex, so what either links with is
    reached by both. Vectors that are null, empty, zero or hold null or non-finite components, and rows
    whose key is null, link with nothing. Other columns are not read.
    """
    how = how or Lattice()
    all_rows = settle(unit_vectors(df, key, vector).withColumn("rep", F.xxhash64("dim", "unit")))
    good = all_rows.where("unit is not null and _id is not null")
    # Classes of equal unit vectors are the vertices, named by a hash; keys come in at the end.
    classes, n = settle_counted(
        good.groupBy("rep", "dim", "unit").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    )
    units = classes.select("rep", "unit")
    edges = settle(met(file_rows(classes, cosine, how), units, cosine))
    roots = settle(components(edges).select(F.col("id").alias("rep"), F.col("root").alias("component")))
    members = classes.join(roots, "rep").select("component", "rep", "copies", "unit")
    degree = degrees(members, cosine)
    # Rows with one key and different vectors join the components of these.
    ids = good.groupBy(F.col("_id").alias("_i")).agg(F.min("rep").alias("dst"), F.max("rep").alias("_x")).where("dst <> _x")
    doubles = good.join(ids.select("_i", "dst"), F.col("_id") == F.col("_i")).select(F.col("rep").alias("src"), "dst")
    doubles, n_doubles = settle_counted(doubles.where("src <> dst").distinct())
    if n_doubles:
        links = roots.select(F.col("rep").alias("src"), F.col("component").alias("dst"))
        roots = components(links.unionByName(doubles)).select(F.col("id").alias("rep"), F.col("root").alias("component"))
    smallest = classes.join(roots, "rep").groupBy("component").agg(F.min("least").alias("_least"))
    named = classes.join(roots, "rep", "left").join(degree, "rep", "left").join(smallest, "component", "left").select(
        "rep", F.coalesce("_least", "least").alias("component_id"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    out = attach(good, named, ["rep"], n, "left").select("_id", "component_id", "n_links").unionByName(
        all_rows.where("unit is null or _id is null").select(
            "_id", F.col("_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")
        )
    )
    return out.select(
        F.col("_id").alias(key), "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
