"""Toxicity scores from a convolutional text classifier trained in numpy.

Words, and their beginnings of a few bytes, are hashed into a table of embeddings,
so that endings and compounds of a known stem resemble it. Filters of several widths slide over
the whole text, the largest answer of each filter over the text is kept, and a
linear layer turns these into a probability. The model is fitted on a bounded
sample of labelled rows; every text is scored whole. Scores depend on the text
alone. Cuts are calibrated on all labelled rows, in the classes' own proportion: one for
each language that has enough of them; other languages take the common one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinset.llm.text import (
    SpanHasher,
    each_text,
    forget,
    fresh,
    lower_table,
    mix,
    pieces,
    slices,
    text_buffers,
    trim,
    word_spans,
    word_table,
)

WIDTHS = (1, 2, 3)
#: Bytes of the beginnings of a word that count beside the word.
STEMS = (4, 6)
#: The common cut; scores are scaled so that it is the best one on the calibration rows.
CUT = 0.3
#: Bytes of text scored at once.
PART = 1 << 17
#: Bins of the scores for each unit of their logits, from which the cuts are taken.
BINS = 256


@dataclass
class FitOptions:
    """Sizes of the fit. ``rows`` bounds the labelled rows of each class that it uses."""

    rows: int = 6000
    buckets: int = 1 << 15
    dim: int = 16
    filters: int = 16
    epochs: int = 8
    batch: int = 32
    rate: float = 0.05
    decay: float = 1e-4
    seed: int = 5
    #: Share of the fit's rows kept to choose the epoch, and labelled rows of each class a language needs.
    held: float = 0.25
    language_rows: int = 40


class WordBuckets:
    """Bucket numbers of the words of texts and their stems (a row each): letters, digits and all non-ASCII bytes; A-Z in
    lower case. Bucket 0 stands between texts."""

    def __init__(self, buckets: int):
        forget()
        spaces = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
        self.inside, self.lower = word_table(spaces), lower_table()
        self.hasher, self.buckets = SpanHasher(256, seed=23), np.uint64(buckets - 1)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = self.lower[data]
        starts, ends, first = word_spans(data, offsets, self.inside)
        sums = self.hasher.sums(data)
        stops = [ends, *[np.minimum(starts + n, ends) for n in STEMS]]
        hashes = np.stack([self.hasher.spans(sums, starts, e) for e in stops], 1)
        hashes += np.arange(len(stops), dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D)
        return (mix(hashes) % self.buckets).astype(np.int32) + np.int32(1), first


@dataclass
class Network:
    """Embeddings, filters by width, output layer; then the scale of the scores."""

    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    power: float = 1.0  # by ``calibrate``, as ``cuts``
    cuts: dict[str, float] = field(default_factory=dict)

    def lay(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts side by side with empty places between them, and where each begins."""
        gap = max(WIDTHS)
        n = len(first) - 1
        starts = first[:-1] + gap * np.arange(n)
        places = np.arange(len(ids)) + gap * np.repeat(np.arange(n), np.diff(first))
        laid = np.zeros((len(ids) + gap * (n + 1), ids.shape[1]), np.int32)
        laid[places] = ids
        return laid, starts

    def pooled(self, ids: np.ndarray, first: np.ndarray, where: bool = False):
        """Largest answer of every filter over every text, and with ``where`` its place."""
        laid, starts = self.lay(ids, first)
        x = self.embed[laid[:, 0]]
        for i in range(1, laid.shape[1]):
            x += self.embed[laid[:, i]]
        n = len(laid) - max(WIDTHS) + 1
        tops, places = [], []
        for width, filters in zip(WIDTHS, self.filters, strict=True):
            answer = x[:n] @ filters[0]
            for j in range(1, width):
                answer += x[j : n + j] @ filters[j]
            # To the first place that holds no word, so never into the next text.
            stops = starts + np.diff(first) + 1
            top = np.maximum.reduceat(answer, np.stack([starts, stops], 1).ravel(), axis=0)[::2]
            tops.append(top)
            if where:
                places.append(
                    np.stack([s + answer[s:e].argmax(0) for s, e in zip(starts, stops, strict=True)])
                )
        h = np.maximum(np.concatenate(tops, 1) + self.bias, 0)
        return (h, laid, x, places) if where else h

    def raw(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        z = self.pooled(ids, first) @ self.out + np.float32(self.out_bias)
        return 1 / (1 + np.exp(-z.astype(np.float64).clip(-30, 30)))

    def scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.raw(ids, first) ** self.power


def _start(o: FitOptions, rng: np.random.Generator) -> Network:
    f32 = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    return Network(
        0.3 * f32(o.buckets, o.dim),
        [f32(w, o.dim, o.filters) / np.float32(np.sqrt(w * o.dim)) for w in WIDTHS],
        np.zeros(len(WIDTHS) * o.filters, np.float32),
        0.1 * f32(len(WIDTHS) * o.filters),
        0.0,
    )


def fit(texts: list[np.ndarray], labels: np.ndarray, langs: list[str | None], o: FitOptions) -> Network:
    """A network for bucket numbers of texts and their labels (0 or 1), not yet calibrated.

    Without rows of both classes every score is that of the only class, or 0.
    """
    rng = np.random.default_rng(o.seed)
    net = _start(o, rng)
    labels = np.asarray(labels, np.float32)
    if len(labels) == 0 or labels.min() == labels.max():
        net.out[:] = 0
        net.out_bias = 30.0 if len(labels) and labels.max() == 1 else -30.0
        return net
    order = rng.permutation(len(labels))
    n_held = int(len(labels) * o.held)
    held, train = order[:n_held], order[n_held:]
    if not 0 < labels[held].sum() < len(held):
        held, train = order, order
    params = [net.embed, *net.filters, net.bias, net.out]
    seen = [np.full(p.shape[:1] if i == 0 else p.shape, 1e-6, np.float32) for i, p in enumerate(params)]
    share = labels[train].mean()
    net.out_bias = float(np.log(share / (1 - share)))
    best, best_state = np.inf, None
    for _ in range(o.epochs):
        rng.shuffle(train)
        for b in range(0, len(train), o.batch):
            rows = train[b : b + o.batch]
            first = np.concatenate([[0], np.cumsum([len(texts[r]) for r in rows])])
            ids = np.concatenate([texts[r] for r in rows])
            h, laid, x, places = net.pooled(ids, first, where=True)
            p = 1 / (1 + np.exp(-(h @ net.out + np.float32(net.out_bias)).clip(-30, 30)))
            d = ((p - labels[rows]) / len(rows)).astype(np.float32)
            g_out = h.T @ d
            g_h = np.outer(d, net.out) * (h > 0)
            grads: list = [None, *[np.zeros_like(f) for f in net.filters], g_h.sum(0), g_out]
            touched, deltas = [], []
            for i, width in enumerate(WIDTHS):
                g = g_h[:, i * o.filters : (i + 1) * o.filters]
                for j in range(width):
                    at = places[i] + j
                    grads[1 + i][j] = np.einsum("nf,nfd->df", g, x[at])
                    delta = (g[:, :, None] * net.filters[i][j].T[None]).reshape(-1, o.dim)
                    for words in laid[at].reshape(len(delta), -1).T:
                        touched.append(words)
                        deltas.append(delta)
            words, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            g_words = np.zeros((len(words), o.dim), np.float32)
            np.add.at(g_words, inverse, np.concatenate(deltas))
            seen[0][words] += (g_words**2).mean(1)
            step = np.float32(o.rate) / np.sqrt(seen[0][words])
            net.embed[words] -= step[:, None] * g_words + np.float32(o.decay) * net.embed[words]
            net.embed[0] = 0
            for k in range(1, len(params)):
                seen[k] += grads[k] ** 2
                params[k] -= np.float32(o.rate) * grads[k] / np.sqrt(seen[k]) + np.float32(o.decay) * params[k]
            net.out_bias -= o.rate * float(d.sum())
        p = _raw_all(net, texts, held)
        loss = -np.log(np.where(labels[held] == 1, p, 1 - p).clip(1e-9)).mean()
        if loss < best:
            best, best_state = loss, ([q.copy() for q in params], net.out_bias)
    for q, kept in zip(params, best_state[0], strict=True):
        q[...] = kept
    net.out_bias = best_state[1]
    return net


def _raw_all(net: Network, texts: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    out = []
    for b in range(0, len(rows), 64):
        some = rows[b : b + 64]
        first = np.concatenate([[0], np.cumsum([len(texts[r]) for r in some])])
        out.append(net.raw(np.concatenate([texts[r] for r in some]), first))
    return np.concatenate(out)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def _best_cut(bins: list) -> float:
    """The cut with the best F1 over bins of scores (label, bin, n, low, high, the ends in logits),
    in the middle of the gap below the last accepted bin."""
    numbers, at = np.unique([-r["bin"] for r in bins], return_inverse=True)  # from the highest scores down
    count = np.zeros((2, len(numbers)), np.int64)
    low, high = np.full(len(numbers), np.inf), np.full(len(numbers), -np.inf)
    for i, r in zip(at.tolist(), bins, strict=True):
        count[r["label"], i] += r["n"]
        low[i], high[i] = min(low[i], r["low"]), max(high[i], r["high"])
    hits, taken = np.cumsum(count[1]), np.cumsum(count.sum(0))
    i = int((2 * hits / (taken + hits[-1])).argmax())
    below = high[i + 1] if i + 1 < len(numbers) else _logit(1 / (1 + np.exp(-low[i])) / 2)
    return float(np.clip(1 / (1 + np.exp(-(low[i] + below) / 2)), 1e-6, 1 - 1e-6))


def calibrate(
    net: Network, docs: DataFrame, labels: DataFrame, key: str, text: str, lang: str, o: FitOptions
) -> Network:
    """Sets the scale of the scores, by which ``CUT`` is the best common cut, and the cuts of the
    languages, from all rows of ``docs`` (key, text, lang) with a label (key, _label). Only
    a histogram of the scores comes to the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # fixed size: buckets x dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        buckets = WordBuckets(len(model.embed))
        for batch in (part for whole in batches for part in slices(whole)):
            found = [np.zeros(0)]
            for _, _, data, offsets in each_text(batch.column(1), PART):
                found.append(_logit(model.raw(*buckets.of(data, offsets))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.concatenate(found))], names=["_key", "_lang", "_z"]
            )

    kind = docs.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), F.lit(0.0).alias("_z")).schema
    # Scored where they lie: texts do not move.
    scored = docs.select(key, text, lang).mapInArrow(run, kind)
    scored = scored.join(labels.select(F.col(key).alias("_key"), F.col("_label").cast("int").alias("label")), "_key")
    rows = scored.groupBy(F.col("_lang").alias("lang"), "label", F.floor(F.col("_z") * BINS).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("_z").alias("low"), F.max("_z").alias("high")
    ).collect()
    total = lambda some, y: sum(r["n"] for r in some if r["label"] == y)
    if not min(total(rows, 0), total(rows, 1)):
        return net
    net.power = float(np.log(CUT) / np.log(_best_cut(rows)))
    by_lang: dict[str, list] = {}
    for r in rows:
        if r["lang"] is not None:
            by_lang.setdefault(r["lang"], []).append(r)
    for name, own in sorted(by_lang.items()):
        if min(total(own, 0), total(own, 1)) >= o.language_rows:
            net.cuts[name] = float(_best_cut(own) ** net.power)
    return net


def known_labels(labels: DataFrame, allowed: Column, key: str, label: str) -> DataFrame:
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & allowed)
    return known.groupBy(key).agg(F.max(label).alias("_label"))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, allowed: Column, o: FitOptions, key: str, label: str
) -> DataFrame:
    """At most ``o.rows`` labelled rows of each class: those with the smallest key hashes.

    Of rows that repeat a key, one label is used: the largest.
    """
    known = known_labels(labels, allowed, key, label)
    by_class = [
        known.where(F.col("_label") == y).orderBy(F.xxhash64(key), key).limit(o.rows) for y in (0, 1)
    ]
    sample = by_class[0].unionByName(by_class[1])
    return docs.join(F.broadcast(sample), key)  # at most 2 x rows ids


def train(
    docs: DataFrame,
    labels: DataFrame,
    allowed: Column | None = None,
    options: FitOptions | None = None,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    lang: str = "lang",
) -> Network:
    """Fits on labelled documents for which ``allowed`` holds (a condition on ``key``).

    ``lang`` only chooses the cut. Rows with null keys or labels are left out, null
    texts count as empty. The rows fitted on are bounded by ``options.rows`` of each class;
    the cuts come from all labelled rows that are allowed.
    """
    o = options or FitOptions()
    allowed = F.lit(True) if allowed is None else allowed
    languages = F.col(lang) if lang in docs.columns else F.lit(None)
    picked = docs.select(F.col(key), F.col(text).alias("_text"), languages.cast("string").alias("_lang"))
    rows = labelled_sample(picked, labels.select(key, label), allowed, o, key, label)

    # The sample comes to the driver in as few bytes as hold a bucket.
    kind = np.uint16 if o.buckets < 1 << 16 else np.int32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = WordBuckets(o.buckets)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            words = []
            for a, b in pieces(offsets):
                own = offsets[a : b + 1] - offsets[a]
                ids, first = buckets.of(data[offsets[a] : offsets[b]], own)
                ids = ids.astype(kind)
                words += [ids[first[i] : first[i + 1]].tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.binary()), batch.column(2), batch.column(3)],
                names=["k", "words", "lang", "label"],
            )

    wanted = rows.select(F.col(key).cast("string"), "_text", "_lang", F.col("_label").cast("int"))
    got = wanted.mapInArrow(run, "k string, words binary, lang string, label int").toArrow()
    keys, words, langs, given = (got.column(i).to_pylist() for i in range(4))
    del got
    order = sorted(range(len(keys)), key=lambda i: (keys[i], words[i]))
    texts = [np.frombuffer(words[i], kind).reshape(-1, 1 + len(STEMS)) for i in order]
    y = np.array([given[i] for i in order])
    net = fit(texts, y, [langs[i] for i in order], o)
    # The driver stays beside its JVM.
    del texts, words
    trim()
    if len(y) == 0 or y.min() == y.max():
        return net
    known = known_labels(labels.select(key, label), allowed, key, label)
    usable = picked.where(F.col(key).isNotNull() & allowed)
    return calibrate(net, usable, known, key, "_text", "_lang", o)


def score(
    df: DataFrame, net: Network, text: str = "text", lang: str = "lang", out: str = "score", accepted_only: bool = False
) -> DataFrame:
    """``df`` with ``score`` (0 to 1), ``cut`` (that of the row's language) and ``rejected``
    (score at or above the cut); with ``accepted_only`` without the rejected rows.

    Null and empty texts have the score of no words. Columns of these names are replaced;
    a missing or unknown language takes the common cut. No shuffle. Rows are scored in small parts,
    so memory is a fixed multiple of a part or of the longest text.
    """
    others = [c for c in df.columns if c.lower() not in (out.lower(), "cut", "rejected")]
    kept = df.select(*[F.col(f"`{c}`") for c in others])
    cut = F.lit(CUT)
    if lang in others:
        for name, value in net.cuts.items():
            cut = F.when(F.col(f"`{lang}`") == name, value).otherwise(cut)
    (t,) = fresh([*df.columns, out], "t")
    rows = df.select(*kept.columns, cut.alias("cut"), F.col(f"`{text}`").cast("string").alias(t))
    added = [T.StructField(out, T.DoubleType()), T.StructField("cut", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    schema = T.StructType([*kept.schema.fields, *added])
    shared = df.sparkSession.sparkContext.broadcast(net)  # fixed size: buckets x dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        buckets = WordBuckets(len(model.embed))
        n = len(others)
        for batch in (part for whole in batches for part in slices(whole)):
            for a, b, data, offsets in each_text(batch.column(n + 1), PART):
                part = batch.slice(a, b - a)
                found = model.scores(*buckets.of(data, offsets))
                rejected = found >= part.column(n).to_numpy()
                scored = pa.RecordBatch.from_arrays(
                    [*part.columns[:n], pa.array(found), part.column(n), pa.array(rejected)], names=schema.fieldNames()
                )
                yield scored.filter(pa.array(~rejected)) if accepted_only else scored

    return rows.mapInArrow(run, schema)
