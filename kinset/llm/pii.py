"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, and a
classifier of spans is trained on what follows from them.

Mail addresses, IP addresses, card numbers and phone numbers in their plain forms are found
by fixed patterns and checks; these base spans always stay. Wider forms (addresses written
with "at" and "dot", IPv6, numbers with other separators or without a country) are candidates.
Every candidate, and every base match whether or not it passes its check, is judged by labelers
that may say yes, no or nothing: the pattern, a checksum or format rule, a gazetteer, the words
before it, and the characters beside it. Votes are counted by Spark for all documents; from the
counts expectation-maximisation estimates, for each kind, how often it is real and how each
labeler votes then. The resulting probabilities are the soft labels by which a logistic
classifier over the shape and surroundings of a span is fitted; it decides which candidates
become spans.
"""

from __future__ import annotations

import ipaddress
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinset.llm.text import fresh, slices
from kinset.plans.session import settle

#: Kinds, in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "check", "gazetteer", "context", "beside")

# The base patterns. Possessive repeats and the look behind a number change no match.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
BASE = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# Wider forms. Every repeat is bounded or starts at a rare sign, so a scan is linear.
SPOKEN = re.compile(
    r"(?P<at>\x20?[\[({<]\x20?(?:at|@)\x20?[\])}>]\x20?|\x20at\x20)"
    r"[A-Za-z0-9-]++(?P<dot>(?:(?:\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)+)",
    re.I,
)
WIDE = {
    "ip": re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::?[0-9A-Fa-f]{1,4}|:)(?::[0-9A-Fa-f]{1,4}){0,6}(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([./_])[0-9]{6}\2[0-9]{5})(?![0-9])"),
    "phone": re.compile(
        r"(?<![0-9A-Za-z+(.])(?:\([0-9]{2,5}\)[\x20./-]?|00[1-9][0-9]{0,2}[\x20./-][0-9]{2,4}[\x20./-]|[0-9]{2,5}[\x20./-])"
        r"[0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9A-Za-z]|[\x20./-][0-9])"
    ),
}
# Gazetteers and cue words (fixed values).
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io ai co de fr es it uk us eu ch at nl be pt br mx ar ca au in jp cn ru pl se no dk fi".split())
PROVIDERS = frozenset("gmail googlemail yahoo hotmail outlook live icloud proton gmx web mail example aol orange free".split())
DIAL_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
CUES = {
    "email": frozenset("mail email e-mail correo courriel contact contacto kontakt write reach schreiben escribe from to von".split()),
    "ip": frozenset("ip ipv4 ipv6 host server address adresse dirección gateway client login from dns ping".split()),
    "card": frozenset("card credit visa mastercard amex karte kreditkarte carte tarjeta payment pay debit".split()),
    "phone": frozenset("tel phone telephone telefon teléfono téléphone call mobile cell fax handy móvil ring whatsapp sms contact".split()),
}
AGAINST = frozenset("version v isbn issn page pages seite página section chapter kapitel figure fig table order invoice total price score date".split())

#: Characters before a span in which cue words are looked for.
REACH = 60


@dataclass(frozen=True)
class LearnOptions:
    """``rows``: most candidates the classifier is fitted on, those with the smallest hashes."""

    rows: int = 20_000
    buckets: int = 1 << 12
    rounds: int = 300
    rate: float = 0.5
    decay: float = 1e-4
    em_rounds: int = 100
    cut: float = 0.5


@dataclass
class SpanModel:
    """How often a kind is real (kind), how labelers vote (kind, real or not, labeler, vote) and
    the weights of the classifier."""

    prior: np.ndarray
    votes: np.ndarray
    weights: np.ndarray
    cut: float = 0.5
    fitted_on: int = field(default=0, compare=False)

    def score(self, features: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[features].sum(), -30, 30))))


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(twice)) % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def passes(kind: str, match: str) -> bool:
    """The check of a base match."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(map(small, match.split(".")))
    digits = only_digits(match)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def mail_addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the mail pattern, from each @ outwards: a run before it is read once."""
    cursor, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > cursor and text[begin - 1] in LOCAL:
            begin -= 1
        found = HOST.match(text, at + 1) if begin < at else None
        if found:
            cursor = found.end()
            yield begin, cursor
        at = text.find("@", max(cursor, at + 1))


def base_matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Kind, start, end of all leftmost matches of the base patterns, and whether they pass."""
    for start, end in mail_addresses(text):
        yield "email", start, end, True
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end(), passes(kind, m[0])


def wide_matches(text: str) -> Iterator[tuple[str, int, int]]:
    """Kind, start and end of the wider forms."""
    for m in SPOKEN.finditer(text):
        if m["at"] == " at " and " dot " not in m["dot"].lower():
            continue
        begin = m.start()
        while begin > 0 and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < m.start():
            yield "email", begin, m.end()
    for kind, pattern in WIDE.items():
        for m in pattern.finditer(text):
            if kind != "ip" or "::" in m[0] or m[0].count(":") == 7:  # not a time of day
                yield kind, m.start(), m.end()


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(kind number, start, end, how): base spans (how 1), base matches that fail their check (-1)
    and, apart from all base spans, the wider forms (0). The failed and the wide do not overlap."""
    found = [(KINDS.index(k), s, e, 1 if ok else -1) for k, s, e, ok in base_matches(text)]
    sure = [x for x in found if x[3] == 1]
    taken = sorted((s, e) for _, s, e, _ in sure)
    # Failed matches of few digits are plain numbers, not candidates.
    open_ = [x for x in found if x[3] == -1 and x[2] - x[1] >= 9]
    open_ += [(KINDS.index(k), s, e, 0) for k, s, e in wide_matches(text)]
    open_.sort(key=lambda x: (-x[3], x[1], x[0], x[2]))
    # Wide forms first, then failed matches, each where nothing stands yet.
    starts, ends = np.array([s for s, _ in taken], np.int64), np.array([e for _, e in taken], np.int64)
    reach = np.maximum.accumulate(ends) if len(ends) else ends
    free = []
    for x in open_:
        i = int(np.searchsorted(starts, x[2]))  # base spans that begin before the end
        if i == 0 or reach[i - 1] <= x[1]:
            free.append(x)
    free.sort(key=lambda x: (x[1], -x[3], x[0], x[2]))
    chosen, last = [], -1
    for x in free:
        if x[1] >= last:
            chosen.append(x)
            last = x[2]
    return sorted(sure) + chosen


def around(text: str, start: int, end: int) -> tuple[list[str], str, str]:
    """The last words before a span, in lower case, and the characters beside it."""
    before = text[max(0, start - REACH) : start]
    words = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?|#|§", before.lower())[-4:]
    return words, text[start - 1] if start else " ", text[end] if end < len(text) else " "


def plain_form(kind: str, span: str) -> str:
    """A spoken mail address as it is meant."""
    if kind != "email":
        return span
    span = re.sub(r"\x20?[\[({<]\x20?(?:at|@)\x20?[\])}>]\x20?|\x20at\x20", "@", span, count=1, flags=re.I)
    return re.sub(r"\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?|\x20dot\x20", ".", span, flags=re.I)


def votes(text: str, kind: str, start: int, end: int, how: int) -> list[int]:
    """What each of ``LABELERS`` says: 1, -1, or 0 for nothing."""
    span = text[start:end]
    words, left, right = around(text, start, end)
    digits = only_digits(span)
    check = known = 0
    if kind == "email":
        name = plain_form(kind, span).lower()
        labels = name.rpartition("@")[2].split(".")
        check = 1 if labels[-1].isalpha() and 2 <= len(labels[-1]) <= 24 and ".." not in name else -1
        known = 1 if labels[-1] in TOP_LEVEL or set(labels) & PROVIDERS else 0
    elif kind == "ip":
        try:
            address = ipaddress.ip_address(span)
            check, known = 1, -1 if address.is_unspecified or address.is_loopback else 1
        except ValueError:
            check = -1
    elif kind == "card":
        check = 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
        two = int(digits[:2] or 0)
        issuer = digits[0] == "4" and len(digits) in (13, 16, 19) or 51 <= two <= 55 and len(digits) == 16
        issuer = issuer or two in (34, 37) and len(digits) == 15 or two in (22, 23, 24, 25, 26, 27, 60, 64, 65) and len(digits) == 16
        known = 1 if issuer else -1
    else:
        check = 1 if 9 <= len(digits) <= 15 else -1 if len(digits) < 7 or len(digits) > 15 else 0
        code = digits[2:] if span.startswith("00") else digits
        if span.startswith(("+", "00")):
            known = 1 if {code[:1], code[:2]} & DIAL_CODES else -1
        elif re.fullmatch(r"(?:19|20)[0-9]{2}[./-][0-9]{3,4}.*|.*[./-](?:19|20)[0-9]{2}", span):
            known = -1  # more like dates
    cue = 1 if CUES[kind].intersection(words) else -1 if AGAINST.intersection(words) else 0
    joined = left.isalnum() or right.isalnum() or left in "_#=/\\$€£" or right in "_=/\\%€"
    return [how, check, known, cue, -1 if joined else 1]


def features(text: str, kind: str, start: int, end: int, said: list[int], buckets: int) -> list[int]:
    """Numbers of what a span looks like and stands in."""
    span = text[start:end]
    words, left, right = around(text, start, end)
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]{5,}", "0", re.sub(r"(?<![0-9])[0-9]{1,4}(?![0-9])", "9", span[:200])))
    side = lambda c: "a" if c.isalpha() else "9" if c.isdigit() else "s" if c.isspace() else c
    names = ["kind", f"shape {shape[:40]}", f"digits {min(len(only_digits(span)), 24)}", f"left {side(left)}", f"right {side(right)}"]
    names += [f"begins {span[:2]}", f"check {said[1]}", f"known {said[2]}", f"cue {said[3]}", f"word {words[-1] if words else ''}"]
    return [zlib.crc32(f"{kind} {n}".encode()) % buckets for n in names]


def code_of(said: list[int]) -> int:
    """Votes as one number."""
    out = 0
    for v in said:
        out = 3 * out + v + 1
    return out


def candidate_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """(kind, votes, features, id, start) of all candidates of ``docs`` (id as text, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for kind, start, end, how in candidates(text):
                    said = votes(text, KINDS[kind], start, end, how)
                    own = np.array(features(text, KINDS[kind], start, end, said, buckets), np.int32).tobytes()
                    out.append((kind, code_of(said), own, key, start))
            if out:
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int32()]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "votes", "features", "id", "start"])

    return docs.mapInArrow(run, "kind int, votes int, features binary, id string, start int")


def said_by(codes: np.ndarray) -> np.ndarray:
    """Votes (0 no, 1 nothing, 2 yes) of numbers by ``code_of``: a row for each."""
    n = len(LABELERS)
    return np.stack([codes // 3 ** (n - 1 - j) % 3 for j in range(n)], 1)


def estimate(said: np.ndarray, n: np.ndarray, rounds: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Prior, labelers' vote shares (not real or real, labeler, vote) and probability of each row
    to be real, for rows of votes that occur ``n`` times, by expectation-maximisation.

    It starts from the balance of the votes, so that a yes means real. One count is added to
    each vote of each labeler, so a labeler without evidence stays neutral.
    """
    real = np.clip(0.5 + 0.15 * (said - 1).sum(1), 0.05, 0.95)
    shares, prior = np.full((2, said.shape[1], 3), 1 / 3), 0.5
    for _ in range(rounds):
        prior = (n @ real + 1) / (n.sum() + 2)
        for y, weight in enumerate((n * (1 - real), n * real)):
            for j in range(said.shape[1]):
                counts = np.bincount(said[:, j], weight, 3) + 1
                shares[y, j] = counts / counts.sum()
        logs = np.log(shares)
        score = [logs[y, np.arange(said.shape[1]), said].sum(1) for y in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1] + np.log((1 - prior) / prior), -500, 500)))
        if np.abs(new - real).max() < 1e-9:
            break
        real = new
    return float(prior), shares, real


def fit(rows: list[np.ndarray], target: np.ndarray, o: LearnOptions) -> np.ndarray:
    """Weights of a logistic classifier of feature numbers with soft targets."""
    weights, squares = np.zeros(o.buckets), np.full(o.buckets, 1e-8)
    if not len(rows):
        return weights
    at = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    for _ in range(o.rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[at], len(rows)), -30, 30)))
        slope = np.bincount(at, (p - target)[row], o.buckets) / len(rows) + o.decay * weights
        squares += slope * slope
        weights -= o.rate * slope / np.sqrt(squares)
    return weights


def train(df: DataFrame, key: str = "doc_id", text: str = "text", options: LearnOptions | None = None) -> SpanModel:
    """Reliabilities from the votes on all candidates of ``df``, and a classifier fitted on at most
    ``options.rows`` of them. To the driver come one row per kind and combination of votes
    (at most 4 x 3^5) and the rows fitted on. Without candidates nothing is ever added."""
    o = options or LearnOptions()
    docs = df.where(F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text")
    )
    rows = settle(candidate_rows(docs, o.buckets))
    counts = rows.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "votes").collect()
    prior, shares = np.full(len(KINDS), 0.5), np.full((len(KINDS), 2, len(LABELERS), 3), 1 / 3)
    soft: dict[tuple[int, int], float] = {}
    for kind in range(len(KINDS)):
        own = [r for r in counts if r["kind"] == kind]
        if own:
            codes = np.array([r["votes"] for r in own])
            prior[kind], shares[kind], real = estimate(said_by(codes), np.array([r["n"] for r in own], float), o.em_rounds)
            soft.update(((kind, c), p) for c, p in zip(codes.tolist(), real.tolist(), strict=True))
    picked = rows.orderBy(F.xxhash64("id", "kind", "start"), "id", "kind", "start", "votes", "features").limit(o.rows).collect()
    target = np.array([soft[r["kind"], r["votes"]] for r in picked])
    weights = fit([np.frombuffer(r["features"], np.int32) for r in picked], target, o)
    return SpanModel(prior, shares, weights, o.cut, len(picked))


SPANS = "spans array<struct<kind: string, start: int, end: int, score: double, base: boolean>>"


def find(df: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """``df`` with spans: kind, start, end (code points, end exclusive), the classifier's score
    and whether the span is a base one; by kind as in ``KINDS``, then start.

    Base spans always stay; other candidates are added where the score is above the model's cut.
    A null text counts as empty and has no spans. A column named spans is replaced, others stay.
    No shuffle; memory is a fixed multiple of a sub-batch or of the longest text.
    """
    added = T._parse_datatype_string(SPANS)
    others = [c for c in df.columns if c.lower() != "spans"]
    (t,) = fresh(df.columns, "t")
    kept = df.select(*[F.col(f"`{c}`") for c in others])
    schema = T.StructType([*kept.schema.fields, *added.fields])
    rows = df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").cast("string").alias(t))
    shared = df.sparkSession.sparkContext.broadcast(model)  # fixed size: the buckets
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        buckets = len(net.weights)
        for batch in (part for whole in batches for part in slices(whole)):
            out = []
            for value in batch.column(len(others)).to_pylist():
                spans = []
                for kind, start, end, how in candidates(value) if value else ():
                    said = votes(value, KINDS[kind], start, end, how)
                    p = net.score(features(value, KINDS[kind], start, end, said, buckets))
                    if how == 1 or p > net.cut:
                        spans.append((kind, start, end, p, how == 1))
                spans.sort()
                out.append([dict(zip(("kind", "start", "end", "score", "base"), (KINDS[k], *rest), strict=True)) for k, *rest in spans])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(others)], pa.array(out, kind_of)], names=schema.fieldNames()
            )

    return rows.mapInArrow(run, schema)


def find_personal_data(
    df: DataFrame, key: str = "doc_id", text: str = "text", options: LearnOptions | None = None
) -> DataFrame:
    """``find`` with a model trained on ``df`` itself. ``key`` only chooses the rows fitted on;
    it may be null or repeat. An empty table gives an empty result."""
    return find(df, train(df, key, text, options), text)
