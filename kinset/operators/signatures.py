"""Join keys under which every close pair of sequences is certain to meet.

``HammingBlocks``: two strings with at most d mismatches agree on at least one
of any d+1 disjoint sets of positions. Block j holds the positions p with
p mod (d+1) = j, so that a stretch shared by a whole group (a common prefix, a
conserved end) is spread over all blocks and none of them is the same for all.

``HammingMasks``: two strings have at most d mismatches exactly if they are equal
once some d places are hidden. Only places that vary within a group need hiding;
where these are few, so are the masks, and all strings under one key are close.

``EditSegments``: cut the shorter string into d+1 segments; a string within
edit distance d holds one of them unchanged, at a place shifted by no more than
the edits and the length difference allow (Li et al., Pass-Join, VLDB 2011).
Any cuts will do. In a large group ``segment_cuts`` puts them where the strings
vary, so that a beginning or end which all share is not a segment of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinset.functions.distance import edit_radius, hamming_count, packed, packed_count
from kinset.operators.copies import Distinct
from kinset.operators.groups import group_sizes
from kinset.operators.joins import attach
from kinset.plans.limits import LIMITS
from kinset.plans.session import settle

_SEP = "\x1f"
# Longest strings whose letters are packed into whole numbers.
PACKED = 64


def _agree_earlier(a: str, b: str) -> Column:
    """Some block before the one that led here is the same in both strings."""
    same = F.zip_with(F.col(f"{a}._prior"), F.col(f"{b}._prior"), lambda x, y: x == y)
    return F.exists(same, lambda x: x)


class HammingBlocks:
    """Keys for Hamming pairs: mismatches/length < ``thres``, or <= ``within``."""

    keys = ("_len", "_key")
    # One pair is reported under the first agreeing block only.
    repeats = False
    calm = False

    def __init__(self, thres: float | None = None, within: int | None = None, distinct: Distinct | None = None):
        self.thres, self.within = thres, within
        self.longest = PACKED + 1 if distinct is None else distinct.longest

    def rows(self, table: DataFrame, carry: Sequence[str]) -> DataFrame:
        n = F.length("seq")
        if self.thres is None:
            bound = F.lit(self.within)
        else:
            # The most mismatches that stay strictly below the threshold.
            most = F.floor(F.lit(self.thres) * n)
            bound = most - F.coalesce((F.try_divide(most, n) >= self.thres).cast("int"), F.lit(0))
        return self._split(
            table.select(
                *carry,
                n.alias("_len"),
                (F.least(bound, n).cast("int") + 1).alias("_parts"),
                F.lit("").alias("_key"),
                F.col("seq").alias("_rest"),
                F.array().cast("array<string>").alias("_prior"),
            ),
            carry,
        )

    def _split(self, rows: DataFrame, carry: Sequence[str]) -> DataFrame:
        """One row per block of what is left of the string."""
        parts = F.col("_parts")

        def block(j: Column) -> Column:
            # Of each stretch of ``parts`` letters the one at place j; the last stretch may lack it.
            pattern = F.concat(
                F.lit("(?s).{"), j.cast("string"), F.lit("}(.).{0,"), (parts - 1 - j).cast("string"), F.lit("}|.+")
            )
            return F.regexp_replace(F.col("_rest"), pattern, F.lit("$1"))

        blocks = F.transform(F.sequence(F.lit(0), parts - 1), block)
        cut = rows.withColumn("_blocks", blocks).select(
            *carry, "_len", "_parts", "_key", "_prior", "_blocks",
            F.posexplode("_blocks").alias("_slot", "_text"),
        )
        before = F.slice("_blocks", F.lit(1), F.col("_slot"))
        after = F.slice("_blocks", F.col("_slot") + 2, parts)
        found = cut.select(
            *carry, "_len", "_parts",
            F.concat_ws(_SEP, "_key", F.col("_slot").cast("string"), "_text").alias("_key"),
            F.array_join(F.concat(before, after), "").alias("_rest"),
            F.concat("_prior", before).alias("_prior"),
        )
        return found if self.longest > PACKED else found.withColumn("_words", packed("_rest", self.longest))

    def _count(self, a: str, b: str) -> Column:
        slow = hamming_count(f"{a}._rest", f"{b}._rest")
        if self.longest > PACKED:
            return slow
        x, y = F.col(f"{a}._words"), F.col(f"{b}._words")
        return F.when(x.isNotNull() & y.isNotNull(), packed_count(x, y, self.longest)).otherwise(slow)

    def refine(self, rows: DataFrame, carry: Sequence[str]) -> DataFrame:
        """Split crowded buckets again: the strings agree on the key, so all
        their mismatches lie in the rest, where the same argument holds."""
        return self._split(rows, carry)

    def closed(self) -> Column:
        """So little is left outside the key that all strings under it are close."""
        return F.length("_rest") < F.col("_parts")

    def index(self, table: DataFrame, carry: Sequence[str]) -> DataFrame:
        return self.rows(table, carry)

    probe = index

    def close(self, a: str, b: str) -> Column:
        near = self._count(a, b) <= self.within if self.thres is None else self.dist(a, b) < self.thres
        # Few pairs are near, and only those have their blocks compared.
        return near & ~_agree_earlier(a, b)

    def dist(self, a: str, b: str) -> Column:
        return F.try_divide(self._count(a, b).cast("double"), F.col(f"{a}._len").cast("double"))

    def one_way(self, a: str, b: str) -> Column:
        """Picks one of the two orders in which a pair of one table meets."""
        return F.col(f"{a}.id") < F.col(f"{b}.id")


@dataclass(frozen=True)
class Masks:
    """By length: the places (from 0) that vary within a group, and the sets of those to hide, as
    indexes into them. ``wide`` is the largest number of strings that can be equal under a mask."""

    places: dict[int, tuple[int, ...]]
    hidden: dict[int, tuple[tuple[int, ...], ...]]
    wide: int

    @property
    def most(self) -> int:
        return max((len(h) for h in self.hidden.values()), default=0)

    def _by_length(self, of: Callable[[int], Column], otherwise: Column) -> Column:
        found = None
        for n in self.places:
            is_n = F.col("_len") == n
            found = F.when(is_n, of(n)) if found is None else found.when(is_n, of(n))
        return otherwise if found is None else found.otherwise(otherwise)

    def varying(self, seq: str) -> Column:
        """The letters of a string of length ``_len`` at the places that vary."""
        return self._by_length(lambda n: _letters(seq, self.places[n]), F.lit(""))

    def shown(self, slot: int, text: str) -> Column:
        """What mask ``slot`` leaves of ``varying``; the whole if there are fewer masks."""

        def of(n: int) -> Column:
            hide = self.hidden[n][slot] if slot < len(self.hidden[n]) else ()
            return _letters(text, [i for i in range(len(self.places[n])) if i not in hide])

        return self._by_length(of, F.col(text))

    def slots(self, text: str) -> Column:
        """For each mask a struct of its number, what it leaves, what it hides, and which
        patterns of mismatches among the hidden letters are reported under it.

        The pairs whose mismatches are a set S meet under each mask that holds S. They are
        reported under the one in which the other places are the smallest ones outside S.
        """

        def one(n: int, slot: int, hide: tuple[int, ...]) -> Column:
            whole = range(len(self.places[n]))
            mine = 0
            for pattern in range(1 << len(hide)):
                differ = {p for i, p in enumerate(hide) if pattern >> i & 1}
                rest = [p for p in hide if p not in differ]
                if rest == [p for p in whole if p not in differ][: len(rest)]:
                    mine |= 1 << pattern
            shown = _letters(text, [i for i in whole if i not in hide])
            return F.struct(
                F.lit(slot).alias("_slot"), shown.alias("_key"), _letters(text, hide).alias("_hidden"),
                F.lit(mine).cast("bigint").alias("_mine"),
            )

        kind = "array<struct<_slot:int,_key:string,_hidden:string,_mine:bigint>>"
        return self._by_length(
            lambda n: F.array(*[one(n, i, h) for i, h in enumerate(self.hidden[n])]).cast(kind), F.array().cast(kind)
        )


def _letters(text: str, places: Sequence[int]) -> Column:
    """The letters of a string at some places, in order."""
    runs: list[list[int]] = []
    for p in places:
        if runs and runs[-1][0] + runs[-1][1] == p:
            runs[-1][1] += 1
        else:
            runs.append([p, 1])
    return F.concat(F.lit(""), *[F.substring(text, p + 1, n) for p, n in runs])


def _spans(distinct: Distinct) -> dict[int, list[int]]:
    """By length and place, how far the code points there reach within a group; 0 where none varies."""
    if "spans" not in distinct.known:
        n = F.length("seq").alias("_len")
        places = range(distinct.longest)
        code = lambda p: F.ascii(F.substring("seq", p + 1, 1))
        reach = [(F.max(code(p)) - F.min(code(p))).alias(f"_{p}") for p in places]
        per_group = distinct.table.groupBy(*distinct.group, n).agg(*reach)
        rows = per_group.groupBy("_len").agg(*[F.max(f"_{p}").alias(f"_{p}") for p in places]).collect()
        # At most one row for each length up to PACKED.
        distinct.known["spans"] = {r["_len"]: [r[f"_{p}"] for p in range(r["_len"])] for r in rows}
    return distinct.known["spans"]


def masks_for(distinct: Distinct | None, thres: float | None = None, within: int | None = None) -> Masks | None:
    """The masks for pairs of ``distinct`` in groups large enough to be worth it; None where they are too many."""
    if distinct is None or distinct.metric != "hamming" or distinct.widest <= LIMITS.bucket_rows:
        return None
    if not 0 < distinct.longest <= PACKED:
        return None
    places, hidden, wide = {}, {}, 1
    for n, spans in sorted(_spans(distinct).items()):
        vary = tuple(p for p, span in enumerate(spans) if span)
        # The most mismatches that stay strictly below the threshold.
        most = max(d for d in range(n + 1) if d == 0 or (d <= within if thres is None else d / n < thres))
        hide = min(most, len(vary))
        # A pattern of the hidden letters is a bit of a whole number.
        if comb(len(vary), hide) > LIMITS.masks or hide > 5:
            return None
        places[n] = vary
        # Places with many letters first: they join most, so later masks find fewer names.
        order = sorted(range(len(vary)), key=lambda i: -spans[vary[i]])
        hidden[n] = tuple(tuple(sorted(h)) for h in combinations(order, hide))
        wide = max(wide, (1 + max(spans, default=0)) ** hide)
    return Masks(places, hidden, wide)


class HammingMasks(HammingBlocks):
    """Keys for Hamming pairs where few places vary: what each of ``masks`` leaves of a string."""

    keys = ("_len", "_slot", "_key")
    refine = None

    def __init__(self, masks: Masks, thres: float | None = None, within: int | None = None):
        super().__init__(thres, within)
        self.masks = masks
        # No key can be crowded.
        self.calm = masks.wide <= LIMITS.bucket_rows

    def index(self, table: DataFrame, carry: Sequence[str]) -> DataFrame:
        text = table.select(*carry, F.length("seq").alias("_len"), "seq").withColumn("_text", self.masks.varying("seq"))
        return text.select(*carry, "_len", F.inline(self.masks.slots("_text")))

    probe = index

    def _differ(self, a: str, b: str) -> list[Column]:
        most = max((len(h) for hides in self.masks.hidden.values() for h in hides), default=0)
        letter = lambda side, i: F.substring(f"{side}._hidden", i + 1, 1)
        return [(letter(a, i) != letter(b, i)).cast("int") for i in range(most)]

    def _count(self, a: str, b: str) -> Column:
        return sum(self._differ(a, b), F.lit(0))

    def close(self, a: str, b: str) -> Column:
        pattern = sum((d * (1 << i) for i, d in enumerate(self._differ(a, b))), F.lit(0))
        return F.call_function("shiftright", F.col(f"{a}._mine"), pattern).bitwiseAND(F.lit(1)) == 1


class EditSegments:
    """Keys for edit pairs: distance < ``thres``, or <= ``within``."""

    keys = ("_key",)
    # A pair can meet under several segments.
    repeats = True
    calm = False
    refine = None

    def __init__(
        self, thres: float | None = None, within: int | None = None, distinct: Distinct | None = None
    ):
        self.radius = edit_radius(thres) if within is None else within
        self.distinct = distinct
        self.cuts = None if distinct is None else segment_cuts(distinct, self.radius)

    def _segment(self, length: Column, i: Column, cuts: Column | None) -> tuple[Column, Column]:
        """Start (from 0) and length of segment i of a string: between its group's
        cuts, or of even lengths, the longer ones last."""
        parts = self.radius + 1
        short = F.floor(length / F.lit(parts))
        n_short = F.lit(parts) - length % parts
        longer = F.greatest(i - n_short, F.lit(0))
        start, size = i * short + longer, short + F.when(i >= n_short, 1).otherwise(0)
        if cuts is None:
            return start, size
        at, end = F.get(cuts, i.cast("int")), F.get(cuts, (i + 1).cast("int"))
        return F.coalesce(at.cast("bigint"), start), F.coalesce((end - at).cast("bigint"), size)

    @staticmethod
    def _key(length: Column, i: Column, text: Column) -> Column:
        return F.concat_ws(":", length.cast("string"), i.cast("string"), text)

    def _rows(self, table: DataFrame, carry: Sequence[str], keys: Column) -> DataFrame:
        return table.select(
            *carry,
            F.col("seq").alias("_seq"),
            F.length("seq").alias("_len"),
            F.explode(F.array_distinct(keys)).alias("_key"),
        )

    def _with_cuts(self, table: DataFrame, reach: int) -> tuple[DataFrame, Column | None]:
        """Attach the cuts of all lengths from ``reach`` below a string's own to it."""
        if self.cuts is None:
            return table, None
        group, rows = self.distinct.group, self.distinct.rows
        near = self.cuts.select(
            *group, F.explode(F.sequence(F.col("_n"), F.col("_n") + reach)).alias("_of"),
            F.struct("_n", "_cuts").alias("_entry"),
        )
        near = near.groupBy(*group, "_of").agg(F.map_from_entries(F.collect_list("_entry")).alias("_by"))
        table = attach(table.withColumn("_of", F.length("seq")), near, [*group, "_of"], rows)
        return table, F.col("_by")

    def index(self, table: DataFrame, carry: Sequence[str]) -> DataFrame:
        """Segments of each string, under its own length."""
        n = F.length("seq")
        table, by = self._with_cuts(table, 0)
        cuts = None if by is None else by[n]

        def key(i: Column) -> Column:
            start, size = self._segment(n, i, cuts)
            return self._key(n, i, F.substring("seq", (start + 1).cast("int"), size.cast("int")))

        return self._rows(
            table, carry, F.transform(F.sequence(F.lit(0), F.lit(self.radius)), key)
        )

    def probe(self, table: DataFrame, carry: Sequence[str]) -> DataFrame:
        """Substrings at the places where a shorter or equal string's segment
        may lie in this one."""
        n, d = F.length("seq"), self.radius
        segments = F.sequence(F.lit(0), F.lit(d))
        table, by = self._with_cuts(table, d)

        def at_length(shorter: Column) -> Column:
            gap = n - shorter
            cuts = None if by is None else by[shorter]

            def at_segment(i: Column) -> Column:
                start, size = self._segment(shorter, i, cuts)
                first = F.greatest(start - F.floor((F.lit(d) - gap) / 2), F.lit(0))
                last = F.least(start + F.floor((F.lit(d) + gap) / 2), n - size)
                return F.transform(
                    F.sequence(first, last),
                    lambda p: self._key(
                        shorter, i, F.substring("seq", (p + 1).cast("int"), size.cast("int"))
                    ),
                )

            return F.flatten(F.transform(segments, at_segment))

        lengths = F.sequence(F.greatest(n - d, F.lit(0)), n)
        return self._rows(table, carry, F.flatten(F.transform(lengths, at_length)))

    def close(self, a: str, b: str) -> Column:
        return F.levenshtein(F.col(f"{a}._seq"), F.col(f"{b}._seq"), self.radius) >= 0

    def dist(self, a: str, b: str) -> Column:
        return F.levenshtein(F.col(f"{a}._seq"), F.col(f"{b}._seq")).cast("double")

    def one_way(self, a: str, b: str) -> Column:
        return (F.col(f"{a}._len") < F.col(f"{b}._len")) | (F.col(f"{a}.id") < F.col(f"{b}.id"))


def signature(
    metric: str,
    thres: float | None = None,
    within: int | None = None,
    distinct: Distinct | None = None,
):
    """Keys for a metric; ``distinct`` lets those for edit distance fit its groups."""
    if metric == "hamming":
        masks = masks_for(distinct, thres, within)
        if masks is not None:
            return HammingMasks(masks, thres, within)
        return HammingBlocks(thres=thres, within=within, distinct=distinct)
    return EditSegments(thres=thres, within=within, distinct=distinct)


def segment_cuts(distinct: Distinct, d: int) -> DataFrame | None:
    """Where to cut the strings of each large group into d+1 segments, by length:
    ``(group, _n, _cuts)`` with ``_cuts`` from 0 to the length ``_n``.

    Two strings of a group agree at a place with the sum of the squared shares of
    the letters there. If places are independent, the rows under one segment are
    the group's rows times the product of these over the segment; cuts are put so
    that the products are about equal. They steer cost only.
    """
    if distinct.metric != "edit" or d < 1 or distinct.widest <= LIMITS.bucket_rows:
        return None
    name = ("cuts", d)
    if name in distinct.known:
        return distinct.known[name]
    group = list(distinct.group)
    table = distinct.table.select(*group, "seq").withColumn("_all", F.lit(0))
    keys = [*group, "_all"]
    sizes = settle(group_sizes(table, keys).withColumnRenamed("n", "_rows"))
    wide = sizes.where(F.col("_rows") > LIMITS.bucket_rows)
    counts = sizes.withColumnRenamed("_rows", "_n")
    table = attach(table, wide.select(*keys, "_rows"), keys, distinct.rows, "inner", counts)
    n = F.length("seq")
    # A string needs a letter for each segment.
    letters = table.where(n > d + 1).select(
        *group, n.alias("_n"), F.posexplode(F.split("seq", "")).alias("_at", "_letter")
    )
    place = [*group, "_n", "_at"]
    shares = letters.groupBy(*place, "_letter").agg(F.count(F.lit(1)).cast("double").alias("_c"))
    per_place = shares.groupBy(*place).agg(
        # A little weight for every place keeps segments from growing far beyond the rest.
        (F.lit(0.01) - F.log(F.sum(F.col("_c") * F.col("_c")) / F.sum("_c") / F.sum("_c"))).alias("_w")
    )
    per_length = per_place.groupBy(*group, "_n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "_w"))), lambda x: x["_w"]).alias("_w")
    )
    zero = F.lit(0.0)
    # Weight before the middle of each place.
    before = F.aggregate(
        "_w",
        F.struct(zero.alias("sum"), F.array().cast("array<double>").alias("mids")),
        lambda s, w: F.struct(
            (s["sum"] + w).alias("sum"),
            F.concat(s["mids"], F.array(s["sum"] + w / 2)).alias("mids"),
        ),
    )
    cuts = F.aggregate(
        F.sequence(F.lit(1), F.lit(d)),
        F.array(F.lit(0)),
        lambda done, j: F.concat(
            done,
            F.array(
                F.least(
                    F.greatest(
                        F.size(F.filter("_before.mids", lambda m: m < F.col("_before.sum") * j / (d + 1))),
                        F.element_at(done, -1) + 1,
                    ),
                    F.col("_n") - (F.lit(d + 1) - j),
                )
            ),
        ),
    )
    found = per_length.select(*group, "_n", before.alias("_before")).select(
        *group, "_n", F.concat(cuts, F.array(F.col("_n"))).alias("_cuts")
    )
    distinct.known[name] = settle(found)
    return distinct.known[name]
