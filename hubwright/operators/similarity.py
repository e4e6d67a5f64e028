"""All pairs of strings above an insert/delete similarity, found by an exact filter join.

Two strings of similarity t or more differ in few insertions and deletions, and
each of those destroys at most q of a string's q-grams. So a bounded number of a
string's grams can be missing from its partner, and if all grams are put in one
global order, rare ones first, the first few of both strings must have two grams in
common. Strings are joined on single grams of these prefixes and bands of length, and
pairs with two common ones are compared. Frequent grams, such as a prefix that all
values share, are the last to be used as keys. Nothing is lost: the order only
affects speed.

A string makes as many key rows as its prefix has grams, so work grows with its length and
not with the square. Key rows hold digests, not texts; the texts are fetched for the pairs
that are left.

Strings too short for that guarantee are joined on single characters, with
which any two similar strings have at least one in common.

Short strings that few deletions make equal are joined on what is left after the deletions instead: names that differ in a number
alone have most of their grams in common with all others, but what two of them share after deletions says that they are similar.
So no more pairs meet than are similar, however alike the values.

Longer values that differ in numbers are met by their shape, the value with every digit made the same: no two values are more alike than their
shapes. The grams find the similar shapes, or all of fitting lengths are compared if most have grams in common. The values of two similar
shapes are compared block by block: a pair of values is made once, where it is scored, and not shuffled. Values of which digits are so
large a part that those of one shape are mostly not similar are met by their own grams.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from hubwright.functions.text import indel_ratio, similar_in_blocks, within_reach
from hubwright.session import stage_table

FREQUENT_GRAMS = 10_000  # grams whose frequency is known to the order; a few hundred kB to broadcast
EPS = 1e-9
VARIED, MOST_VARIANTS = 24, 200  # longest string whose deletions are listed, and how many of one length at most
BLOCK_LETTERS = 1 << 13  # letters of the values of one shape that are compared at once with those of another; longer values are blocks of their own
GRAM_COST = 4  # a pair that a gram makes is joined, counted, sorted out and fetched: it costs as much as some pairs compared in a block
TASK_CELLS = 1 << 32  # letters times letters that a task compares, about
SCREENED = 200  # longest string that the JVM's edit distance screens before scoring; its time grows with the square


@dataclass(frozen=True)
class GramFilter:
    """How many grams of which length decide, for a threshold."""

    threshold: float
    q: int
    shared: int
    lost_share: float

    @staticmethod
    def _lost(threshold: float, q: int) -> float:
        """Grams, per character, that a partner may lack.

        Linear in the partner's length, so the extremes decide: the shortest
        partner (deletions only, q grams each) and the longest (insertions
        only, q-1 grams each).
        """
        deletions = 1 - threshold / (2 - threshold)
        insertions = (2 - threshold) / threshold - 1
        return max(q * deletions, (q - 1) * insertions)

    @classmethod
    def of(cls, threshold: float, shared: int = 2) -> GramFilter:
        # longer grams are rarer, but a larger share of them may be lost
        q = next((q for q, most in ((3, 0.3), (2, 0.6)) if cls._lost(threshold, q) <= most), 1)
        return cls(threshold, q, shared, cls._lost(threshold, q))

    @classmethod
    def for_short(cls, threshold: float) -> GramFilter:
        return cls(threshold, 1, 1, cls._lost(threshold, 1))

    def prefix_length(self, length: Column) -> Column:
        return F.floor(self.lost_share * length + EPS).cast("int") + self.shared

    @property
    def too_short(self) -> int:
        """Greatest length whose grams may be fewer than the guarantee needs."""
        bound = math.ceil((self.q + self.shared) / (1 - self.lost_share)) + 1
        fails = [n for n in range(1, bound + 1) if n - self.q + 1 < math.floor(self.lost_share * n + EPS) + self.shared]
        return max(fails, default=0)


def _grams(text: Column, q: int) -> Column:
    places = F.sequence(F.lit(1), F.length(text) - (q - 1))
    return F.when(F.length(text) >= q, F.transform(places, lambda i: F.substring(text, i, F.lit(q))))


def _keyed(values: DataFrame, gram_filter: GramFilter, *more: str) -> DataFrame:
    """One row per gram of a string's deciding prefix: block, digest, length, gram, and the columns ``more``. Repeats of a gram are numbered apart."""
    grams = values.select("block", "digest", *more, F.length("text").alias("length"), F.posexplode(_grams(F.col("text"), gram_filter.q)).alias("place", "gram"))
    frequent = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("uses")).orderBy(F.desc("uses"), "gram").limit(FREQUENT_GRAMS)
    # size bounded by the limit above
    known = grams.join(F.broadcast(frequent), "gram", "left")
    string = ["block", "digest"]
    repeat = F.row_number().over(Window.partitionBy(*string, "gram").orderBy("place"))
    rank = F.row_number().over(Window.partitionBy(*string).orderBy(F.coalesce("uses", F.lit(0)), "gram", "repeat"))
    # one shuffle serves both windows
    ranked = known.repartition(*string).withColumn("repeat", repeat).withColumn("rank", rank)
    deciding = ranked.where(F.col("rank") <= gram_filter.prefix_length(F.col("length")))
    return deciding.select(*string, *more, "length", F.concat_ws("\u0001", "gram", "repeat").alias("gram"))


def _band(length: Column, threshold: float) -> Column:
    """Similar strings lie in one band of lengths or in two neighbouring ones."""
    widest = max((2 - threshold) / threshold, 1 + 1e-6)
    return F.floor(F.log(length.cast("double")) / math.log(widest) + 1e-9).cast("int")


def _least_common(total, threshold: float):
    """Letters that two strings of together ``total`` letters have in common at least; of a number or a column."""
    if isinstance(total, Column):
        return F.greatest(F.lit(1), F.ceil(threshold * total / 2 - EPS)).cast("int")
    return max(1, math.ceil(threshold * total / 2 - EPS))


@dataclass(frozen=True)
class Varied:
    """Pairs of lengths (shorter first) whose strings are joined on deletions, and the lengths up to ``VARIED`` that grams are needed for too."""

    threshold: float
    pairs: tuple[tuple[int, int], ...]
    by_grams: tuple[int, ...]

    @classmethod
    def of(cls, lengths: list[int], threshold: float) -> Varied:
        pairs, others = [], set()
        for i, la in enumerate(lengths):
            for lb in lengths[i:]:
                if la > VARIED or 2 * la < threshold * (la + lb) - EPS:
                    continue
                common = _least_common(la + lb, threshold)
                if lb <= VARIED and max(math.comb(la, common), math.comb(lb, common)) <= MOST_VARIANTS:
                    pairs.append((la, lb))
                else:
                    others |= {la, lb}
        return cls(threshold, tuple(pairs), tuple(sorted(n for n in others if n <= VARIED)))

    def holds(self, la: Column, lb: Column) -> Column:
        return (la * (VARIED + 1) + lb).isin([a * (VARIED + 1) + b for a, b in self.pairs]) & (lb <= VARIED)

    def joined(self, values: DataFrame) -> DataFrame:
        """Pairs of digests that have enough letters in common, each once: block, a (not longer than b), b, la."""
        wanted: dict[int, set[int]] = {}
        for la, lb in self.pairs:
            for n in (la, lb):
                wanted.setdefault(n, set()).add(_least_common(la + lb, self.threshold))
        text, length = F.col("text"), F.length("text")
        common = F.lit(None).cast("array<int>")
        for n, lengths in wanted.items():
            common = F.when(length == n, F.array(*[F.lit(c) for c in sorted(lengths)])).otherwise(common)
        left, variants = F.array(text), None
        for deleted in range(1 + max(n - min(lengths) for n, lengths in wanted.items())):
            if deleted:
                left = _one_deleted(left)
            variants = F.when(length - F.col("common") == deleted, left) if variants is None else variants.when(length - F.col("common") == deleted, left)
        keys = values.select("block", "digest", "text", F.explode(common).alias("common"))
        keys = stage_table(keys.select("block", "digest", length.alias("length"), "common", F.explode(F.transform(variants, lambda v: F.xxhash64(v))).alias("variant")))
        shorter = keys.select("block", "common", "variant", F.col("digest").alias("a"), F.col("length").alias("la"))
        longer = keys.select("block", "common", "variant", F.col("digest").alias("b"), F.col("length").alias("lb"))
        la, lb = F.col("la"), F.col("lb")
        once = (la < lb) | ((la == lb) & (F.col("a") < F.col("b")))
        met = shorter.join(longer, ["block", "common", "variant"]).where(once & (F.col("common") == _least_common(la + lb, self.threshold)) & self.holds(la, lb))
        return met.select("block", "a", "b", "la").distinct()


def _one_deleted(texts: Column) -> Column:
    """Every text without each of its letters, each result once."""
    without = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    return F.array_distinct(F.flatten(F.transform(texts, without)))


def _joined(keyed: DataFrame, gram_filter: GramFilter, varied: Varied, numeric: bool = False) -> DataFrame:
    """Candidate pairs of digests, each once, with enough common grams: block, a (not longer than b), b. Those of ``varied`` lengths are left out.

    ``numeric``: only those with a numeric end.
    """
    band = _band(F.col("length"), gram_filter.threshold)
    mark = ["numeric"] if numeric else []
    shorter = keyed.select("block", "gram", F.explode(F.array(band, band + 1)).alias("band"), F.col("digest").alias("a"), F.col("length").alias("la"), *mark)
    longer = keyed.select("block", "gram", band.alias("band"), F.col("digest").alias("b"), F.col("length").alias("lb"), *mark)
    near = 2.0 * F.col("la") >= gram_filter.threshold * (F.col("la") + F.col("lb")) - EPS
    once = (F.col("la") < F.col("lb")) | ((F.col("la") == F.col("lb")) & (F.col("a") < F.col("b")))
    keys = ["block", "gram", "band"]
    if numeric:  # two joins, so that no pair without one is made
        ends = [(shorter.where("numeric"), longer), (shorter.where("not numeric"), longer.where("numeric"))]
        met = reduce(DataFrame.unionByName, [x.drop("numeric").join(y.drop("numeric"), keys) for x, y in ends])
    else:
        met = shorter.join(longer, keys)
    met = met.where(once & near)
    if varied.pairs:
        met = met.where(~varied.holds(F.col("la"), F.col("lb")))
    common = met.groupBy("block", "a", "b").agg(F.count(F.lit(1)).alias("common"), F.first("la").alias("la"))
    return common.where(F.col("common") >= gram_filter.shared).select("block", "a", "b", "la")


def similar_pairs(values: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a < b`` of distinct strings in one block with ``score >= threshold``.

    ``values`` holds distinct (``block``, ``text``) rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("need 0 < threshold <= 1")
    values = stage_table(values.where(F.length("text") > 0).select("block", "text", F.unhex(F.md5("text")).alias("digest")))
    # lengths up to VARIED and of what may be similar to strings of these
    most = math.floor(VARIED * (2 - threshold) / threshold + EPS)
    lengths = values.select(F.length("text").alias("n")).where(F.col("n") <= most).distinct()
    varied = Varied.of(sorted(r["n"] for r in lengths.collect()), threshold)
    found = [_scored(varied.joined(values), values, threshold).drop("a", "b")] if varied.pairs else []
    by_grams = values.where((F.length("text") > VARIED) | F.length("text").isin(list(varied.by_grams)))
    if not found or not by_grams.isEmpty():
        found += _by_shapes(by_grams, threshold, varied)
    x, y = F.col("x_text"), F.col("y_text")
    return reduce(DataFrame.unionByName, found).select("block", F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "score")


def _scored(pairs: DataFrame, values: DataFrame, threshold: float) -> DataFrame:
    """Those of the candidate pairs that are similar: block, a, b, their texts x_text and y_text, score."""
    for end, name in (("a", "x_text"), ("b", "y_text")):
        pairs = pairs.join(values.select("block", F.col("digest").alias(end), F.col("text").alias(name)), ["block", end])
    x, y = F.col("x_text"), F.col("y_text")
    # above that length only the length is screened, which the join has done
    near = pairs.where((F.greatest(F.length(x), F.length(y)) > SCREENED) | within_reach(x, y, threshold))
    scored = near.select("block", "a", "b", "x_text", "y_text", indel_ratio(x, y).alias("score"))
    return scored.where(F.col("score") >= threshold).select("block", "x_text", "y_text", "score", "a", "b")


def _by_shapes(values: DataFrame, threshold: float, varied: Varied) -> list[DataFrame]:
    """Similar pairs: of values that numbers are a small part of by their shapes, of others by grams."""
    length = F.length("text")
    digits = length - F.length(F.translate("text", "0123456789", ""))
    # two numbers have about half their digits in common: up to that share values of one shape are mostly similar
    numeric = digits > 2 * (1 - threshold) * length + EPS
    values = stage_table(values.select("block", "text", "digest", F.translate("text", "123456789", "0" * 9).alias("shape"), numeric.alias("numeric")))
    members = values.where("not numeric").select("block", F.unhex(F.md5("shape")).alias("key"), F.length("shape").alias("length"), "shape", "text")
    shapes = stage_table(members.select("block", F.col("key").alias("digest"), F.col("shape").alias("text")).distinct())
    digest = lambda text: F.unhex(F.md5(text))
    near = _near_shapes(shapes, threshold, varied).select("block", digest("x_text").alias("a"), digest("y_text").alias("b"))
    alone = shapes.where(~varied.holds(F.length("text"), F.length("text"))) if varied.pairs else shapes
    near = near.unionByName(alone.select("block", F.col("digest").alias("a"), F.col("digest").alias("b")))
    found = [_in_blocks(members.drop("shape"), near, threshold)]
    if not values.where("numeric").isEmpty():
        found.append(_scored(_by_grams(values, threshold, varied, numeric=True), values, threshold).drop("a", "b"))
    return found


def _near_shapes(shapes: DataFrame, threshold: float, varied: Varied) -> DataFrame:
    """Similar shapes: by grams or, if these would make about as many pairs as there are of fitting lengths, in blocks of one length."""
    sizes = shapes.groupBy("block", F.length("text").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    x, y = (sizes.select("block", F.col("n").alias(end), F.col("rows").alias(f"{end}_rows")) for end in ("a", "b"))
    fit = (F.col("a") <= F.col("b")) & (2.0 * F.col("a") >= threshold * (F.col("a") + F.col("b")) - EPS)
    if varied.pairs:
        fit &= ~varied.holds(F.col("a"), F.col("b"))
    lengths = x.join(y, "block").where(fit)
    pairs = F.when(F.col("a") == F.col("b"), F.expr("a_rows * (a_rows - 1) / 2")).otherwise(F.expr("cast(a_rows as double) * b_rows"))
    most = lengths.agg(F.sum(pairs)).first()[0] or 0.0
    main = GramFilter.of(threshold)
    keyed = stage_table(_keyed(shapes.where(F.length("text") > main.too_short), main))
    uses = keyed.groupBy("block", "gram").agg(F.count(F.lit(1)).cast("double").alias("uses"))
    if GRAM_COST * (uses.agg(F.sum(F.expr("uses * (uses - 1) / 2"))).first()[0] or 0.0) < most:
        return _scored(_by_grams(shapes, threshold, varied, keyed=keyed), shapes, threshold)
    members = shapes.select("block", F.length("text").alias("key"), F.length("text").alias("length"), "text")
    return _in_blocks(members, lengths.select("block", "a", "b"), threshold)


def _in_blocks(members: DataFrame, near: DataFrame, threshold: float) -> DataFrame:
    """Similar pairs of texts of the ``near`` pairs of keys, compared block by block: block, x_text, y_text, score.

    ``members``: block, key, length, text; those of a key are of one length. ``near``: block, a, b, each pair once, a key with itself too.
    """
    counted = members.groupBy("block", "key").agg(F.first("length").alias("length"), F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") * F.greatest(F.col("length"), F.lit(32)) / BLOCK_LETTERS)
    counted = stage_table(counted.select("block", "key", parts.alias("parts"), (F.col("n") * F.col("length")).cast("double").alias("letters"), "n"))
    part = F.pmod(F.xxhash64("text"), F.col("parts"))
    blocks = members.select("block", "key", "text").join(counted.select("block", "key", "parts"), ["block", "key"])
    blocks = stage_table(blocks.groupBy("block", "key", part.alias("part")).agg(F.collect_list("text").alias("texts")))
    for end in ("a", "b"):
        near = near.join(counted.select("block", F.col("key").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("parts", "letters", "n")]), ["block", end])
    near = stage_table(near.where("a <> b or a_n > 1").drop("a_n", "b_n"))
    cells = near.agg(F.sum(F.col("a_letters") * F.col("b_letters"))).first()[0] or 0.0
    for end in ("a", "b"):
        near = near.withColumn(f"{end}_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{end}_parts") - 1)))
    keys = ["block", "a", "a_part", "b", "b_part"]
    met = near.select(*keys).where("a <> b or a_part <= b_part")
    for end in ("a", "b"):
        met = met.join(blocks.select("block", F.col("key").alias(end), F.col("part").alias(f"{end}_part"), F.col("texts").alias(f"{end}_texts")), ["block", end, f"{end}_part"])
    tasks = max(members.sparkSession.sparkContext.defaultParallelism, math.ceil(cells / TASK_CELLS))
    met = met.repartition(tasks, *keys).select("block", "a_texts", "b_texts", F.expr("a = b and a_part = b_part").alias("same"))
    return met.mapInArrow(similar_in_blocks(threshold), "block string, x_text string, y_text string, score double")


def _by_grams(values: DataFrame, threshold: float, varied: Varied, numeric: bool = False, keyed: DataFrame | None = None) -> DataFrame:
    """Candidate pairs by grams; ``numeric``: only those with a numeric end. ``keyed``: the main grams, where they are known."""
    main = GramFilter.of(threshold)
    short = GramFilter.for_short(threshold)
    limit = main.too_short
    mark = ["numeric"] if numeric else []
    # partners of a short string are at most this long
    reach = math.floor(limit * (2 - threshold) / threshold + EPS)
    if keyed is None:
        keyed = stage_table(_keyed(values.where(F.length("text") > limit), main, *mark))
    pairs = _joined(keyed, main, varied, numeric)
    if limit:
        small = stage_table(_keyed(values.where(F.length("text") <= reach), short, *mark))
        pairs = pairs.unionByName(_joined(small, short, varied, numeric).where(F.col("la") <= limit))
    return pairs
