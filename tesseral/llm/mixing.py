"""Mixing sources to target weights by Poisson replication.

Each document gets a uniform number from a seeded hash of its identifier; the Poisson distribution
whose mean is its source's target repetition rate is inverted there, the document is exploded by
that count, and all copies are ordered by a second hash: a global shuffle that any rerun repeats.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, fold, partitions, settle, shielded, text_or_empty

#: Exponent of the default weights: a source's weight is its size to this power.
SMOOTHING = 0.5
SEED = "mix-1"
#: How far the distribution is looked at on either side of its mode, in roots of the mean and steps.
TAIL_ROOTS, TAIL_STEPS = 12, 24
#: Hexadecimal digits of the hash that make the uniform number; 52 bits are exact in a double.
UNIFORM_DIGITS = 13


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 digest of the parts, null parts as '-'."""
    joined = F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts))
    return F.conv(F.substring(F.md5(joined), 1, UNIFORM_DIGITS), 16, 10).cast("double") / F.lit(float(16**UNIFORM_DIGITS))


def identifier() -> Column:
    """What a document is drawn by: its doc_id, and without one its text and source."""
    return F.coalesce(F.col("doc_id").cast("string"), F.sha2(F.concat_ws("\n", F.coalesce("source", F.lit("-")), text_or_empty()), 256))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, *, total: float | None = None) -> DataFrame:
    """(source, size, rate): a source's size in characters and how often its documents should
    appear on average, so that its share of `total` characters (the present total by default) is
    its weight. Without `weights`, size to the power SMOOTHING; sources that `weights` leaves out
    get none. A source of only empty texts repeats once."""
    sizes = docs.groupBy("source").agg(F.sum(F.length(text_or_empty())).alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(SMOOTHING)))
    else:
        if any(not math.isfinite(w) or w < 0 for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        cases = [F.when(F.col("source") == k, float(w)) for k, w in weights.items()]
        weighed = sizes.withColumn("weight", F.coalesce(*cases, F.lit(0.0)))
    weighed = settle(weighed)
    found = weighed.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    want = float(total if total is not None else found["size"] or 0)
    if not found["weight"]:
        share = F.lit(0.0)
    else:
        share = F.col("weight") * F.lit(want) / F.lit(float(found["weight"]))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.try_divide(share, F.col("size")))
    return weighed.select("source", "size", rate.alias("rate"))


def _reach(rate: Column) -> tuple[Column, Column, Column]:
    """The least, the most likely and the largest count that are looked at."""
    mode, width = F.floor(rate).cast("int"), F.ceil(F.lit(TAIL_ROOTS) * F.sqrt(rate) + F.lit(TAIL_STEPS)).cast("int")
    return F.greatest(mode - width, F.lit(0)), mode, mode + width


def cumulated(rate: Column) -> Column:
    """P(X <= k) of the Poisson distribution for k from the first of `_reach` to the last. Each term
    follows from its neighbour, outwards from the mode; their sum scales them, so no rate underflows
    and the work grows with the root of the rate."""
    low, mode, high = _reach(rate)
    none = F.array().cast("array<double>")
    up = lambda ks: fold(ks, "array<double>", F.lit(1.0), lambda p, k: (p * rate / k, F.array(p * rate / k)))
    down = lambda ks: fold(ks, "array<double>", F.lit(1.0), lambda p, k: (p * k / rate, F.array(p * k / rate)))
    below = F.when(mode > low, bound(F.sequence(mode, low + 1, F.lit(-1)), down)).otherwise(none)
    terms = F.concat(F.reverse(below), F.array(F.lit(1.0)), bound(F.sequence(mode + 1, high), up))
    sums = bound(terms, lambda ps: fold(ps, "array<double>", F.lit(0.0), lambda s, p: (s + p, F.array(s + p))))
    scaled = bound(sums, lambda all_: bound(F.element_at(all_, -1), lambda last: F.transform(all_, lambda s: s / last)))
    return F.when(rate <= 0, F.array(F.lit(1.0))).otherwise(scaled)


def _below(cdf: str, u: str) -> Column:
    """How many numbers of a sorted array are not above u, by binary search."""
    steps = f"sequence(cast(ceil(log2(size({cdf}) + 1)) as int), 0, -1)"
    return F.expr(f"aggregate({steps}, 0, (at, b) -> if(at + shiftleft(1, b) <= size({cdf}) and get({cdf}, at + shiftleft(1, b) - 1) <= {u}, at + shiftleft(1, b), at))")


@shielded
def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    *,
    total: float | None = None,
    seed: str = SEED,
) -> DataFrame:
    """`docs` replicated to the target weights, with mix_copy (from 0) and mix_key, ordered by mix_key.

    One row per source is aggregated (partially before the shuffle); documents join those few
    numbers, which adaptive execution broadcasts while small and splits by skew otherwise. Nothing
    is capped: a hot source only has a lower rate.

    Nulls: a null source is a source of its own, a null text has no size; a document without doc_id is
    drawn by its source and text. Repeated rows share one count, each of them appears that often. Empty
    table: empty result.
    Input columns named mix_copy or mix_key are replaced; other columns are carried along.
    """
    docs = docs.drop("mix_copy", "mix_key")
    rated = rates(docs, weights, total=total)
    low, _, _ = _reach(F.col("rate"))
    table = settle(rated.select(F.col("source").alias("__source"), low.alias("__low"), cumulated(F.col("rate")).alias("__cdf")))
    joined = docs.join(table, F.col("source").eqNullSafe(F.col("__source")), "left")
    drawn = uniform(F.lit(f"{seed}-count"), identifier())
    copies = (
        joined.withColumn("__u", drawn)
        .withColumn("__n", F.col("__low") + _below("__cdf", "__u"))
        .where("__n > 0")
        .select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("mix_copy"))
    )
    key = F.md5(F.concat_ws("\n", F.lit(seed), identifier(), F.col("mix_copy").cast("string")))
    # digests are spread evenly, so their first digits tell the range: no splitters need be sampled
    n = partitions(docs.sparkSession)
    part = F.expr(f"cast(cast(conv(substring(mix_key, 1, 8), 16, 10) as bigint) * {n} div 4294967296 as int)")
    placed = copies.withColumn("mix_key", key).repartitionById(n, part)
    return placed.sortWithinPartitions("mix_key")
