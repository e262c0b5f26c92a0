"""Choosing members of groups: evenly spaced picks, small groups, distinct contents, stable order."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded_key
from ..plans.working import settle
from .ordering import numbered

# The names of the four places of a grid, in order.
GRID_POSITIONS = ("TOP-LEFT", "TOP-RIGHT", "BOTTOM-LEFT", "BOTTOM-RIGHT")


#: Groups of more rows than this are not numbered by one task.
LARGE = 200_000


def evenly_spaced(rows: DataFrame, group: list[str], order: list[str], k: int = 4, *, large_groups: bool | None = None) -> DataFrame:
    """k rows of each group of k or more, at places i * n div k in the order; adds pos (0..k-1) and
    group_size. Only `rows`' columns travel: pick from keys first and join contents to the picks.

    Groups are numbered by one task each, but for those of more than LARGE rows, which are counted
    first: the rows of these are numbered over all tasks. `large_groups` says so of all groups or none,
    and spares the count."""
    if k < 1:
        raise ValueError("at least one row must be picked")
    if large_groups is None:
        # there are at most a LARGE-th as many such groups as rows, so they are few enough to broadcast
        sizes = rows.groupBy(*(F.col(g).alias(f"__{i}") for i, g in enumerate(group))).count().where(F.col("count") > LARGE).drop("count")
        large = settle(sizes)
        if large.isEmpty():
            return evenly_spaced(rows, group, order, k, large_groups=False)
        same = reduce(lambda a, c: a & c, (F.col(g).eqNullSafe(F.col(f"__{i}")) for i, g in enumerate(group)))
        apart = [rows.join(F.broadcast(large), same, how) for how in ("left_semi", "left_anti")]
        return reduce(DataFrame.unionByName, (evenly_spaced(part, group, order, k, large_groups=one) for part, one in zip(apart, (True, False))))
    if large_groups:
        every = numbered(rows, [*group, *order], "__n")
        sizes = every.groupBy(*(F.col(g).alias(f"__{i}") for i, g in enumerate(group))).agg(F.min("__n").alias("__first"), F.count("*").cast("int").alias("group_size"))
        same = reduce(lambda a, c: a & c, (F.col(g).eqNullSafe(F.col(f"__{i}")) for i, g in enumerate(group)))
        placed = every.join(sizes, same).withColumn("__at", F.col("__n") - F.col("__first")).select(*rows.columns, "group_size", "__at")
    else:
        part = Window.partitionBy(*group)
        placed = rows.withColumn("__at", F.row_number().over(part.orderBy(*order)) - 1).withColumn("group_size", F.count("*").over(part).cast("int"))
    # the only i that can have i * n div k equal to a place is the ceiling of place * k / n
    pos = F.expr(f"cast((__at * {k} + group_size - 1) div group_size as int)")
    picked = placed.withColumn("pos", pos).where(F.expr(f"group_size >= {k} and pos < {k} and cast(pos as bigint) * group_size div {k} = __at"))
    return picked.drop("__at")


def short_groups(rows: DataFrame, group: list[str], k: int = 4) -> DataFrame:
    """Groups that are too small to pick from, with the reason."""
    counted = rows.groupBy(*group).agg(F.count("*").cast("int").alias("n"))
    reason = F.concat(F.lit("At least four source images are required, received " if k == 4 else f"At least {k} members are required, received "), F.col("n").cast("string"))
    return counted.where(F.col("n") < k).withColumn("reason", reason)


def as_array(picks: DataFrame, group: list[str], fields: list[str], name: str = "views") -> DataFrame:
    """One row per group with its picks as an array in order of pos (a bounded number per group)."""
    item = F.struct("pos", *fields)
    return picks.groupBy(*group).agg(F.sort_array(F.collect_list(item)).alias(name))


def view_manifest(picks: DataFrame, group: list[str], *, path: str = "path", sha256: str = "sha256") -> DataFrame:
    """One row per group: its picks as (position, filename, path, sha256) in order of pos."""
    item = F.struct("pos", position_name(F.col("pos")).alias("position"), F.element_at(F.split(path, "/"), -1).alias("filename"), F.col(path).alias("path"), F.col(sha256).alias("sha256"))
    return picks.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(item)), lambda v: v.dropFields("pos")).alias("views"))


def position_name(pos: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, GRID_POSITIONS)), pos + 1)


def duplicate_contents(picks: DataFrame, group: list[str], content_hash: str) -> DataFrame:
    """For every group of picks: how many, how many distinct contents, and whether it is rejected."""
    return (
        picks.groupBy(*group)
        .agg(F.count("*").cast("int").alias("n_picks"), F.countDistinct(content_hash).cast("int").alias("n_distinct"))
        .withColumn("rejected", F.col("n_distinct") < F.col("n_picks"))
    )


def latest(rows: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """Last-wins: the value of the greatest ordinal of each key, combined before the shuffle."""
    return rows.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))


def ordered_reasons(*lists: Column) -> Column:
    """First-wins union of error lists, joined by '; '."""
    return F.array_join(F.array_distinct(F.concat(*lists)), "; ")


def seeded_sample(rows: DataFrame, ident: str, k: int, seed: str | int | None = None) -> DataFrame:
    """A sample of k rows without replacement, in seeded order; a bounded top-k, no full sort.
    Without a seed one is drawn."""
    seed = random.SystemRandom().getrandbits(63) if seed is None else seed
    if k < 0:
        raise ValueError("the sample size must not be negative")
    return rows.orderBy(seeded_key(seed, F.col(ident)), ident).limit(k)


def prefix(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows before any check, so that later rejections do not pull others in."""
    if n < 1:
        raise ValueError("the limit must be positive")
    return rows.orderBy(*order).limit(n)


def path_order(path: Column) -> Column:
    """Orders paths part by part, not as whole strings."""
    return F.split(path, "/")
