"""Bloom filters as plain columns: built in tasks, merged by OR, and asked in place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap of Spark's bitmap functions, and hash functions of a filter.
BITMAP, HASHES = 32768, 4
#: A filter never has more bits than this (32 bits in each of 2 million longs, 16 MB), however many keys
#: there are.
MOST_BITS = 1 << 26


def bits_for(keys: int, per_key: int = 16) -> int:
    """Whole bitmaps with so many bits for each key, MOST_BITS at most: beyond that more values pass
    that are no keys, and are settled by whoever asks."""
    return min(max(-(-keys * per_key // BITMAP), 1) * BITMAP, MOST_BITS)


def _positions(value: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(j), value), F.lit(bits)) for j in range(HASHES)]


def bitmaps(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """(at, map): the bitmaps of a filter of the keys. Tasks build their own, which are merged; null keys
    are none."""
    each = keys.where(F.col(column).isNotNull()).select(F.explode(F.array(*_positions(F.col(column), bits))).alias("p"))
    built = each.groupBy(F.expr(f"p div {BITMAP}").alias("at")).agg(F.bitmap_construct_agg(F.expr(f"p % {BITMAP}")).alias("map"))
    empty = keys.sparkSession.range(bits // BITMAP).select(F.col("id").alias("at"), F.lit(bytearray(BITMAP // 8)).alias("map"))
    return built.unionByName(empty).groupBy("at").agg(F.bitmap_or_agg("map").alias("map"))


def bloom(keys: DataFrame, column: str, bits: int) -> Column:
    """A filter of the keys as a scalar subquery, an array with 32 bits in each long."""
    # the digits of four bytes, the first byte's highest, as one number
    longs = F.expr(f"transform(sequence(0, {BITMAP // 32 - 1}), i -> cast(conv(hex(substring(map, 4 * i + 1, 4)), 16, 10) as bigint))")
    each = bitmaps(keys, column, bits).select("at", longs.alias("longs"))
    return each.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "longs"))), lambda b: b["longs"]))).scalar()


def might_have(filter_: Column, value: Column, bits: int) -> Column:
    """Whether a value may be a key of a filter; never false for one that is."""

    def is_set(p: Column) -> Column:
        bit = F.lit(24) - F.floor((p % 32) / 8).cast("int") * 8 + (p % 8).cast("int")
        return F.call_function("shiftright", F.get(filter_, F.floor(p / 32).cast("int")), bit).bitwiseAND(F.lit(1)) == 1

    found = F.lit(True)
    for p in _positions(value, bits):
        found = found & is_set(p)
    return F.coalesce(found & value.isNotNull(), F.lit(False))


def any_might(keys: DataFrame, column: str, bits: int, values: str) -> Column:
    """Whether one of an array of values may be a key. Spark has no subqueries in functions over arrays,
    so the filter (its size is bounded) is broadcast to vectorised functions, and only the positions of
    the values' bits go there."""
    spark = keys.sparkSession
    whole = b"".join(bytes(r["map"]) for r in bitmaps(keys, column, bits).orderBy("at").collect())
    shared = spark.sparkContext.broadcast(whole)

    @F.arrow_udf("boolean")
    def test(positions: pa.Array) -> pa.Array:
        map_ = np.frombuffer(shared.value, np.uint8)
        at = positions.flatten().to_numpy(zero_copy_only=False)
        found = ((map_[at >> 3] >> (at & 7).astype(np.uint8)) & 1).reshape(-1, HASHES).all(axis=1)
        ends = np.cumsum(positions.value_lengths().to_numpy(zero_copy_only=False)) // HASHES
        sums = np.concatenate([[0], np.cumsum(found)])
        return pa.array(sums[ends] > sums[np.concatenate([[0], ends[:-1]])] if len(ends) else [], pa.bool_())

    known = F.filter(F.coalesce(F.col(values), F.array()), lambda v: v.isNotNull())
    return test(F.flatten(F.transform(known, lambda v: F.array(*_positions(v, bits)))))
