"""Exact deduplication by content sort.

Rows are range-partitioned by sampled splitters over the normalised text, an external sort places
equal texts next to each other, and a comparison of whole neighbouring texts forms the groups; the
smallest identifier of each group stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, partitions, shielded, text_or_empty

#: Code points of the normalised text that the splitters see before its digest. Splitters are
#: sampled onto the driver, so they must not hold whole texts.
SPLIT_PREFIX = 32
#: A text needs at least this many copies before its rows are dealt over several ranges.
HOT_COPIES = 500


def normalised(text: Column) -> Column:
    """The text with each run of white space replaced by one space."""
    return F.regexp_replace(text, f"{SPACE}+", " ")


@shielded
def dedupe(docs: DataFrame, *, hot_copies: int = HOT_COPIES) -> DataFrame:
    """`docs` with keep_id, group_size, kept and text_sha256 added.

    Texts are equal when identical after `normalised`; a null text counts as empty. The splitters
    are the first characters of the normalised text and its digest, so equal texts meet in one
    range; the sort and the neighbour comparison then use the whole text. A text with more copies
    than `hot_copies` (raised with the input so that at most four such texts per partition exist:
    their table is broadcast with that bound) is dealt over as many ranges as it needs, and the
    smallest identifier of the whole group comes from a pre-aggregated count by digest.

    Nulls: a null doc_id never beats a number; if a group has only null ids, keep_id is null and one
    row stays. Repeated rows: of rows with equal text and equal doc_id exactly one stays. An empty
    table gives an empty result. Input columns named like an added one are replaced; all others are
    carried along.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.count()
    limit = max(hot_copies, rows // (4 * n))
    text = text_or_empty()
    added = ("keep_id", "group_size", "kept", "text_sha256")
    docs = docs.drop(*added)
    digest = F.sha2(normalised(text), 256)
    hot = (
        docs.select(digest.alias("__sha"), "doc_id")
        .groupBy("__sha")
        .agg(F.count("*").alias("__copies"), F.min("doc_id").alias("__first"))
        .where(F.col("__copies") > limit)
    )
    keyed = docs.select("*", digest.alias("__sha"), F.substring(normalised(text), 1, SPLIT_PREFIX).alias("__head"))
    shares = F.ceil(F.col("__copies") / limit)
    dealt = keyed.join(F.broadcast(hot), "__sha", "left").withColumn(
        "__share", F.coalesce(F.pmod(F.xxhash64("doc_id"), shares), F.lit(0))
    )
    split_by = ["__head", "__sha", "__share"]
    placed = dealt.repartitionByRange(n, *split_by).withColumn("__norm", normalised(text))
    same = Window.partitionBy(*split_by, "__norm")
    near = same.orderBy(F.col("doc_id").asc_nulls_last())
    run = near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = placed.select(
        *docs.columns,
        "__sha",
        F.row_number().over(near).alias("__nth"),
        F.coalesce("__first", F.first("doc_id").over(run)).alias("keep_id"),
        F.coalesce("__copies", F.count("*").over(run)).alias("group_size"),
    )
    kept = (F.col("__nth") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.select(*docs.columns, "keep_id", "group_size", kept.alias("kept"), F.col("__sha").alias("text_sha256"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that stay, with their own columns. Nulls, ties, repeated rows and empty
    tables: as in `dedupe`."""
    own = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    return dedupe(docs, **options).where("kept").select(*own)
