"""Merkle fixity audit of WARC replicas.

Records and the ordered offset ranges that they fill are hashed into trees: over the records of each
archive, then over the archives. Replica roots are compared, and only branches that differ are
followed down to the records that are damaged, missing, added or moved.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, settle

FANOUT = 16
#: Records of an archive, by their number; the levels of its tree before its root.
ARCHIVE_RECORDS, LEVELS = 4096, 3
ARCHIVE_ROOT = LEVELS + 1
#: The number of records whose own cannot be read: that of an archive (-1) which only pages with
#: numbers from -8191 to -4096 share.
UNREADABLE = -ARCHIVE_RECORDS
#: Bytes of the line that opens a record.
OPENING = 10
NODE = "level int, archive long, node long, parent_archive long, parent_node long, lo long, hi long, digest string"


def warc_records(pages: DataFrame, *, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(record_no, record): a WARC resource record of each page, without the two line ends that
    close it. Null addresses and bodies are empty. A null number is replaced by a hash of the rest."""
    url, html = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("url", "html"))
    number = F.coalesce(F.col("page_id").cast("long"), F.shiftrightunsigned(F.xxhash64(url, html), 1))
    record = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        number.cast("string"),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
        html,
    )
    return pages.select(number.alias("record_no"), record.alias("record"))


def write_warc(records: DataFrame, path: str, *, archives: int | None = None) -> None:
    """Writes the records as WARC files, whole archives in record order."""
    archive = F.expr(f"record_no div {ARCHIVE_RECORDS}")
    placed = records.repartition(archives, archive) if archives else records.repartition(archive)
    ordered = placed.sortWithinPartitions(archive, "record_no")
    ordered.select(F.concat("record", F.lit("\r\n")).alias("value")).write.option("lineSep", "\r\n").text(path)


def _owners(pieces: pd.DataFrame) -> pd.DataFrame:
    """Which piece of a file each of its pieces belongs to. A record ends where its length says if that
    is where a piece begins, or the file ends; pieces before that stand in its body. A length that leads
    anywhere else is damaged, and the record is its own piece."""
    pieces = pieces.sort_values(["block", "id"])
    size = OPENING + pieces["size"].to_numpy() + 4
    begins = np.concatenate([[0], np.cumsum(size)])
    begins[-1] -= 4  # the last piece has its closing line ends inside
    ends = begins[:-1] + OPENING + pieces["head"].to_numpy() + 4 + pieces["announced"].to_numpy() + 4
    at = np.searchsorted(begins, ends)
    hit = (pieces["announced"].to_numpy() >= 0) & (at < len(begins)) & (begins[np.minimum(at, len(begins) - 1)] == ends)
    owner, i = np.empty(len(pieces), np.int64), 0
    while i < len(pieces):
        after = max(int(at[i]), i + 1) if hit[i] else i + 1
        owner[i:after] = i
        i = after
    ids, blocks = pieces["id"].to_numpy(), pieces["block"].to_numpy()
    return pd.DataFrame({"file": pieces["file"], "block": blocks, "id": ids, "k": np.arange(len(ids)), "owner": owner})


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_no, record) of the WARC files that `write_warc` has written, or of a replica of them.

    Files are read in pieces, from one line that opens a record to the next. Where a body quotes such a
    line, the record's announced length tells which pieces are one record: only numbers are looked at
    file by file, and only such records are put together. A record whose number cannot be read any more
    has the number UNREADABLE, by which it has an archive of its own. No files with records give an
    empty table."""
    opening = "WARC/1.0\r\n"
    between = "\r\n\r\n" + opening
    lines = spark.read.option("lineSep", between).text(path)
    value = F.regexp_replace("value", r"^WARC/1\.0\r\n", "").alias("value")
    pieces = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), value)
    head = F.substring_index("value", "\r\n\r\n", 1)
    announced = F.coalesce(F.regexp_extract(head, r"Content-Length: (\d+)", 1).try_cast("long"), F.lit(-1).cast("long"))
    sizes = pieces.select("file", "block", "id", F.octet_length("value").cast("long").alias("size"), F.octet_length(head).cast("long").alias("head"), announced.alias("announced"))
    # numbers only; a replica's files are as many tasks as there are files
    owners = settle(sizes.groupBy("file").applyInPandas(_owners, "file string, block long, id long, k long, owner long"))
    split = owners.where("owner <> k").select("file", "owner").distinct()
    whole = pieces.select("value")
    if not split.isEmpty():
        parts = pieces.join(owners.join(split, ["file", "owner"]), ["file", "block", "id"])
        joined = parts.groupBy("file", "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda p: p["value"]), between).alias("value"))
        own = owners.join(split, ["file", "owner"], "left_semi").select("file", "block", "id")
        whole = pieces.join(own, ["file", "block", "id"], "left_anti").select("value").unionByName(joined.select("value"))
    whole = whole.where("value <> ''")
    found = F.octet_length("value") - F.octet_length(head) - 4
    closed = (found == announced + 4) & F.col("value").endswith("\r\n\r\n")
    record = F.when(closed, F.left("value", F.length("value") - 4)).otherwise(F.col("value"))
    number = F.coalesce(F.regexp_extract(head, r"WARC-Record-ID: <urn:page:(-?\d+)>", 1).try_cast("long"), F.lit(UNREADABLE).cast("long"))
    return whole.select(number.alias("record_no"), F.concat(F.lit(opening), record).alias("record"))


def leaves(records: DataFrame) -> DataFrame:
    """One row per record: archive, node (its place there), record_no, copy (from 1 among equal
    numbers), lo and hi (its bytes in the archive, the closing line ends included), record_sha256
    and the leaf's digest over range and record. Only sizes and hashes are ordered and shuffled."""
    sized = records.select(
        F.expr(f"record_no div {ARCHIVE_RECORDS}").alias("archive"),
        "record_no",
        F.sha2("record", 256).alias("record_sha256"),
        (F.octet_length("record") + 4).cast("long").alias("__bytes"),
    )
    order = Window.partitionBy("archive").orderBy("record_no", "record_sha256")
    same = Window.partitionBy("archive", "record_no").orderBy("record_sha256")
    hi = F.sum("__bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = sized.select(
        "archive",
        (F.row_number().over(order) - 1).cast("long").alias("node"),
        "record_no",
        F.row_number().over(same).alias("copy"),
        (hi - F.col("__bytes")).alias("lo"),
        hi.alias("hi"),
        "record_sha256",
    )
    return placed.withColumn("digest", _range_digest(F.col("lo"), F.col("hi"), F.col("record_sha256")))


def _range_digest(lo: Column, hi: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws(":", lo.cast("string"), hi.cast("string"), content), 256)


def _above(nodes: DataFrame, level: int) -> DataFrame:
    """The nodes of `level`, over their children in order. FANOUT children at most meet in a group;
    an archive with more records than its numbers allow has as many more nodes under its root."""
    child = F.struct("archive", "node", "digest")
    grouped = nodes.groupBy("parent_archive", "parent_node").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(child)).alias("__c")
    )
    digest = _range_digest(F.col("lo"), F.col("hi"), F.array_join("__c.digest", "\n"))
    out = grouped.select(F.lit(level).alias("level"), F.col("parent_archive").alias("archive"), F.col("parent_node").alias("node"), "lo", "hi", digest.alias("digest"))
    return _with_parent(out, level)


def _with_parent(nodes: DataFrame, level: int) -> DataFrame:
    inside = level < ARCHIVE_ROOT
    archive = F.col("archive") if inside else F.expr(f"archive div {FANOUT}")
    node = F.expr(f"node div {FANOUT}") if level < LEVELS else F.lit(0).cast("long")
    return nodes.select(F.lit(level).alias("level"), "archive", "node", archive.alias("parent_archive"), node.alias("parent_node"), "lo", "hi", "digest")


def top_level(leaf: DataFrame) -> int:
    """The level with the single root of a tree over these archives. Numbers are divided towards zero,
    so negative ones meet there as well."""
    most, level = leaf.agg(F.max(F.abs("archive"))).first()[0] or 0, ARCHIVE_ROOT
    while most:
        most, level = most // FANOUT, level + 1
    return level


def _parts(df: DataFrame, level: int) -> int:
    """Partitions for the work on a level's nodes: it has a FANOUT-th of the nodes below it."""
    return max(1, partitions(df.sparkSession) // FANOUT**level)


def tree(leaf: DataFrame, top: int) -> list[DataFrame]:
    """The levels of the Merkle tree over settled leaves, records first, the root last. Above the
    archives, lo and hi span the archives' own ranges."""
    levels = [_with_parent(leaf, 0)]
    for level in range(1, top + 1):
        levels.append(settle(_above(levels[-1], level).coalesce(_parts(leaf, level - 1))))
    return levels


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Where two replicas, each (record_no, record), differ: archive, record_no, copy, status, and
    lo, hi, record_sha256 of either (other_ in the second). status is `corrupt` (the bytes differ),
    `missing` (only in the first), `added` (only in the second) or `moved` (same bytes elsewhere).

    Equal replicas end at the root. Otherwise each level joins the children of differing nodes only.
    Repeated rows are told apart as copies, those of one number by their hashes; null columns of pages
    are empty in their records; numbers decide the archive, so a hot host or page does
    not matter. Two empty replicas are equal.
    """
    return _compared(settle(leaves(first)), settle(leaves(second)))


def _compared(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """`audit` over the settled leaves of two replicas."""
    top = max(top_level(mine), top_level(theirs))
    a, b = tree(mine, top), tree(theirs, top)
    key = ["archive", "node"]
    differs = None
    for level in range(top, -1, -1):
        x, y = a[level], b[level]
        if differs is not None:
            up = differs.select(F.col("archive").alias("parent_archive"), F.col("node").alias("parent_node"))
            x, y = (z.join(up, ["parent_archive", "parent_node"], "left_semi") for z in (x, y))
        pair = x.select(*key, F.col("digest").alias("__x")).join(y.select(*key, F.col("digest").alias("__y")), key, "full")
        differs = settle(pair.where(~F.col("__x").eqNullSafe(F.col("__y"))).select(*key).coalesce(_parts(mine, max(0, level - 1))))
    mine, theirs = (z.join(differs, key, "left_semi") for z in (mine, theirs))
    other = theirs.select("archive", "record_no", "copy", *(F.col(c).alias(f"other_{c}") for c in ("lo", "hi", "record_sha256")))
    both = mine.select("archive", "record_no", "copy", "lo", "hi", "record_sha256").join(other, ["archive", "record_no", "copy"], "full")
    status = (
        F.when(F.col("other_record_sha256").isNull(), "missing")
        .when(F.col("record_sha256").isNull(), "added")
        .when(F.col("record_sha256") != F.col("other_record_sha256"), "corrupt")
        .otherwise("moved")
    )
    return both.withColumn("status", status)


def report(first: DataFrame, second: DataFrame) -> DataFrame:
    """Every record of the first replica with its verdict: status is `intact` where the audit found
    no difference. Records that only the second has come along as `added`. Repeated rows are copies
    of a number and have a verdict each; two empty replicas give an empty report."""
    mine = settle(leaves(first))
    found = _compared(mine, settle(leaves(second)))
    own = mine.select("archive", "record_no", "copy", "lo", "hi", "record_sha256")
    told = found.select("archive", "record_no", "copy", "status")
    known = own.join(told, ["archive", "record_no", "copy"], "left").withColumn("status", F.coalesce("status", F.lit("intact")))
    added = found.where("status = 'added'").select(
        "archive", "record_no", "copy", F.col("other_lo").alias("lo"), F.col("other_hi").alias("hi"), F.col("other_record_sha256").alias("record_sha256"), "status"
    )
    return reduce(DataFrame.unionByName, [known, added])


def damaged(records: DataFrame) -> DataFrame:
    """A replica with known faults, for drills: a record whose SHA-256 begins with 00 has its first
    byte changed, one that begins with 01 is lost."""
    digest = F.substring(F.sha2("record", 256), 1, 2)
    body = F.when(digest == "00", F.concat(F.lit("#"), F.substring("record", 2, 1 << 30))).otherwise(F.col("record"))
    return records.where(digest != "01").select("record_no", body.alias("record"))
