"""Line deduplication with overlapping three-line windows.

Windows of three consecutive lines are hashed, repeated windows are found over all documents, and
the lines that a later occurrence covers are removed; covered places that overlap are merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, content_keys, settle, shielded, text_or_empty

WINDOW = 3
#: White space that does not end a line.
IN_LINE = r"[\x20\x09\x0B-\x0D]+"


def _windows(docs: DataFrame) -> DataFrame:
    """(__id, __t1, __t2, __at, w1, w2): each window's first line, counted among the lines with a
    word, and the window's hash. Lines compare in lower case with white space collapsed."""
    t1, t2 = content_keys(text_or_empty())
    # white space within lines is collapsed over the whole text at once, before it is split
    norm = F.transform(F.split(F.regexp_replace(F.lower(text_or_empty()), IN_LINE, " "), "\n"), lambda line: F.trim(line))
    hashed = docs.select(F.col("doc_id").alias("__id"), t1.alias("__t1"), t2.alias("__t2"), F.filter(norm, lambda line: line != "").alias("__lines"))
    hashed = hashed.select("__id", "__t1", "__t2", F.transform("__lines", lambda line: F.struct(*(c.alias(f"h{i}") for i, c in enumerate(content_keys(line))))).alias("__h"))
    spots = F.when(F.size("__h") >= WINDOW, F.sequence(F.lit(0), F.size("__h") - WINDOW)).otherwise(F.array().cast("array<int>"))
    each = hashed.select("__id", "__t1", "__t2", "__h", spots.alias("__spots")).select(
        "__id",
        "__t1",
        "__t2",
        F.explode_outer(F.transform("__spots", lambda i: F.struct(i.alias("at"), *(F.get("__h", i + k).alias(f"l{k}") for k in range(WINDOW))))).alias("__w"),
    )
    each = each.where(F.col("__w").isNotNull())
    w1 = F.xxhash64(*(F.col(f"__w.l{k}.h0") for k in range(WINDOW)))
    w2 = F.xxhash64(*(F.col(f"__w.l{k}.h1") for k in range(WINDOW)))
    return each.select("__id", "__t1", "__t2", F.col("__w.at").alias("__at"), w1.alias("w1"), w2.alias("w2"))


def covered(docs: DataFrame) -> DataFrame:
    """(__id, __t1, __t2, __places): the starts of the windows of each document that occur earlier.
    Occurrences are in order of doc_id (nulls last), text hash and place. First occurrences are
    combined within tasks before the shuffle; the windows then join only those that repeat."""
    windows = settle(_windows(docs))
    place = F.struct(F.col("__id").isNull().alias("n"), "__id", "__t1", "__t2", "__at")
    repeated = (
        windows.groupBy("w1", "w2")
        .agg(F.min(place).alias("__first"), F.count("*").alias("__n"))
        .where(F.col("__n") > 1)
        .select("w1", "w2", "__first")
    )
    later = windows.join(repeated, ["w1", "w2"]).where(place != F.col("__first"))
    return later.groupBy("__id", "__t1", "__t2").agg(F.array_sort(F.collect_set("__at")).alias("__places"))


@shielded
def dedupe(docs: DataFrame) -> DataFrame:
    """`docs` with n_lines (lines with a word), n_removed, removed_spans (first-last, counted among
    those lines, joined by commas) and clean_text, without the lines that later occurrences of a
    repeated window cover. Lines without a word stay and part no window.

    Nulls: a null text has no lines; null ids come last. Repeated rows (same id and text) are one
    document and get equal results. Texts of fewer than three lines are kept whole. Empty table:
    empty result. Input columns named like an added one are replaced, others are carried along.
    """
    docs = docs.drop("n_lines", "n_removed", "removed_spans", "clean_text")
    own = docs.columns
    gone = covered(docs).select(F.col("__id").alias("__i"), F.col("__t1").alias("__m1"), F.col("__t2").alias("__m2"), "__places")
    t1, t2 = content_keys(text_or_empty())
    rows = docs.select("*", t1.alias("__t1"), t2.alias("__t2"))
    joined = rows.join(gone, (F.col("__t1") == F.col("__m1")) & (F.col("__t2") == F.col("__m2")) & F.col("doc_id").eqNullSafe(F.col("__i")), "left")
    places = F.coalesce("__places", F.array().cast("array<int>"))
    # a window starts a span if the one before it ends earlier; it ends one if the next starts later
    heads = F.filter("__p", lambda p, i: F.coalesce(p - F.get("__p", i - 1) > WINDOW, F.lit(True)))
    tails = F.filter("__p", lambda p, i: F.coalesce(F.get("__p", i + 1) - p > WINDOW, F.lit(True)))
    spans = F.zip_with(heads, tails, lambda a, b: F.struct(a.alias("first"), (b + WINDOW - 1).alias("last")))
    listed = F.array_join(F.transform("__spans", lambda s: F.concat_ws("-", s["first"].cast("string"), s["last"].cast("string"))), ",")
    lines = F.split(text_or_empty(), "\n")
    solid = F.split(F.translate(text_or_empty(), SPACE_CHARS.replace("\n", ""), ""), "\n")
    worded = F.filter(F.transform(solid, lambda line, i: F.when(line != "", i)), lambda i: i.isNotNull())
    gone = F.flatten(F.transform("__spans", lambda s: F.transform(F.sequence(s["first"], s["last"]), lambda n: F.get("__worded", n))))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    clean = F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n")
    out = (
        joined.withColumn("__p", places)
        .withColumn("__spans", spans)
        .withColumn("__lines", lines)
        .withColumn("__worded", worded)
        .withColumn("__gone", gone)
    )
    return out.select(
        *own,
        F.size("__worded").cast("long").alias("n_lines"),
        F.size("__gone").cast("long").alias("n_removed"),
        listed.alias("removed_spans"),
        F.when(F.size("__gone") == 0, F.col("text")).otherwise(clean).alias("clean_text"),
    )
