"""Group-level splits, leakage and pair checks. Checks are tables of errors; `require_empty` raises."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded_key, stem, suffix
from .ordering import numbered


def require_empty(errors: DataFrame, message: str) -> None:
    """Raises with up to five rows of `errors`."""
    if sample := errors.limit(5).collect():
        raise ValueError(f"{message}: {[r.asDict() for r in sample]}")


def holdout_size(n_groups: int, fraction: float) -> int:
    """Rounded half to even, at least one group on either side."""
    if not 0 < fraction < 1:
        raise ValueError("the holdout fraction must lie between 0 and 1")
    if n_groups < 2:
        raise ValueError("at least two groups are needed")
    return max(1, min(n_groups - 1, round(n_groups * fraction)))


def holdout_groups(rows: DataFrame, group: str, *, seed: int = 17, fraction: float = 0.1, exact: bool = False) -> DataFrame:
    """The groups that are held out. Portable mode numbers groups by a seeded hash over all tasks, for
    how many are held out grows with them; exact mode repeats Python's shuffle of the sorted ids on the driver, for small sets of groups."""
    groups = rows.select(group).distinct()
    k = holdout_size(groups.count(), fraction)
    if not exact:
        return numbered(groups.withColumn("__key", seeded_key(seed, F.col(group))), ["__key", group], "__rank").where(F.col("__rank") < k).select(group)
    ids = sorted(r[0] for r in groups.collect())
    random.Random(seed).shuffle(ids)
    return rows.sparkSession.createDataFrame([(i,) for i in ids[:k]], groups.schema)


def split(rows: DataFrame, group: str, **options) -> DataFrame:
    """Adds split (train or holdout); all rows of a group go to one side."""
    held = holdout_groups(rows, group, **options).select(F.col(group).alias("__g"), F.lit("holdout").alias("__s"))
    return rows.join(held, F.col(group).eqNullSafe(F.col("__g")), "left").withColumn("split", F.coalesce("__s", F.lit("train"))).drop("__g", "__s")


def expected_total(rows: DataFrame, expected: int | None) -> DataFrame:
    """(expected, found) if the number of rows is another one than expected; empty otherwise."""
    return rows.agg(F.lit(expected).cast("long").alias("expected"), F.count("*").alias("found")).where(F.col("expected") != F.col("found"))


def nested_leakage(rows: DataFrame, values: str, split_column: str = "split") -> DataFrame:
    """`leakage` of the members of an array column."""
    return leakage(rows.select(split_column, F.explode(values).alias("value")), "value", split_column)


def leakage(rows: DataFrame, value: str, split_column: str = "split") -> DataFrame:
    """Values that occur on more than one side. Duplicates within a side are allowed. Counted by
    flags, so the aggregation is combined before the shuffle."""
    side = lambda s: F.max((F.col(split_column) == s).cast("int"))
    return rows.groupBy(value).agg(side("train").alias("__t"), side("holdout").alias("__h"), F.count("*").alias("n")).where("__t = 1 and __h = 1").select(value, "n")


def one_sided(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of only one of two sets, and which."""
    a = left.select(F.col(key).alias("__a")).distinct()
    b = right.select(F.col(key).alias("__b")).distinct()
    both = a.join(b, F.col("__a") == F.col("__b"), "full").where(F.col("__a").isNull() | F.col("__b").isNull())
    return both.select(F.coalesce("__a", "__b").alias(key), F.when(F.col("__b").isNull(), "left").otherwise("right").alias("side"))


def pair_errors(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(stem, error) of pair records: wrong suffixes, different stems, repeated stems, missing files.
    `manifest` has output_image and output_caption, `files` has name."""
    named = manifest.withColumn("stem", stem(F.col("output_image")))
    bad_suffix = (suffix(F.col("output_image")) != ".png") | (suffix(F.col("output_caption")) != ".txt")
    own = named.select("stem", F.when(bad_suffix, "image and caption must be .png and .txt").when(F.col("stem") != stem(F.col("output_caption")), "image and caption stems differ").alias("error")).where("error is not null")
    repeated = named.groupBy("stem").agg(F.count("*").alias("n")).where("n > 1").select("stem", F.lit("stem is repeated").alias("error"))
    wanted = named.select("stem", F.explode(F.array("output_image", "output_caption")).alias("name"))
    gone = wanted.join(files.select("name"), "name", "left_anti").select("stem", F.concat(F.lit("missing file "), F.col("name")).alias("error"))
    return own.unionByName(repeated).unionByName(gone)


def copy_plan(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """What to do with each file name of two (name, sha256) tables: copy, skip, conflict or extra."""
    a = wanted.select("name", F.col("sha256").alias("__w"))
    b = present.select("name", F.col("sha256").alias("__p"))
    action = (
        F.when(F.col("__w").isNull(), "extra").when(F.col("__p").isNull(), "copy").when(F.col("__w") == F.col("__p"), "skip").otherwise("conflict")
    )
    return a.join(b, "name", "full").select("name", action.alias("action"))


def placing_plan(rows: DataFrame, folder: str, *, files: tuple[str, ...] = ("image", "caption")) -> DataFrame:
    """(source, target) of the files of a split (columns of URIs, and split): each goes below the folder
    of its side under its own name. For `placing.copy_files`."""
    each = rows.select("split", F.explode(F.array(*(F.col(f) for f in files))).alias("source"))
    name = F.element_at(F.split("source", "/"), -1)
    return each.select("source", F.concat(F.lit(folder.rstrip("/") + "/"), "split", F.lit("/"), name).alias("target"))


def placed_errors(rows: DataFrame, entries: DataFrame, *, files: tuple[str, ...] = ("image", "caption")) -> DataFrame:
    """(split, name, error) where the files of a side's folder are not those of the split: `missing`, or
    `not of the split`. `entries` (path, kind) is a listing of the folder, as `tree.tree` gives it."""
    parts = lambda c: F.split(c, "/")
    wanted = rows.select("split", F.explode(F.array(*(F.element_at(parts(F.col(f)), -1) for f in files))).alias("name")).distinct()
    found = entries.where("kind = 'file'").select(F.element_at(parts(F.col("path")), -2).alias("split"), F.element_at(parts(F.col("path")), -1).alias("name"))
    found = found.where(suffix(F.col("name")).isin(".png", ".txt")).distinct()
    gone = wanted.join(found, ["split", "name"], "left_anti").withColumn("error", F.lit("missing"))
    return gone.unionByName(found.join(wanted, ["split", "name"], "left_anti").withColumn("error", F.lit("not of the split")))


def split_manifest(rows: DataFrame, *, seed: int, fraction: float) -> DataFrame:
    """The manifest of a split, by (split, stem)."""
    return rows.select("*", F.lit(seed).alias("seed"), F.lit(float(fraction)).alias("holdout_fraction")).orderBy("split", "stem")


def first_five(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, first): the five smallest distinct values of each group, for messages. Equal values are
    combined first, so only a group's five smallest are held."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(value))
    few = rows.select(group, value).distinct().withColumn("__r", rank).where("__r <= 5")
    return few.groupBy(group).agg(F.array_sort(F.collect_list(value)).alias("first"))
