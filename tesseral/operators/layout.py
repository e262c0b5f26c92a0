"""Grid placement, running offsets of sheet rows, and sequential renaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import padded, stem, suffix
from .ordering import numbered, running


def grid(rows: DataFrame, index: str, *, columns: int = 3, tile: int = 384, label: str = "label_height") -> DataFrame:
    """Adds row, col, x and y of each tile: a sheet row is as high as its tile and its highest label.
    Row heights are aggregated first, so the running sum runs over rows of the sheet, not tiles."""
    if columns < 1 or tile < 1:
        raise ValueError("columns and tile size must be positive")
    placed = rows.withColumn("row", F.expr(f"cast({index} div {columns} as int)")).withColumn("col", F.expr(f"cast({index} % {columns} as int)"))
    heights = placed.groupBy("row").agg((F.max(label) + tile).cast("long").alias("row_height"))
    tops = running(heights, ["row"], "row_height", "y").withColumnRenamed("row", "__row")
    return placed.join(tops, F.col("row") == F.col("__row")).drop("__row").withColumn("x", (F.col("col") * tile).cast("long"))


def sheet_size(n: int, columns: int, tile: int, heights: list[int]) -> tuple[int, int]:
    rows = -(-n // columns)
    return columns * tile, sum(tile + max(heights[r * columns : (r + 1) * columns], default=0) for r in range(rows))


def rename_map(files: DataFrame, name: str = "name", *, start: int = 1) -> DataFrame:
    """(name, new_name, new_stem): image and caption of one stem get one number, in order of stems.
    Names that two files would get, or that stay with a file outside the map, are the caller's to check
    with `rename_collisions`, files without their other half with `unpaired`."""
    if start < 0:
        raise ValueError("numbers begin at 0 or later")
    images = F.col("__suffix").isin(".png", ".jpg", ".jpeg")
    named = files.select(name, stem(F.col(name)).alias("__stem"), suffix(F.col(name)).alias("__suffix")).where(images | (F.col("__suffix") == ".txt"))
    pairs = named.groupBy("__stem").agg(F.max(images.cast("int")).alias("i"), F.max((F.col("__suffix") == ".txt").cast("int")).alias("t")).where("i = 1 and t = 1")
    order = numbered(pairs.select("__stem"), ["__stem"], "__k")
    mapped = named.join(order, "__stem")
    new = padded((F.col("__k") + start).cast("long"), 4)
    return mapped.select(name, F.concat(new, F.col("__suffix")).alias("new_name"), new.alias("new_stem"))


def unpaired(files: DataFrame, name: str = "name") -> DataFrame:
    """(stem, error) of images without caption, captions without image, and stems with two images."""
    end = suffix(F.col(name))
    counted = files.groupBy(stem(F.col(name)).alias("stem")).agg(F.count_if(end.isin(".png", ".jpg", ".jpeg")).alias("i"), F.count_if(end == ".txt").alias("t"))
    error = F.when((F.col("i") > 0) & (F.col("t") == 0), "image without caption").when((F.col("i") == 0) & (F.col("t") > 0), "caption without image").when(F.col("i") > 1, "several images")
    return counted.select("stem", error.alias("error")).where("error is not null")


def rename_collisions(mapping: DataFrame, files: DataFrame, name: str = "name") -> DataFrame:
    """New names that are not unique, or that a file outside the mapping already has."""
    twice = mapping.groupBy("new_name").agg(F.count("*").alias("n")).where("n > 1").select("new_name")
    kept = files.select(F.col(name).alias("new_name")).join(mapping.select(F.col(name).alias("new_name")), "new_name", "left_anti")
    return twice.union(mapping.select("new_name").join(kept, "new_name", "left_semi")).distinct()


def contain(width: Column, height: Column, tile: int) -> Column:
    """Size and offset of an image fitted into a square tile and centred there."""
    scale = F.least(F.lit(float(tile)) / width, F.lit(float(tile)) / height)
    w, h = F.greatest(F.lit(1), F.rint(width * scale).cast("int")), F.greatest(F.lit(1), F.rint(height * scale).cast("int"))
    return F.struct(w.alias("width"), h.alias("height"), F.floor((F.lit(tile) - w) / 2).alias("x"), F.floor((F.lit(tile) - h) / 2).alias("y"))
