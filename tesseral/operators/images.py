"""Four images into one grid. Decoded rasters are arrays of height x width x 3 bytes; the work runs
in Arrow batches inside Spark's tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def to_rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Rows of Spark's image source (BGR, BGRA or gray bytes) as RGB."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, 2::-1] if channels == 3 else a[:, :, [2, 1, 0]]


def _weights(old: int, new: int) -> np.ndarray:
    """Row-normalised Lanczos-3 weights from `old` to `new` samples."""
    scale = old / new
    centre = (np.arange(new) + 0.5) * scale - 0.5
    x = (np.arange(old)[None, :] - centre[:, None]) / max(scale, 1.0)
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def fitted(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Shrunk to fit, never enlarged, centred on black."""
    h, w = image.shape[:2]
    ratio = min(height / h, width / w, 1.0)
    nh, nw = max(1, round(h * ratio)), max(1, round(w * ratio))
    small = image.astype(np.float64)
    if (nh, nw) != (h, w):
        small = np.einsum("ij,jkc->ikc", _weights(h, nh), small)
        small = np.einsum("ij,kjc->kic", _weights(w, nw), small)
    out = np.zeros((height, width, 3), np.uint8)
    top, left = (height - nh) // 2, (width - nw) // 2
    out[top : top + nh, left : left + nw] = np.clip(np.rint(small), 0, 255).astype(np.uint8)
    return out


def grid(images: list[np.ndarray], height: int = 512, width: int = 512) -> np.ndarray:
    """Two by two, row by row."""
    if len(images) != 4:
        raise ValueError("a grid takes four images")
    a, b, c, d = (fitted(i, height, width) for i in images)
    return np.vstack([np.hstack([a, b]), np.hstack([c, d])])


def pixel_sha256(image: np.ndarray) -> str:
    """Identity of a raster: same pixels, same hash, whatever the encoder."""
    h, w = image.shape[:2]
    return hashlib.sha256(f"RGB\n{w}x{h}\n".encode() + image.tobytes()).hexdigest()


def composites(groups: DataFrame, *, height: int = 512, width: int = 512) -> DataFrame:
    """(instance, width, height, data, composite_sha256) from (instance, images: array of four
    structs of height, width, nChannels and data, in order)."""
    if height < 1 or width < 1:
        raise ValueError("the tile size must be positive")
    out = "instance string, width int, height int, data binary, composite_sha256 string"

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made = grid([to_rgb(i["data"], i["height"], i["width"], i["nChannels"]) for i in row["images"]], height, width)
                yield pa.RecordBatch.from_pylist(
                    [{"instance": row["instance"], "width": 2 * width, "height": 2 * height, "data": made.tobytes(), "composite_sha256": pixel_sha256(made)}],
                    schema=pa.schema([("instance", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary()), ("composite_sha256", pa.string())]),
                )

    return groups.select("instance", "images").mapInArrow(compose, out)


def decoded(spark: SparkSession, paths: DataFrame, root: str) -> DataFrame:
    """Adds image (height, width, nChannels, data) to picked paths, by Spark's image source: 8-bit gray,
    BGR or BGRA bytes. Files that are no images have null."""
    files = spark.read.format("image").option("recursiveFileLookup", True).load(root).select(F.col("image.origin").alias("__origin"), F.struct("image.height", "image.width", "image.nChannels", "image.data").alias("image"))
    # the source names local files with three slashes, other readers with one
    same = F.regexp_replace("path", "^file:/+", "/") == F.regexp_replace("__origin", "^file:/+", "/")
    joined = paths.join(files, same, "left").drop("__origin")
    return joined.withColumn("image", F.when(F.col("image.height") > 0, F.col("image")))


def composed(spark: SparkSession, picks: DataFrame, root: str, *, height: int = 512, width: int = 512) -> tuple[DataFrame, DataFrame]:
    """(composites, errors) of picks (instance, pos, path): the composite of each instance whose four
    images can be read, and (instance, error) of the others. Only picked files' pixels leave the scan."""
    four = decoded(spark, picks.select("instance", "pos", "path"), root)
    one = F.struct("pos", "path", "image")
    groups = four.groupBy("instance").agg(F.array_sort(F.collect_list(F.struct("pos", "path"))).alias("__all"), F.sort_array(F.collect_list(F.when(F.col("image").isNotNull(), one))).alias("__read"))
    broken = F.array_except(F.transform("__all", lambda p: p["path"]), F.transform("__read", lambda p: p["path"]))
    error = F.when(F.size(broken) > 0, F.concat(F.lit("cannot read "), F.array_join(broken, ", "))).when(F.size("__all") != 4, F.concat(F.lit("expected four images, received "), F.size("__all").cast("string")))
    told = groups.withColumn("error", error)
    good = told.where("error is null").select("instance", F.transform("__read", lambda p: p["image"]).alias("images"))
    return composites(good, height=height, width=width), told.where("error is not null").select("instance", "error")
