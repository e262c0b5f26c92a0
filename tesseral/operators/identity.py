"""Names and content-addressed identities of instances, cache entries and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sha_key, strip

# Two versions on purpose, both are part of a cache identity.
CAPTION_SCHEMA_VERSION = "structured-viewpoints-v4"
PROMPT_VERSION = "structured-viewpoints-v5"
DEFAULT_CATEGORY = "object"
IDENTITY_FIELDS = ("cache_schema_version", "model_id", "prompt_version", "input_image_sha256", "source_image_sha256", "category")


def path_keys(path: Column, root: str) -> dict[str, Column]:
    """image_dir, instance (its parent below the root) and obj_id (its grandparent) of an image path."""
    parts = F.split(path, "/")
    image_dir = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    base = root.rstrip("/") + "/"
    below = F.substring(path, F.instr(path, base) + len(base), F.length(path))
    inside = F.split(below, "/")
    return {
        "image_dir": image_dir,
        "instance": F.array_join(F.slice(inside, F.lit(1), F.size(inside) - 2), "/"),
        "obj_id": F.get(parts, F.size(parts) - 4),
        "instance_dir": F.get(parts, F.size(parts) - 3),
        "filename": F.element_at(parts, -1),
    }


def category_name(category: Column) -> Column:
    return F.replace(strip(F.coalesce(category, F.lit(DEFAULT_CATEGORY))), F.lit(" "), F.lit("-"))


def with_category(rows: DataFrame, categories: DataFrame, key: str) -> DataFrame:
    """Left join to the category table (obj_id, category), default for unknown ones. The table is not
    forced to be broadcast: Spark does that while it is small."""
    named = categories.select(F.col("obj_id").alias("__obj"), F.col("category").alias("__name"))
    joined = rows.drop("category").join(named, F.col(key) == F.col("__obj"), "left")
    return joined.withColumn("category", category_name(F.col("__name"))).drop("__obj", "__name")


def instance_stem(category: Column, obj_id: Column, instance_dir: Column) -> Column:
    return F.concat(category, F.lit("_"), obj_id, F.lit("_"), instance_dir)


def cache_key(model: Column, category: Column, composite: Column, *, schema: str = CAPTION_SCHEMA_VERSION, prompt: str = PROMPT_VERSION) -> Column:
    return sha_key(F.lit(schema), model, F.lit(prompt), category, composite, digits=16)


def cache_file(stem: Column, key: Column, *, schema: str = CAPTION_SCHEMA_VERSION) -> Column:
    return F.concat(stem, F.lit(f"_{schema}_"), key, F.lit(".json"))


def request_key(model: Column, category: Column, composite: Column, *, prompt: str = PROMPT_VERSION) -> Column:
    return sha_key(model, F.lit(prompt), category, composite, digits=24)


def composite_of(hashes: Column) -> Column:
    """Stand-in identity of a group of contents where no image is composed."""
    return F.sha2(F.array_join(hashes, "\n"), 256)


def duplicate_stems(rows: DataFrame, stem: str = "stem") -> DataFrame:
    return rows.groupBy(stem).agg(F.count("*").alias("n")).where("n > 1")


def identity_mismatch(found: dict[str, Column], expected: dict[str, Column]) -> Column:
    """The first identity field that differs, or null."""
    return F.coalesce(*(F.when(~found[f].eqNullSafe(expected[f]), F.lit(f)) for f in IDENTITY_FIELDS if f in expected))
