"""Cache entries of annotations: their form, their identity, and a table of the last entry per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.working import exists, working
from .identity import CAPTION_SCHEMA_VERSION, IDENTITY_FIELDS, PROMPT_VERSION, identity_mismatch

#: Parts of a cache table. An update reads and writes the parts that its keys fall into, no others.
BUCKETS = 64


def envelope(rows: DataFrame, *, schema: str = CAPTION_SCHEMA_VERSION, prompt: str = PROMPT_VERSION) -> DataFrame:
    """`rows` with the eleven fields of a cache entry in place of what they are made from: model_id,
    composite_sha256, source_image_sha256, category, raw_response_text, annotation and
    validation_errors; latency_ms is 0 where it is not known."""
    latency = F.coalesce(F.col("latency_ms").cast("double"), F.lit(0.0)) if "latency_ms" in rows.columns else F.lit(0.0)
    fields = {
        "cache_schema_version": F.lit(schema),
        "model_id": F.col("model_id"),
        "prompt_version": F.lit(prompt),
        "latency_ms": latency,
        "input_image_sha256": F.col("composite_sha256"),
        "source_image_sha256": F.col("source_image_sha256"),
        "category": F.col("category"),
        "raw_response_text": F.col("raw_response_text"),
        "parsed_annotation": F.col("annotation"),
        "validation_outcome": F.when(F.size("validation_errors") == 0, "valid").otherwise("invalid"),
        "validation_errors": F.col("validation_errors"),
    }
    made_from = {"composite_sha256", "annotation"}
    others = [c for c in rows.columns if c not in fields and c not in made_from]
    return rows.select(*others, *(c.alias(k) for k, c in fields.items()))


def mismatch(entry: dict[str, Column], expected: dict[str, Column]) -> Column:
    """The contract's message on the first identity field of an entry that is not as expected, or null."""
    field = identity_mismatch(entry, expected)
    return F.when(field.isNotNull(), F.concat(F.lit("Cache identity mismatch for "), field))


def checked(instances: DataFrame, cache: DataFrame, expected: dict[str, Column], key: str = "cache_key") -> DataFrame:
    """The instances that have an entry, with its fields under cached_ names and identity_error.
    `expected` gives the identity fields over the instances' columns."""
    entries = cache.select(F.col(key).alias("__key"), *(F.col(c).alias(f"cached_{c}") for c in cache.columns if c != key))
    joined = instances.join(entries, F.col(key) == F.col("__key")).drop("__key")
    told = mismatch({f: F.col(f"cached_{f}") for f in IDENTITY_FIELDS if f in expected}, expected)
    return joined.withColumn("identity_error", told)


def entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def upsert(fresh: DataFrame, path: str, key: str = "cache_key") -> None:
    """Takes entries into the table; one that is there already gives way. `fresh` has one row per key.
    Parts are overwritten as wholes, so repeating an update that was broken off gives the same table."""
    spark = fresh.sparkSession
    with working(spark) as put:
        placed = put(fresh.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")))
        touched = [r[0] for r in placed.select("bucket").distinct().collect()]
        if exists(spark, path) and touched:
            before = spark.read.parquet(path).where(F.col("bucket").isin(touched))
            placed = put(placed.unionByName(before.join(placed.select(key), key, "left_anti"), allowMissingColumns=True))
        placed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
