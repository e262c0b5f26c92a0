"""Batch results as a stream of landed files: each file once, the last result of a key counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batches
from ..operators.annotation import parsed
from ..operators.batches import response_text
from ..operators.cache import upsert
from ..plans.working import working

RESULT = "key string, response string, error string"


def landed(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the result lines of files that land under `path`, with the place of each. Nothing is
    remembered from file to file: later results replace earlier ones in the cache."""
    lines = spark.readStream.format("text").load(path)
    rows = lines.select("value", F.struct("_metadata.file_name", "_metadata.file_block_start").alias("place")).where("trim(value) <> ''")
    return rows.select(F.from_json("value", RESULT).alias("r"), "place").select("r.*", "place").where("key is not null")


def collect(spark: SparkSession, path: str, cache_path: str, checkpoint: str) -> None:
    """Takes in all files that have landed since the last call and puts their validated annotations
    into the cache table by result key, the last of a key by file and place, for callers that have no
    request index. Results without a text, errors among them, replace nothing. Offsets are in the
    checkpoint, so a lost driver or executor repeats at most the batch that was running, to the same
    table."""

    def merge(batch: DataFrame, number: int) -> None:
        told = batch.withColumn("raw_response_text", F.when(F.col("error").isNull(), response_text(F.col("response")))).where("raw_response_text is not null")
        last = _ordered(told).groupBy("key").agg(F.max_by(F.struct("response", "error", "raw_response_text"), "ordinal").alias("r")).select("key", "r.*")
        upsert(parsed(last), cache_path, "key")

    _run(landed(spark, path), merge, checkpoint)


def take_in(spark: SparkSession, path: str, index_path: str, cache_path: str, checkpoint: str, errors_path: str, *, model: str) -> None:
    """Takes in all result files that have landed since the last call, by the request index (a table as
    `batches.prepared` gives it): answers go into the cache that `annotators.memoised` and
    `batches.uncached` read, the rest to JSON lines under `errors_path`, by batch (see
    `batches.take_in`). A repeated batch writes the same entries and errors again."""

    def merge(batch: DataFrame, number: int) -> None:
        with working(spark) as put:  # a stream may run for long: its working tables go with each batch
            wrong = batches.take_in(spark.read.parquet(index_path), _ordered(batch), cache_path, model=model, put=put)
            wrong.write.mode("overwrite").json(f"{errors_path.rstrip('/')}/batch={number}")

    _run(landed(spark, path), merge, checkpoint)


def _ordered(batch: DataFrame) -> DataFrame:
    return batch.withColumn("ordinal", F.struct("place", F.monotonically_increasing_id().alias("n"))).drop("place")


def _run(rows: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
