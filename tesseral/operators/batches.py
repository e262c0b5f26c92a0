"""Keyed request batches and their results, as tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import inlined
from ..functions.text import base64_line, padded
from ..plans.working import settle
from ..sources import snapshots
from .annotation import parsed
from .cache import envelope, upsert
from .ordering import numbered

# States in which a job does not go on.
TERMINAL_STATES = ("JOB_STATE_SUCCEEDED", "JOB_STATE_FAILED", "JOB_STATE_CANCELLED", "JOB_STATE_EXPIRED")
CHUNK_SIZE = 100


def chunked(rows: DataFrame, order: list[str], size: int = CHUNK_SIZE) -> DataFrame:
    """Adds ordinal, chunk and the chunk's file name."""
    if size < 1:
        raise ValueError("the chunk size must be positive")
    out = numbered(rows, order).withColumn("chunk", F.expr(f"cast(ordinal div {size} as int)"))
    return out.withColumn("input_file", F.concat(F.lit("input-"), padded(F.col("chunk"), 3), F.lit(".jsonl")))


def uncached(requests: DataFrame, cache: DataFrame, key: str, *, retry_invalid: bool = True) -> DataFrame:
    """Requests that still need an answer: those without a cache entry, and with `retry_invalid`
    those whose entry has errors."""
    done = cache.where(F.size("validation_errors") == 0) if retry_invalid else cache
    return requests.join(done.select(key).distinct(), key, "left_anti")


def payload(
    image: Column, category: Column, template: str, *, mime: str = "image/jpeg", max_tokens: int = 1024, schema: dict[str, Any] | None = None
) -> Column:
    """The request as JSON: the user's image and instruction, and a generation setup for JSON answers
    of the schema, without thinking."""
    text = F.replace(F.lit(template), F.lit("{category}"), category)
    data = F.struct(F.lit(mime).alias("mimeType"), base64_line(image).alias("data"))
    parts = F.array(F.to_json(F.struct(data.alias("inlineData"))), F.to_json(F.struct(text.alias("text"))))
    setup = {"maxOutputTokens": max_tokens, "temperature": 0.0, "responseMimeType": "application/json", "thinkingConfig": {"thinkingBudget": 0}}
    if schema is not None:
        setup["responseSchema"] = inlined(schema)
    return F.concat(F.lit('{"contents":[{"role":"user","parts":['), F.array_join(parts, ","), F.lit(']}],"generationConfig":' + json.dumps(setup) + "}"))


def response_text(response: Column) -> Column:
    """The texts of the first candidate's parts, one after another; null where there are none."""
    parts = F.from_json(F.get_json_object(response, "$.candidates[0].content.parts"), "array<struct<text:string>>")
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")


def matched_results(requests: DataFrame, results: DataFrame, key: str = "key") -> DataFrame:
    """Every request and every result once: status is `answered`, `error` (the result says so),
    `unknown` (a result without request) or `unanswered` (a request without result). Several requests
    with one key all get its result; of several results the last by ordinal counts."""
    last = results.groupBy(key).agg(F.max_by(F.struct("response", "error"), "ordinal").alias("__r"))
    both = requests.withColumn("__known", F.lit(True)).join(last, key, "full")
    status = (
        F.when(F.col("__known").isNull(), "unknown").when(F.col("__r").isNull(), "unanswered").when(F.col("__r.error").isNotNull(), "error").otherwise("answered")
    )
    return both.select("*", F.col("__r.response").alias("response"), F.col("__r.error").alias("error"), status.alias("status")).drop("__r", "__known")


def prepared(instances: DataFrame, cache: DataFrame, order: list[str], size: int = CHUNK_SIZE) -> tuple[DataFrame, DataFrame]:
    """(index, state). The index has every instance; those without a valid cache entry have a chunk and
    its file, and one of equal keys stands for all. The state has a row per chunk: no job yet."""
    todo = uncached(instances, cache, "cache_key").dropDuplicates(["key"])
    numbers = chunked(todo, order, size).select("key", "ordinal", "chunk", "input_file")
    index = instances.join(numbers, "key", "left")
    none = F.lit(None).cast("string")
    state = numbers.select("chunk", "input_file").distinct()
    return index, state.select("*", none.alias("job_name"), none.alias("state"), none.alias("result_file"), none.alias("error"))


def store_prepared(index: DataFrame, state: DataFrame, path: str) -> None:
    """Stores what `prepared` gives, once: requests as a table, the state as a snapshot table by chunk."""
    index.write.parquet(f"{path}/requests")
    store_state(state, path)


def store_state(state: DataFrame, path: str) -> int:
    """Puts the chunks of a state into the stored one, all at once for readers; gives the version."""
    return snapshots.upsert(state, f"{path}/state", key="chunk")


def stored(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(index, state) as they are stored."""
    return spark.read.parquet(f"{path}/requests"), snapshots.read(spark, f"{path}/state")


def unsubmitted(state: DataFrame) -> DataFrame:
    return state.where("job_name is null")


def submitted(state: DataFrame, jobs: DataFrame) -> DataFrame:
    """The state with the jobs (chunk, job_name) of a submission; a chunk keeps a job that it has, so a
    submission that was broken off goes on where it stopped."""
    new = jobs.select("chunk", F.col("job_name").alias("__job"))
    return state.join(new, "chunk", "left").withColumn("job_name", F.coalesce("job_name", "__job")).drop("__job")


def polled(state: DataFrame, seen: DataFrame) -> DataFrame:
    """The state with what a poll has told of jobs (job_name, state, result_file, error). Result files
    count for jobs that have succeeded, errors for those that have ended otherwise; known files stay."""
    told = seen.select("job_name", F.col("state").alias("__state"), F.col("result_file").alias("__file"), F.col("error").alias("__error"))
    good = F.col("__state") == TERMINAL_STATES[0]
    bad = F.col("__state").isin(*TERMINAL_STATES[1:])
    updates = {
        "state": F.coalesce("__state", "state"),
        "result_file": F.coalesce("result_file", F.when(good, F.col("__file"))),
        "error": F.coalesce(F.when(bad, F.coalesce("__error", F.lit("no reason given"))), "error"),
    }
    return state.join(told, "job_name", "left").withColumns(updates).drop("__state", "__file", "__error")


def collected(index: DataFrame, results: DataFrame, *, model: str) -> DataFrame:
    """Cache entries, by key, of the requests that have results, with status and error beside them:
    `answered`, or what went wrong (`error`, `unknown`, `no content`). A response that breaks the
    contract is kept with its errors, as any answer is paid for."""
    asked = index.where("input_file is not null") if "input_file" in index.columns else index
    known = matched_results(asked, results).where("status <> 'unanswered'")
    text = known.withColumn("raw_response_text", F.when(F.col("status") == "answered", response_text(F.col("response"))))
    empty = (F.col("status") == "answered") & F.col("raw_response_text").isNull()
    read = parsed(text.withColumn("status", F.when(empty, "no content").otherwise(F.col("status"))))
    return envelope(read.drop("response").withColumn("model_id", F.lit(model)))


def take_in(index: DataFrame, results: DataFrame, cache_path: str, *, model: str, put: Callable[[DataFrame], DataFrame] = settle) -> DataFrame:
    """Puts the answers among the results into the cache, by cache_key, and gives what is wrong as (key,
    status, error): requests that failed, unknown keys, answers without content, and answers that break
    the contract (`invalid`; they are in the cache with their errors). Only answers with a text replace
    an entry, so a result that is an error leaves a valid one alone. Of requests with one cache key the
    one with the least source hashes gives the entry. `put` writes down what is read twice."""
    got = put(collected(index, results, model=model))
    beside = {"status", "error", "ordinal", "chunk", "input_file", "key", "cache_key"}
    fields = [c for c in got.columns if c not in beside and c in _ENTRY]
    answers = got.where(F.col("status") == "answered")
    one = answers.groupBy("cache_key").agg(F.min_by(F.struct(*fields), "source_image_sha256").alias("r")).select("cache_key", "r.*")
    upsert(one, cache_path)
    broken = F.col("validation_outcome") != "valid"
    told = got.where((F.col("status") != "answered") | broken)
    status = F.when(F.col("status") == "answered", "invalid").otherwise(F.col("status"))
    why = F.when(F.col("status") == "error", F.col("error")).when(F.col("status") == "answered", F.array_join("validation_errors", "; "))
    return told.select("key", status.alias("status"), why.alias("error")).distinct()


#: The fields of a cache entry.
_ENTRY = {
    "cache_schema_version", "model_id", "prompt_version", "latency_ms", "input_image_sha256", "source_image_sha256", "category", "raw_response_text",
    "parsed_annotation", "validation_outcome", "validation_errors",
}


def collect_code(entries: DataFrame) -> DataFrame:
    """One row: 1 if a result has failed, belongs to no request or breaks the contract, else 0."""
    bad = (F.col("status") != "answered") | (F.col("validation_outcome") != "valid")
    return entries.agg(F.coalesce(F.max(bad.cast("int")), F.lit(0)).alias("exit_code"))


def build_code(rows: DataFrame, outcome: str = "outcome") -> DataFrame:
    """One row: 1 if an instance has failed; skipped and ambiguous ones are no failure."""
    return rows.agg(F.coalesce(F.max((F.col(outcome) == "failed").cast("int")), F.lit(0)).alias("exit_code"))


def exit_code(jobs: DataFrame) -> DataFrame:
    """One row: 1 if a job ended badly, else 2 while one still runs, else 0."""
    ended = F.col("state").isin(*TERMINAL_STATES)
    bad = F.coalesce(F.max((ended & (F.col("state") != TERMINAL_STATES[0])).cast("int")), F.lit(0))
    pending = F.coalesce(F.max((~ended).cast("int")), F.lit(0))
    return jobs.agg(F.when(bad == 1, 1).when(pending == 1, 2).otherwise(0).alias("exit_code"))
