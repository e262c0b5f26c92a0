"""Where annotations come from: an annotator is called for cache misses only."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.working import settle


class Annotator(Protocol):
    """Turns a composite and its category into response text. Made once per task by its factory."""

    def __call__(self, composite: str, category: str) -> str: ...


def annotate(requests: DataFrame, factory: Callable[[], Annotator]) -> DataFrame:
    """(cache_key, raw_response_text, latency_ms, error) of each request; a call that fails gives an
    error, never an exception of the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = factory()
        for rows in batches:
            out = []
            for key, composite, category in zip(rows.cache_key, rows.composite_sha256, rows.category):
                began, text, error = time.perf_counter(), None, None
                try:
                    text = call(composite, category)
                except Exception as e:  # noqa: BLE001  the row carries it
                    error = f"{type(e).__name__}: {e}"
                out.append((key, text, (time.perf_counter() - began) * 1000, error))
            yield pd.DataFrame(out, columns=["cache_key", "raw_response_text", "latency_ms", "error"])

    return requests.select("cache_key", "composite_sha256", "category").mapInPandas(run, "cache_key string, raw_response_text string, latency_ms double, error string")


def recorded(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """The default annotator: a table of recorded responses by cache_key."""
    known = responses.select("cache_key", "raw_response_text")
    return requests.join(known, "cache_key", "left").withColumn("error", F.when(F.col("raw_response_text").isNull(), "no recorded response"))


def memoised(instances: DataFrame, cache: DataFrame, annotator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cached responses, and the annotator's for the rest; a cached response is reused even if it
    is invalid. `cached` tells which. Fresh responses are written down with their keys before
    anything reads them: each is asked for once, whatever is done with the result."""
    hits = instances.join(cache.select("cache_key", "raw_response_text"), "cache_key").withColumn("cached", F.lit(True))
    misses = instances.join(cache.select("cache_key"), "cache_key", "left_anti")
    fresh = annotator(misses.dropDuplicates(["cache_key"])).select("cache_key", "raw_response_text")
    fresh = settle(fresh)
    return hits.unionByName(misses.join(fresh, "cache_key", "left").withColumn("cached", F.lit(False)))
