"""Calls that are paid for once: a write-ahead journal of responses, kept by the tasks that call.

A task appends each response to a file of its own, under the shard of its cache key, before it hands it
on. A task that runs again, in the same job or in another one, first reads what its shards' files have
and calls only for the rest. Shards depend on keys alone, so it does not matter which task they go to.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.working import remove

RESPONSES = "cache_key string, raw_response_text string, latency_ms double, error string, called boolean"


@dataclass(frozen=True)
class Calls:
    """How a task calls: so many at a time, each so often, with a pause that doubles from one attempt to
    the next. An exception in `final` is not tried again. `shards` deals the keys to tasks, and must
    stay the same for a journal; a task holds the responses of one shard, so there should be enough of them."""

    concurrency: int = 8
    attempts: int = 3
    pause_s: float = 1.0
    final: tuple[type[BaseException], ...] = ()
    shards: int = 256


class _Shard:
    """The journal of one shard: what all earlier attempts have, and this one's own file."""

    def __init__(self, root: str, shard: int):
        from pyarrow import fs

        self.files, place = fs.FileSystem.from_uri(root)
        self.folder = f"{place.rstrip('/')}/shard={shard}"
        self.known: dict[str, tuple[str, float]] = {}
        self.lock, self.out = threading.Lock(), None
        for info in self.files.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            with self.files.open_input_stream(info.path) as f:
                for line in f.read().split(b"\n")[:-1]:  # a last line without its end was never paid in full
                    entry = json.loads(line)
                    self.known.setdefault(entry["cache_key"], (entry["raw_response_text"], entry["latency_ms"]))

    def add(self, key: str, text: str, latency: float) -> None:
        line = json.dumps({"cache_key": key, "raw_response_text": text, "latency_ms": latency}) + "\n"
        with self.lock:
            if self.out is None:
                self.files.create_dir(self.folder, recursive=True)
                self.out = self.files.open_output_stream(f"{self.folder}/{uuid.uuid4().hex}.jsonl")
            self.out.write(line.encode())
            self.out.flush()
            self.known[key] = (text, latency)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def _called(call: Callable[[str, str], str], how: Calls, shard: _Shard, key: str, composite: str, category: str) -> tuple:
    """One response, journalled by the thread that has got it."""
    for attempt in range(how.attempts):
        began = time.perf_counter()
        try:
            text = call(composite, category)
        except Exception as e:  # noqa: BLE001  the row carries it
            error = f"{type(e).__name__}: {e}"
            if isinstance(e, how.final) or attempt + 1 == how.attempts:
                return key, None, (time.perf_counter() - began) * 1000, error, True
            time.sleep(how.pause_s * 2**attempt)
        else:
            latency = (time.perf_counter() - began) * 1000
            shard.add(key, text, latency)
            return key, text, latency, None, True
    raise AssertionError("no attempt")


def _runner(factory: Callable[[], Callable[[str, str], str]], journal: str, how: Calls) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, shards, open_ = None, {}, set()
        frame = lambda rows: pd.DataFrame(rows, columns=["cache_key", "raw_response_text", "latency_ms", "error", "called"])
        try:
            with ThreadPoolExecutor(how.concurrency) as pool:
                try:
                    for batch in batches:
                        out = []
                        for key, composite, category, number in zip(batch.cache_key, batch.composite_sha256, batch.category, batch.shard):
                            if number not in shards:  # rows come by shard: one journal at a time is held
                                done, open_ = wait(open_)
                                out += [f.result() for f in done]
                                for s in shards.values():
                                    s.close()
                                shards = {number: _Shard(journal, number)}
                            shard = shards[number]
                            if key in shard.known:
                                out.append((key, *shard.known[key], None, False))
                                continue
                            call = call or factory()
                            open_.add(pool.submit(_called, call, how, shard, key, composite, category))
                            if len(open_) >= how.concurrency:
                                done, open_ = wait(open_, return_when=FIRST_COMPLETED)
                                out += [f.result() for f in done]
                        yield frame(out)
                    done, open_ = wait(open_)
                    yield frame([f.result() for f in done])
                except BaseException:
                    f: Future
                    for f in open_:
                        f.cancel()
                    raise
        finally:
            for s in shards.values():
                s.close()

    return run


def durable(requests: DataFrame, factory: Callable[[], Callable[[str, str], str]], journal: str, how: Calls | None = None) -> DataFrame:
    """(cache_key, raw_response_text, latency_ms, error, called) of each request (cache_key, one row
    each; composite_sha256, category). `factory` makes an annotator, once per task and only where there
    is something to call; `called` is false for responses that were in the journal, a folder that all
    executors share (a URI that Arrow's file systems know). Failures are not journalled, so another run
    tries them again.

    A task that is killed may have paid for as many calls as it makes at a time and not have them; two
    attempts at one task that run side by side (speculation) may both call.
    """
    how = how or Calls()
    if how.concurrency < 1 or how.attempts < 1 or how.shards < 1:
        raise ValueError("concurrency, attempts and shards must be positive")
    sharded = requests.select("cache_key", "composite_sha256", "category", F.pmod(F.xxhash64("cache_key"), F.lit(how.shards)).cast("int").alias("shard"))
    dealt = sharded.repartition(how.shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInPandas(_runner(factory, journal, how), RESPONSES)


def responses(spark: SparkSession, journal: str) -> DataFrame:
    """(cache_key, raw_response_text, latency_ms) of all that the journal has, once per key."""
    lines = spark.read.schema("value string").text(journal, recursiveFileLookup=True)
    entry = F.from_json("value", "cache_key string, raw_response_text string, latency_ms double").alias("r")
    whole = lines.select(entry).where("r.cache_key is not null and r.raw_response_text is not null")
    return whole.groupBy("r.cache_key").agg(F.min(F.struct("r.latency_ms", "r.raw_response_text")).alias("r")).select("cache_key", "r.raw_response_text", "r.latency_ms")


def clear(spark: SparkSession, journal: str) -> None:
    """Deletes the journal, once its responses are in the cache."""
    remove(spark, journal)
