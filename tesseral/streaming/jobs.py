"""Batch jobs tracked as a stateful stream: what polls tell, when the next one is due, and how a job ends.

Each job is a key with a value: its state, the time of the poll that told it, its files and its deadline.
Timers ask for the next poll and end jobs that have not ended in time. What has been told before, and what
is told of a job that has ended, changes nothing, so sources may repeat themselves and a query goes on
from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.batches import TERMINAL_STATES
from ..sources import snapshots

#: A submission or a poll: `at` is when it was made, in milliseconds.
TOLD = "job_name string, chunk int, state string, result_file string, error string, at long"
#: `event` is `changed`, `ended` or `poll` (the next poll is due).
EVENTS = "job_name string, chunk int, event string, state string, result_file string, error string, at long"
STATE = "chunk int, state string, result_file string, error string, at long, deadline long, ended boolean"
POLL_MS, EXPIRE_MS = 30_000, 24 * 3_600_000
SUCCEEDED, EXPIRED = TERMINAL_STATES[0], TERMINAL_STATES[3]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Job(StatefulProcessor):
    def __init__(self, poll_ms: int, expire_ms: int):
        self.poll_ms, self.expire_ms = poll_ms, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.job = handle, handle.getValueState("job", STATE)

    def _told(self, key: Any, event: str, job: dict) -> tuple:
        return key[0], job["chunk"], event, job["state"], job["result_file"], job["error"], job["at"]

    def _put(self, job: dict) -> None:
        self.job.update(tuple(job[f.split()[0]] for f in STATE.split(", ")))

    def _get(self) -> dict | None:
        return dict(zip((f.split()[0] for f in STATE.split(", ")), self.job.get())) if self.job.exists() else None

    def _end(self, job: dict) -> None:
        job["ended"] = True
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, job, out = timerValues.getCurrentProcessingTimeInMs(), self._get(), []
        before = job is not None
        told = pd.concat(rows).sort_values(["at", "state"]).astype(object)
        told = told.where(told.notna(), None)
        for row in told.to_dict("records"):
            if job is None:
                job = {"chunk": None, "state": None, "result_file": None, "error": None, "at": -1, "deadline": now + self.expire_ms, "ended": False}
            if job["ended"] or row["state"] is None or row["at"] is None or row["at"] <= job["at"]:
                continue
            changed = row["state"] != job["state"]
            job |= {"state": row["state"], "at": int(row["at"]), "chunk": job["chunk"] if row["chunk"] is None else int(row["chunk"])}
            if row["state"] in TERMINAL_STATES:
                good = row["state"] == SUCCEEDED
                job |= {"result_file": row["result_file"] if good else None, "error": None if good else row["error"] or "no reason given"}
                self._end(job)
                out.append(self._told(key, "ended", job))
            elif changed:
                out.append(self._told(key, "changed", job))
        if job is None:
            return
        if not job["ended"] and not before:
            self.handle.registerTimer(min(now + self.poll_ms, job["deadline"]))
        self._put(job)
        yield pd.DataFrame(out, columns=[f.split()[0] for f in EVENTS.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, job = timerValues.getCurrentProcessingTimeInMs(), self._get()
        if job is None or job["ended"]:
            return
        if now >= job["deadline"]:
            job |= {"state": EXPIRED, "error": f"no end within {self.expire_ms} ms", "at": now}
            self._end(job)
            self._put(job)
            told = self._told(key, "ended", job)
        else:
            self.handle.registerTimer(min(now + self.poll_ms, job["deadline"]))
            told = (*self._told(key, "poll", job)[:-1], now)
        yield pd.DataFrame([told], columns=[f.split()[0] for f in EVENTS.split(", ")])

    def close(self) -> None:
        pass


def told(spark: SparkSession, path: str) -> DataFrame:
    """A stream of submissions and polls from JSON files that land under `path`."""
    return spark.readStream.schema(TOLD).json(path).where("job_name is not null")


def track(polls: DataFrame, *, poll_ms: int = POLL_MS, expire_ms: int = EXPIRE_MS) -> DataFrame:
    """A stream of EVENTS of the jobs in a stream of TOLD.

    A job is known from the first row that names it. Rows that are no later than what is known, and all
    rows after its end, change nothing. While it runs a `poll` event comes every `poll_ms`; a job that
    has not ended `expire_ms` after it became known has expired. A job that ends has a result file if it
    has succeeded, else an error. Rows without job, state or time are passed over.
    """
    polls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    columns = [f.split()[0] for f in TOLD.split(", ")]
    return polls.select(*columns).groupBy("job_name").transformWithStateInPandas(_Job(poll_ms, expire_ms), EVENTS, "append", "ProcessingTime")


def keep(events: DataFrame, state_path: str, checkpoint: str, *, due_path: str | None = None, every: str = "1 second") -> StreamingQuery:
    """Starts a query that keeps the last event of each job in a snapshot table (job_name, chunk, state,
    result_file, error, at), and, with `due_path`, the polls that are due as JSON lines by batch. A batch
    that is repeated after a failure gives the same rows."""

    def merge(batch: DataFrame, number: int) -> None:
        fields = ("chunk", "state", "result_file", "error", "at")
        last = batch.where("event <> 'poll'").groupBy("job_name").agg(F.max_by(F.struct(*fields), F.struct(F.col("event") == "ended", "at")).alias("r"))
        snapshots.upsert(last.select("job_name", "r.*"), state_path, key="job_name")
        due = batch.where("event = 'poll'").select("job_name", "chunk", "at")
        if due_path and not due.isEmpty():
            due.write.mode("overwrite").json(f"{due_path.rstrip('/')}/batch={number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def jobs(spark: SparkSession, state_path: str) -> DataFrame:
    """The jobs as they are known, for `batches.exit_code` and for collecting their result files."""
    if not snapshots.versions(spark, state_path):
        return spark.createDataFrame([], "job_name string, chunk int, state string, result_file string, error string, at long")
    return snapshots.read(spark, state_path)
