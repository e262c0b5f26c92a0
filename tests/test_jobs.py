import json
import time

from pyspark.sql import functions as F

from test_cache import MODEL, answer, instances
from tesseral.operators import annotators, batches, cache
from tesseral.streaming import jobs, results


def land(path, name, *rows):
    path.mkdir(exist_ok=True)
    (path / f".{name}").write_text("\n".join(map(json.dumps, rows)))
    (path / f".{name}").rename(path / name)


def until(query, told, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        if query.exception():
            raise query.exception()
        if told():
            return
        time.sleep(0.3)
    raise AssertionError("not in time")


def poll(job, state, at, **more):
    return {"job_name": job, "state": state, "at": at} | more


def test_jobs_from_submission_to_end(spark, tmp_path):
    inbox, state, ck, due = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "ck"), str(tmp_path / "due")
    land(inbox, "0.json", poll("a", "JOB_STATE_PENDING", 1, chunk=0), poll("b", "JOB_STATE_PENDING", 1, chunk=1), poll("c", "JOB_STATE_PENDING", 1, chunk=2), poll("e", "JOB_STATE_FAILED", 5, chunk=3))

    def started(expire_ms):
        return jobs.keep(jobs.track(jobs.told(spark, str(inbox)), poll_ms=1500, expire_ms=expire_ms), state, ck, due_path=due, every="300 milliseconds")

    def now():
        return {r.job_name: (r.chunk, r.state, r.result_file, r.error) for r in jobs.jobs(spark, state).collect()}

    assert batches.exit_code(jobs.jobs(spark, state)).first()[0] == 0
    query = started(600_000)
    try:
        until(query, lambda: len(now()) == 4)
        assert now()["e"] == (3, "JOB_STATE_FAILED", None, "no reason given") and batches.exit_code(jobs.jobs(spark, state)).first()[0] == 1
        until(query, lambda: (tmp_path / "due").exists() and {r.job_name for r in spark.read.schema("job_name string").json(due).collect()} == {"a", "b", "c"})
        land(inbox, "1.json", poll("a", "JOB_STATE_RUNNING", 10), poll("b", "JOB_STATE_SUCCEEDED", 12, result_file="r1"))
        until(query, lambda: now()["b"][1] == "JOB_STATE_SUCCEEDED" and now()["a"][1] == "JOB_STATE_RUNNING")
    finally:
        query.stop()
    # polls again and late: nothing that has been told changes, and what has ended does not go on
    land(inbox, "2.json", poll("a", "JOB_STATE_PENDING", 1, chunk=0), poll("a", "JOB_STATE_RUNNING", 10), poll("b", "JOB_STATE_RUNNING", 99), poll("b", "JOB_STATE_FAILED", 100, error="late"), poll("e", "JOB_STATE_SUCCEEDED", 200, result_file="no"), poll("d", "JOB_STATE_PENDING", 20, chunk=4))
    query = started(1000)  # goes on from its checkpoint; what is new has little time
    try:
        until(query, lambda: now().get("d", ("",) * 4)[1] == jobs.EXPIRED)  # never told of again
        kept = {"b": (1, "JOB_STATE_SUCCEEDED", "r1", None), "e": (3, "JOB_STATE_FAILED", None, "no reason given"), "c": (2, "JOB_STATE_PENDING", None, None)}
        kept["d"] = (4, jobs.EXPIRED, None, "no end within 1000 ms")
        assert now() == kept | {"a": (0, "JOB_STATE_RUNNING", None, None)}
        land(inbox, "3.json", poll("a", "JOB_STATE_SUCCEEDED", 50, result_file="r0"))
        until(query, lambda: now()["a"][2] == "r0")
        assert now() == kept | {"a": (0, "JOB_STATE_SUCCEEDED", "r0", None)}
    finally:
        query.stop()


def test_results_reach_the_cache_that_is_read(spark, tmp_path):
    path, index_path, ck, wrong, inbox = (str(tmp_path / n) for n in ("cache", "index", "ck", "wrong", "in"))
    rows = instances(spark)
    index, _ = batches.prepared(rows, spark.createDataFrame([], "cache_key string, validation_errors array<string>"), ["key"], 4)
    index.write.parquet(index_path)
    by = {r.composite_sha256: r for r in rows.orderBy(F.desc("i")).collect()}
    key = lambda n: by[f"hash{n}"].key
    line = lambda n, **more: {"key": key(n)} | more
    land(tmp_path / "in", "0.jsonl", line(0, response=answer("a cup")), line(1, response=answer("first")), line(1, response=answer("second")), {"key": "zz", "response": answer("y")}, line(2, response='{"candidates": []}'), line(3, response=answer("x", 2)))
    results.take_in(spark, inbox, index_path, path, ck, wrong, model=MODEL)
    # later errors leave what is there alone
    land(tmp_path / "in", "1.jsonl", line(0, error="quota"), line(4, error="quota"), line(1, response='{"candidates": []}'))
    results.take_in(spark, inbox, index_path, path, ck, wrong, model=MODEL)
    table = cache.entries(spark, path)
    assert {r.cache_key: (r.parsed_annotation.object_summary if r.parsed_annotation else None, r.validation_outcome, r.model_id) for r in table.collect()} == {
        by["hash0"].cache_key: ("a cup", "valid", MODEL), by["hash1"].cache_key: ("second", "valid", MODEL), by["hash3"].cache_key: ("x", "invalid", MODEL),
    }
    told = {(r.key, r.status, (r.error or "")[:20]) for r in spark.read.json(wrong).collect()}
    assert told == {("zz", "unknown", ""), (key(2), "no content", ""), (key(3), "invalid", "views.0.confidence: "), (key(0), "error", "quota"), (key(4), "error", "quota"), (key(1), "no content", "")}
    got = annotators.memoised(rows.select("cache_key", "composite_sha256", "category").distinct(), table, lambda m: annotators.recorded(m, table))
    assert {r.composite_sha256 for r in got.where("cached").collect()} == {"hash0", "hash1", "hash3"}
    assert {r.composite_sha256 for r in batches.uncached(rows, table, "cache_key").collect()} == {"hash2", "hash3", "hash4", "hash5"}
