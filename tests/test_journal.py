import json
import os
import subprocess
import sys
import textwrap
from collections import Counter

import pytest

from tesseral.operators import annotators, journal

REQUESTS = "cache_key string, composite_sha256 string, category string"


def requests(spark, n):
    return spark.createDataFrame([(f"k{i}", f"image{i}", "cup") for i in range(n)], REQUESTS)


def counting(path, fail=()):
    """An annotator that notes each call in a file; the images in `fail` raise."""

    def factory():
        def call(composite, category):
            with open(path, "a") as f:
                f.write(composite + "\n")
            if composite in fail:
                raise ValueError("quota")
            return f"{category} of {composite}"

        return call

    return factory


def calls(path):
    return Counter(open(path).read().split()) if os.path.exists(path) else Counter()


def test_nothing_is_called_twice(spark, tmp_path):
    log, noted = f"file://{tmp_path}/journal", f"{tmp_path}/calls"
    how = journal.Calls(shards=3, concurrency=4, attempts=1)
    first = journal.durable(requests(spark, 40), counting(noted), log, how).collect()
    assert {(r.cache_key, r.raw_response_text, r.error, r.called) for r in first} == {(f"k{i}", f"cup of image{i}", None, True) for i in range(40)}
    # what reads the result again, or a larger job, pays for what is new only
    again = journal.durable(requests(spark, 50), counting(noted), log, how).collect()
    assert len(again) == 50 and sorted(r.cache_key for r in again if r.called) == sorted(f"k{i}" for i in range(40, 50))
    assert {r.raw_response_text for r in again} == {f"cup of image{i}" for i in range(50)} and set(calls(noted).values()) == {1}
    assert {(r.cache_key, r.raw_response_text) for r in journal.responses(spark, log).collect()} == {(f"k{i}", f"cup of image{i}") for i in range(50)}
    journal.clear(spark, log)
    assert not os.path.exists(f"{tmp_path}/journal")


def test_failures_are_tried_again_and_not_journalled(spark, tmp_path):
    log, noted = f"file://{tmp_path}/journal", f"{tmp_path}/calls"
    how = journal.Calls(shards=2, concurrency=2, attempts=3, pause_s=0.01)
    got = {r.cache_key: (r.raw_response_text, r.error) for r in journal.durable(requests(spark, 5), counting(noted, {"image2"}), log, how).collect()}
    assert got["k2"] == (None, "ValueError: quota") and calls(noted) == Counter({"image2": 3} | {f"image{i}": 1 for i in (0, 1, 3, 4)})
    final = journal.Calls(shards=2, attempts=3, final=(ValueError,))
    assert {r.error for r in journal.durable(requests(spark, 5), counting(noted, {"image2"}), log, final).collect() if r.called} == {"ValueError: quota"}
    assert calls(noted)["image2"] == 4
    assert {r.error for r in journal.durable(requests(spark, 5), counting(noted), log, how).collect()} == {None}
    with pytest.raises(ValueError):
        journal.durable(requests(spark, 1), counting(noted), log, journal.Calls(concurrency=0))


def test_a_torn_line_is_not_read(spark, tmp_path):
    shard = tmp_path / "journal" / "shard=0"
    shard.mkdir(parents=True)
    whole = json.dumps({"cache_key": "k0", "raw_response_text": "old", "latency_ms": 1.0})
    (shard / "a.jsonl").write_text(whole + "\n" + whole.replace("k0", "k1")[:-9])
    got = journal.durable(requests(spark, 2), counting(f"{tmp_path}/calls"), f"file://{tmp_path}/journal", journal.Calls(shards=1)).collect()
    assert {(r.cache_key, r.raw_response_text, r.called) for r in got} == {("k0", "old", False), ("k1", "cup of image1", True)}


def test_behind_the_cache(spark, tmp_path):
    noted, log = f"{tmp_path}/calls", f"file://{tmp_path}/journal"
    cache = spark.createDataFrame([("k0", "cached")], "cache_key string, raw_response_text string")
    paid = lambda m: journal.durable(m, counting(noted), log, journal.Calls(shards=2))
    for _ in range(2):
        got = {r.cache_key: r.raw_response_text for r in annotators.memoised(requests(spark, 4), cache, paid).collect()}
        assert got == {"k0": "cached"} | {f"k{i}": f"cup of image{i}" for i in (1, 2, 3)}
    assert calls(noted) == Counter({f"image{i}": 1 for i in (1, 2, 3)})


def test_a_task_that_is_killed_half_way_calls_nothing_twice(tmp_path):
    program = textwrap.dedent(f"""
        import os
        from pyspark.sql import SparkSession
        from tesseral.operators import journal
        spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        here = {str(tmp_path)!r}
        def factory():
            def call(composite, category):
                noted = here + "/calls"
                made = open(noted).read().count("\\n") if os.path.exists(noted) else 0
                if made in (7, 13) and not os.path.exists(here + f"/killed{{made}}"):
                    open(here + f"/killed{{made}}", "w").close()
                    os.kill(os.getpid(), 9)
                with open(noted, "a") as f:
                    f.write(composite + "\\n")
                return "text of " + composite
            return call
        rows = spark.createDataFrame([(f"k{{i}}", f"image{{i}}", "cup") for i in range(30)], {REQUESTS!r})
        got = journal.durable(rows, factory, "file://" + here + "/journal", journal.Calls(shards=1, concurrency=1)).collect()
        assert sorted((r.cache_key, r.raw_response_text) for r in got) == sorted((f"k{{i}}", f"text of image{{i}}") for i in range(30)), got
        print("ALL THERE", sum(r.called for r in got))
    """)
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    done = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, timeout=240, env=env)
    assert "ALL THERE 17" in done.stdout, done.stderr[-3000:]  # 30 less the 13 that the killed attempts had paid for
    assert os.path.exists(tmp_path / "killed7") and os.path.exists(tmp_path / "killed13")
    made = calls(tmp_path / "calls")
    assert len(made) == 30 and set(made.values()) == {1}
