import json
import os

import pytest

from tesseral.sources import sinks, snapshots

SCHEMA = "instance string, outcome string, output_caption string, rejection_reasons array<string>"


def rows(spark, *given):
    return spark.createDataFrame([(i, o, f"{i}.txt" if o == "accepted" else None, ["dark"] if o == "abstention" else None) for i, o in given], SCHEMA)


def outcomes(spark, path, version=None):
    return {r.instance: r.outcome for r in sinks.routed(spark, path, version=version).collect()}


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def test_an_instance_moves_and_other_parts_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    many = [(f"i{n}", "accepted" if n % 3 else "abstention") for n in range(300)]
    assert sinks.route(rows(spark, *many), path) == 1
    before = files(path)
    assert sinks.route(rows(spark, ("i1", "abstention"), ("new", "accepted")), path) == 2
    want = dict(many) | {"i1": "abstention", "new": "accepted"}
    assert outcomes(spark, path) == want and outcomes(spark, path, 1) == dict(many)
    assert before <= files(path) and len({f.split("bucket=")[1].split("/")[0] for f in files(path) - before}) <= 2
    # exclusive: it is in one outcome only, and that outcome is read from its files alone
    accepted = sinks.routed(spark, path, "accepted")
    assert "i1" not in {r.instance for r in accepted.collect()} and "(outcome" in accepted._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert sinks.route(rows(spark), path, removed=rows(spark, ("i1", "abstention"), ("unknown", "accepted"))) == 3
    assert outcomes(spark, path) == {k: v for k, v in want.items() if k != "i1"}
    assert sinks.route(rows(spark), path) == 3
    assert snapshots.expire(spark, path, keep=2) == [1] and outcomes(spark, path, 2) == want
    with pytest.raises(Exception):
        outcomes(spark, path, 1)


def test_a_run_killed_before_its_rename_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sinks.route(rows(spark, ("a", "accepted"), ("b", "abstention")), path)

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(snapshots, "_publish", killed)
    with pytest.raises(KeyboardInterrupt):
        sinks.route(rows(spark, ("a", "abstention"), ("c", "accepted")), path)
    monkeypatch.undo()
    assert len({f.split("write=")[1].split("/")[0] for f in files(path)}) == 2  # its files are there, in no snapshot
    assert outcomes(spark, path) == {"a": "accepted", "b": "abstention"} and snapshots.versions(spark, path) == [1]
    assert sinks.route(rows(spark, ("a", "abstention"), ("c", "accepted")), path) == 2
    assert outcomes(spark, path) == {"a": "abstention", "b": "abstention", "c": "accepted"}


@pytest.mark.parametrize("other", ["a", "b"])
def test_a_writer_that_lost_the_race_tries_again(spark, tmp_path, monkeypatch, other):
    # b lies in another bucket: the loser only rebases; a is the loser's own key: it does its update again
    path = str(tmp_path / "t")
    sinks.route(rows(spark, ("a", "accepted"), ("b", "accepted")), path)
    publish, tries = snapshots._publish, []

    def raced(session, where, at):
        tries.append(sorted(set(at.writes.values())))
        if len(tries) == 1:
            monkeypatch.setattr(snapshots, "_publish", publish)
            assert sinks.route(rows(session, (other, "abstention"), ("a2", "accepted")), where) == 2
            monkeypatch.setattr(snapshots, "_publish", raced)
        return publish(session, where, at)

    monkeypatch.setattr(snapshots, "_publish", raced)
    assert sinks.route(rows(spark, ("a", "failed")), path) == 3
    assert outcomes(spark, path) == {"a": "failed", "b": "abstention" if other == "b" else "accepted", "a2": "accepted"}
    assert len(tries) == 2 and snapshots.versions(spark, path) == [1, 2, 3]
    assert outcomes(spark, path, 2)["a"] == ("abstention" if other == "a" else "accepted")


def test_new_columns_and_both_manifests_of_one_snapshot(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.route(rows(spark, ("b", "accepted"), ("c", "abstention")), path)
    sinks.route(rows(spark, ("a", "accepted")).selectExpr("*", "7 as score"), path)
    assert {r.instance: r.score for r in snapshots.read(spark, path).collect()} == {"a": 7, "b": None, "c": None}
    targets = {"accepted": str(tmp_path / "m"), "abstention": str(tmp_path / "x")}
    assert sinks.write_routed_manifests(spark, path, targets, ["instance"], 1) == 1
    lines = lambda p: [json.loads(r.value) for r in spark.read.text(p).collect()]
    assert lines(targets["accepted"]) == [{"instance": "b", "output_caption": "b.txt"}]
    assert lines(targets["abstention"]) == [{"instance": "c", "rejection_reasons": ["dark"]}]


def test_a_named_batch_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "r")
    for batch in ("1", "1", "2"):
        sinks.append_records(rows(spark, (f"i{batch}", "accepted")), path, batch)
    assert sorted(r.instance for r in spark.read.json(path).collect()) == ["i1", "i2"]
