import json

import pytest
from pyspark.sql import functions as F

from tesseral.operators import batches, cache, evaluation, identity, splits
from tesseral.operators import annotation as A
from tesseral.sources import readers

MODEL = "annotator-1"


def answer(summary, confidence=0.9):
    views = [
        {"tile": t, "horizontal_view": "front", "side": "neither", "vertical_angle": "eye_level", "framing": "whole", "visible_features": ["edge"], "confidence": confidence}
        for t in A.TILES
    ]
    text = json.dumps({"object_summary": summary, "views": views})
    return json.dumps({"candidates": [{"content": {"parts": [{"text": text[:9]}, {"text": text[9:]}]}}]})


def instances(spark):
    rows = spark.createDataFrame([(i, f"hash{i % 6}", [f"s{i}a", f"s{i}b"], "cup") for i in range(8)], "i int, composite_sha256 string, source_image_sha256 array<string>, category string")
    model, category, composite = F.lit(MODEL), F.col("category"), F.col("composite_sha256")
    return rows.withColumn("key", identity.request_key(model, category, composite)).withColumn("cache_key", identity.cache_key(model, category, composite))


def test_from_prepare_to_collect(spark, tmp_path):
    path, rows = str(tmp_path / "cache"), instances(spark)
    first = rows.where("i = 0").withColumn("raw_response_text", F.lit("{}")).withColumn("model_id", F.lit(MODEL))
    cache.upsert(cache.envelope(A.parsed(first)).drop("i", "key"), path)
    index, state = batches.prepared(rows, cache.entries(spark, path), ["key"], 4)
    # the entry of hash0 is invalid, so it is asked for again; equal keys are asked for once
    assert index.count() == 8 and index.select("key").where("chunk is not null").distinct().count() == 6
    assert sorted(tuple(r) for r in state.select("chunk", "input_file").collect()) == [(0, "input-000.jsonl"), (1, "input-001.jsonl")]
    state = batches.submitted(state, spark.createDataFrame([(0, "job-a")], "chunk int, job_name string"))
    assert [r.chunk for r in batches.unsubmitted(state).collect()] == [1]
    state = batches.submitted(state, spark.createDataFrame([(0, "again"), (1, "job-b")], "chunk int, job_name string"))
    seen = [("job-a", "JOB_STATE_SUCCEEDED", "r0", None), ("job-b", "JOB_STATE_RUNNING", "r1", None)]
    told = "job_name string, state string, result_file string, error string"
    state = batches.polled(state, spark.createDataFrame(seen, told))
    assert {r.chunk: (r.job_name, r.result_file) for r in state.collect()} == {0: ("job-a", "r0"), 1: ("job-b", None)}
    assert batches.exit_code(state).first()[0] == 2
    state = batches.polled(state, spark.createDataFrame([("job-b", "JOB_STATE_FAILED", None, "quota")], told))
    assert {r.chunk: (r.result_file, r.error) for r in state.collect()} == {0: ("r0", None), 1: (None, "quota")} and batches.exit_code(state).first()[0] == 1

    by = {r.composite_sha256: r.key for r in rows.collect()}
    results = [
        (by["hash0"], 0, answer("a cup"), None), (by["hash1"], 1, answer("old"), None), (by["hash1"], 2, answer("new"), None),
        (by["hash2"], 3, None, "quota"), (by["hash3"], 4, '{"candidates": []}', None), (by["hash4"], 5, answer("x", 2), None), ("zz", 6, answer("y"), None),
    ]
    got = batches.collected(index, spark.createDataFrame(results, "key string, ordinal int, response string, error string"), model=MODEL)
    outcome = {(r.key, r.i): (r.status, r.validation_outcome) for r in got.collect()}
    assert outcome == {
        (by["hash0"], 0): ("answered", "valid"), (by["hash0"], 6): ("answered", "valid"), (by["hash1"], 1): ("answered", "valid"), (by["hash1"], 7): ("answered", "valid"),
        (by["hash2"], 2): ("error", "invalid"), (by["hash3"], 3): ("no content", "invalid"), (by["hash4"], 4): ("answered", "invalid"), ("zz", None): ("unknown", "invalid"),
    }
    assert batches.collect_code(got).first()[0] == 1 and batches.collect_code(got.where("validation_outcome = 'valid'")).first()[0] == 0

    fresh = got.where("status = 'answered'").dropDuplicates(["cache_key"]).drop("i", "key", "ordinal", "chunk", "input_file", "status", "error")
    cache.upsert(fresh, path)
    cache.upsert(fresh, path)
    table = cache.entries(spark, path)
    assert table.count() == 3 and set(readers.ENVELOPE_KEYS) <= set(table.columns)
    assert {r.parsed_annotation.object_summary for r in table.where("validation_outcome = 'valid'").collect()} == {"a cup", "new"}
    again, _ = batches.prepared(rows, table, ["key"], 4)
    assert {r.composite_sha256 for r in again.where("chunk is not null").collect()} == {"hash2", "hash3", "hash4", "hash5"}


def test_identity_of_entries(spark):
    rows = instances(spark).where("i < 3")
    kept = A.parsed(rows.withColumn("raw_response_text", F.lit("{}")).withColumn("model_id", F.when(F.col("i") == 1, "other").otherwise(MODEL)))
    kept = kept.withColumn("source_image_sha256", F.when(F.col("i") == 2, F.array(F.lit("changed"))).otherwise(F.col("source_image_sha256")))
    expected = {
        "cache_schema_version": F.lit(identity.CAPTION_SCHEMA_VERSION), "model_id": F.lit(MODEL), "prompt_version": F.lit(identity.PROMPT_VERSION),
        "input_image_sha256": F.col("composite_sha256"), "source_image_sha256": F.col("source_image_sha256"), "category": F.col("category"),
    }
    got = cache.checked(rows, cache.envelope(kept).drop("i", "key"), expected)
    assert {r.i: r.identity_error for r in got.collect()} == {0: None, 1: "Cache identity mismatch for model_id", 2: "Cache identity mismatch for source_image_sha256"}


def test_outcomes_of_all_instances(spark):
    rows = spark.createDataFrame([(1, "failed", ["bad"], None), (2, "accepted", [], [])], "i int, outcome string, validation_errors array<string>, rejection_reasons array<string>")
    every = A.with_skipped(rows, spark.createDataFrame([(3, "too few")], "i int, reason string"), "i")
    assert sorted(map(tuple, every.collect())) == [(1, "failed", "bad"), (2, "accepted", ""), (3, "skipped", "too few")]
    assert batches.build_code(every).first()[0] == 1 and batches.build_code(every.where("i > 1")).first()[0] == 0


def test_generation_manifest_and_objects(spark, tmp_path):
    one = {"prompt_id": "p", "prompt": "x", "seed": 1001, "condition": "base", "guidance_scale": 3.5, "num_inference_steps": 20, "width": 8, "height": 8, "output_path": "a.png"}
    lines = [one, one | {"condition": "lora", "output_path": "/abs/b.png"}, one | {"seed": 7}]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, lines)))
    rows, errors = readers.generation_manifest(spark, str(tmp_path / "m.jsonl"))
    assert {r.output_path for r in rows.collect()} == {f"{tmp_path}/a.png", "/abs/b.png"}
    assert [(r.place, r.error) for r in errors.collect()] == [("p/7", "expected exactly one record for each condition")]
    wide = {(r.seed, r.base is None, r.lora is None) for r in evaluation.by_condition(rows).collect()}
    assert wide == {(1001, False, False), (7, False, True)}
    with pytest.raises(ValueError):
        evaluation.pair_errors(rows.drop("width"))
    (tmp_path / "o.json").write_text('{\n "a": 1}')
    assert readers.json_object(spark, str(tmp_path / "o.json"), "a int").first().a == 1
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(Exception, match="Expected a JSON object"):
        readers.json_object(spark, str(tmp_path / "l.json"), "a int").collect()


def test_lines_and_keys(spark, tmp_path):
    (tmp_path / "k.jsonl").write_text("".join(f'{{"key": "{i % 3}", "v": {i}}}\n' for i in range(5000)) + '\nnonsense\n{"v": 1}\n[2]\n')
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        numbered = readers.lines_of(spark, str(tmp_path / "k.jsonl"))
        assert numbered.where("value <> '' and value like '{_key%'").where("cast(get_json_object(value, '$.v') as int) + 1 <> line_no").count() == 0
        assert {(r.key, r.v) for r in readers.keyed_jsonl(spark, str(tmp_path / "k.jsonl"), "key string, v int").collect()} == {("0", 4998), ("1", 4999), ("2", 4997)}
        told = readers.keyed_errors(spark, str(tmp_path / "k.jsonl")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert {(r.line_no, r.error) for r in told} == {(5002, "invalid JSON"), (5003, "no key"), (5004, "not an object")}
    (tmp_path / "p.jsonl").write_text('{"id": 1, "prompt": "x"}\n')
    assert "must be strings" in " ".join(r.error for r in readers.prompts(spark, str(tmp_path / "p.jsonl"))[1].collect())
    (tmp_path / "none.jsonl").write_text("")
    with pytest.raises(ValueError):
        readers.prompts(spark, str(tmp_path / "none.jsonl"))


def test_totals_nested_leaks_and_samples(spark):
    rows = spark.createDataFrame([("train", ["a", "b"]), ("holdout", ["b", "c"]), ("train", ["d"])], "split string, h array<string>")
    assert [tuple(r) for r in splits.nested_leakage(rows, "h").collect()] == [("b", 2)]
    assert [tuple(r) for r in splits.expected_total(rows, 4).collect()] == [(4, 3)] and splits.expected_total(rows, 3).collect() == [] and splits.expected_total(rows, None).collect() == []
    assert splits.first_five(spark.range(20).selectExpr("id % 2 as g", "id div 2 as v"), "g", "v").where("g = 0").first()["first"] == [0, 1, 2, 3, 4]
