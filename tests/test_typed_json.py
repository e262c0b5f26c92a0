import json

import pytest
from pyspark.sql import functions as F

from tesseral.functions.typed_json import type_errors
from tesseral.sources import readers


def told(spark, value, schema, **options):
    df = spark.createDataFrame([(value if isinstance(value, str) else json.dumps(value),)], "t string")
    return df.select(type_errors(F.parse_json("t"), schema, **options).alias("e")).first().e


@pytest.mark.parametrize(
    "value,schema,errors",
    [
        ({"a": 1}, "a string", ["$.a: expected string, got bigint"]),
        ({"a": "7"}, "a int", ["$.a: expected int, got string"]),
        ({"a": 7.5}, "a int", ["$.a: expected int, got decimal"]),
        ('{"a": 7.0}', "a long", ["$.a: expected bigint, got decimal"]),
        ('{"a": 1e3}', "a int", ["$.a: expected int, got double"]),
        ({}, "a int, b string", ["$.a: missing", "$.b: missing"]),
        ({"a": None}, "a int", []),
        ({"a": None}, "a int not null", ["$.a: null"]),
        ({"a": 2**31 - 1}, "a int", []),
        ({"a": 2**31}, "a int", ["$.a: out of range for int"]),
        ({"a": -129}, "a byte", ["$.a: out of range for tinyint"]),
        ({"a": 2**63 - 1}, "a long", []),
        ({"a": 2**63}, "a long", ["$.a: out of range for bigint"]),
        ({"a": 1}, "a double", []),
        ({"a": "1"}, "a double", ["$.a: expected double, got string"]),
        ({"a": 1.25}, "a decimal(5,2)", []),
        ({"a": 1.255}, "a decimal(5,2)", ["$.a: out of range for decimal(5,2)"]),
        ({"a": "2024-02-30"}, "a date", ["$.a: not a date"]),
        ({"a": "2024-02-29"}, "a date", []),
        ({"a": True}, "a int, b boolean", ["$.a: expected int, got boolean", "$.b: missing"]),
        ({"a": [1, "x", None]}, "a array<int>", ["$.a[1]: expected int, got string"]),
        ({"a": [{"b": 1}, {}, 3]}, "a array<struct<b:string>>", ["$.a[0].b: expected string, got bigint", "$.a[1].b: missing", "$.a[2]: expected object, got bigint"]),
        ({"a": {"x": 1, "y z": "q"}}, "a map<string,int>", ["$.a.y z: expected int, got string"]),
        ({"a": [1, {"b": "anything"}]}, "a variant", []),
        ({"a.b": 1, "c'd": "x"}, "`a.b` int, `c'd` int", ["$.c'd: expected int, got string"]),
        ("[1]", "a int", ["$: expected object, got array"]),
        ("{}", "a array<int>", ["$.a: missing"]),
        ({"a": []}, "a array<int>", []),
    ],
)
def test_types(spark, value, schema, errors):
    assert told(spark, value, schema) == errors


def test_optional_and_closed(spark):
    value = {"a": 1, "z": 2, "y": [{"sha256": "s"}, {"more": 1}]}
    schema = "a int, b int, y array<struct<sha256:string>>"
    assert told(spark, value, schema) == ["$.b: missing", "$.y[1].sha256: missing"]
    assert told(spark, value, schema, optional={"b", "y[].sha256"}) == []
    assert told(spark, value, schema, optional={"b", "y[].sha256"}, closed=True) == ["$.y[1].more: not expected", "$.z: not expected"]


def test_readers_coerce_nothing(spark, tmp_path):
    lines = ['{"id": "a", "n": 1}', '{"id": 1, "n": 2}', '{"id": "b", "n": "7"}', "", '{"id": "c", "n": 7.5}', '{"id": "d"}', "[1]", "{", '{"n": "x"}', '{"id": "e", "n": null, "more": 1}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    path = str(tmp_path / "a.jsonl")
    rows, errors = readers.strict_jsonl(spark, path, "id string, n int")
    assert sorted((r.line_no, r.id, r.n) for r in rows.collect()) == [(1, "a", 1), (10, "e", None)]
    got = errors.collect()
    assert all(r.file.endswith("/a.jsonl") for r in got)
    assert sorted((r.line_no, r.error) for r in got) == [
        (2, "$.id: expected string, got bigint"), (3, "$.n: expected int, got string"), (4, "blank line"), (5, "$.n: expected int, got decimal"), (6, "$.n: missing"),
        (7, "not an object"), (8, "invalid JSON"), (9, "$.id: missing"), (9, "$.n: expected int, got string"),
    ]
    assert {(r.id, r.n) for r in readers.keyed_jsonl(spark, path, "id string, n int", "id").collect()} == {("a", 1), ("e", None)}
    told = sorted((r.line_no, r.error) for r in readers.keyed_errors(spark, path, "id", "id string, n int", closed=True).collect())
    assert told == [
        (2, "$.id: expected string, got bigint"), (3, "$.n: expected int, got string"), (5, "$.n: expected int, got decimal"), (6, "$.n: missing"), (7, "not an object"),
        (8, "invalid JSON"), (9, "no id"), (10, "$.more: not expected"),
    ]


def test_manifests_and_envelopes(spark, tmp_path):
    one = {"prompt_id": "p", "prompt": "x", "seed": 1001, "condition": "base", "guidance_scale": 3.5, "num_inference_steps": 20, "width": 8, "height": 8, "output_path": "a.png"}
    # both of a pair have a seed that is no int: neither may pass as an equal null
    lines = [one | {"seed": "1001"}, one | {"condition": "lora", "seed": "1001"}, one | {"width": 8.5}, {k: v for k, v in one.items() if k != "height"}]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, lines)))
    rows, errors = readers.generation_manifest(spark, str(tmp_path / "m.jsonl"))
    assert rows.count() == 0
    assert sorted((r.place.rpartition(":")[2], r.error) for r in errors.collect()) == [
        ("1", "$.seed: expected int, got string"), ("2", "$.seed: expected int, got string"), ("3", "$.width: expected int, got decimal"), ("4", "$.height: missing"),
    ]
    whole = dict.fromkeys(readers.ENVELOPE_KEYS, "x") | {"latency_ms": 1, "source_image_sha256": ["a"], "parsed_annotation": None, "validation_errors": []}
    for name, entry in (("a", whole), ("b", whole | {"validation_errors": "none"}), ("c", {k: v for k, v in whole.items() if k != "category"})):
        (tmp_path / f"e/{name}.json").parent.mkdir(exist_ok=True)
        (tmp_path / f"e/{name}.json").write_text(json.dumps(entry))
    good, bad = readers.cache_envelopes(spark, str(tmp_path / "e"), readers.ENVELOPE)
    assert [r.file[-6:] for r in good.collect()] == ["a.json"]
    assert {r.file[-6:]: r.error for r in bad.collect()} == {"b.json": "$.validation_errors: expected array, got string", "c.json": "missing keys: category"}
