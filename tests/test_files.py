import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesseral.operators import images, selection
from tesseral.sources import readers, sinks
from tesseral.streaming import results


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_images_are_found_picked_and_hashed(spark, tmp_path):
    for i in range(8):
        write(tmp_path / f"12/inst/images/{i:02d}.jpg", bytes([i]))
    write(tmp_path / "12/inst/images/x.JPG", b"no")
    write(tmp_path / "12/inst/other/00.jpg", b"no")
    files = readers.image_files(spark, str(tmp_path))
    assert files.count() == 8 and "content" not in files.columns
    picks = readers.with_content(selection.evenly_spaced(files, ["instance"], ["filename"]), str(tmp_path))
    assert {(r.pos, r.filename, bytes(r.content)) for r in picks.collect()} == {(k, f"{2 * k:02d}.jpg", bytes([2 * k])) for k in range(4)}
    assert {r.obj_id for r in picks.collect()} == {"12"}


def test_line_formats(spark, tmp_path):
    write(tmp_path / "c.txt", "1,Ice cream\r\nno comma\r\n2,a,b\r\n1, Cup \r\n")
    assert {tuple(r) for r in readers.categories(spark, str(tmp_path / "c.txt")).collect()} == {("1", " Cup"), ("2", "a,b")}
    write(tmp_path / "m.jsonl", '{"a": 1}\n\n{bad\n[1]\n{"a": 2}\n')
    rows, errors = readers.strict_jsonl(spark, str(tmp_path / "m.jsonl"), "a int")
    assert [r.a for r in rows.orderBy("line_no").collect()] == [1, 2]
    assert {(r.line_no, r.error) for r in errors.collect()} == {(2, "blank line"), (3, "invalid JSON"), (4, "not an object")}
    write(tmp_path / "k.jsonl", '{"key": "x", "v": 1}\n\n{"key": "x", "v": 2}\n')
    assert [r.v for r in readers.keyed_jsonl(spark, str(tmp_path / "k.jsonl"), "key string, v int").collect()] == [2]
    write(tmp_path / "cache/a.json", json.dumps(dict.fromkeys(readers.ENVELOPE_KEYS, "")))
    write(tmp_path / "cache/b.json", json.dumps({"category": 1}))
    good, bad = readers.cache_envelopes(spark, str(tmp_path / "cache"))
    assert good.count() == 1 and bad.first().error.startswith("missing keys: cache_schema_version, input_image_sha256")
    write(tmp_path / "p.jsonl", '{"id": "1", "prompt": "x"}\n')
    assert readers.prompts(spark, str(tmp_path / "p.jsonl"))[1].count() == 1


def test_captioned_images(spark, tmp_path):
    for n in ("a.png", "a.txt", "b.png"):
        write(tmp_path / n, " text \n")
    assert [r.stem for r in readers.captioned(readers.stems(spark, str(tmp_path))).collect()] == ["a"]
    assert readers.captions(spark, str(tmp_path / "a.txt")).first().caption == "text"


def test_manifests_and_scorecards(spark, tmp_path):
    rows = spark.createDataFrame([("b", None, [1]), ("a", "é", [2, 3])], "z string, a string, n array<int>")
    sinks.write_manifest(rows, str(tmp_path / "m"), ["z"])
    lines = [x for f in sorted((tmp_path / "m").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == ['{"a": "\\u00e9", "n": [2, 3], "z": "a"}', '{"a": null, "n": [1], "z": "b"}']
    card = spark.createDataFrame([("p1", 'a, "q"', "")], "id string, prompt string, score string")
    sinks.write_scorecard(card, str(tmp_path / "s"), ["id"])
    assert b"".join(f.read_bytes() for f in sorted((tmp_path / "s").glob("part-*"))) == b'id,prompt,score\r\np1,"a, ""q""",\r\n'
    routed = spark.createDataFrame([(1, "accepted"), (2, "abstention")], "i int, outcome string")
    sinks.write_routed(routed, str(tmp_path / "r"))
    sinks.append_records(routed, str(tmp_path / "j"))
    sinks.append_records(routed, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2 and spark.read.json(str(tmp_path / "j")).count() == 4
    chunks = spark.createDataFrame([(0, 0, "x"), (1, 0, "y"), (2, 1, "z")], "ordinal int, chunk int, value string")
    sinks.write_chunks(chunks, str(tmp_path / "k"))
    assert [f.read_text() for f in sorted((tmp_path / "k").glob("chunk=*/part-*"))] == ["x\ny\n", "z\n"]


def solid(h, w, colour):
    return np.full((h, w, 3), colour, np.uint8)


def test_grid_of_four(spark):
    made = images.grid([solid(4, 4, (255, 0, 0)), solid(4, 4, (0, 255, 0)), solid(4, 4, (0, 0, 255)), solid(4, 4, 128)], 4, 4)
    assert made.shape == (8, 8, 3)
    assert [tuple(made[y, x]) for y, x in ((0, 0), (0, 7), (7, 0), (7, 7))] == [(255, 0, 0), (0, 255, 0), (0, 0, 255), (128, 128, 128)]
    assert (images.fitted(solid(8, 8, 200), 4, 4) == 200).all()
    padded = images.fitted(solid(2, 2, 9), 4, 4)
    assert padded[0].max() == 0 and (padded[1:3, 1:3] == 9).all()
    wide = images.fitted(solid(4, 8, 50), 4, 4)
    assert wide[0].max() == 0 and wide[3].max() == 0 and (wide[1:3] == 50).all()
    with pytest.raises(ValueError):
        images.grid([solid(1, 1, 0)])
    one = F.struct(F.lit(2).alias("height"), F.lit(2).alias("width"), F.lit(1).alias("nChannels"), F.lit(bytearray(b"\x07" * 4)).alias("data"))
    got = images.composites(spark.range(1).select(F.lit("i").alias("instance"), F.array(one, one, one, one).alias("images")), height=2, width=2).first()
    assert bytes(got.data) == b"\x07" * 48 and got.composite_sha256 == images.pixel_sha256(solid(4, 4, 7))


def test_results_stream(spark, tmp_path):
    answer = {"candidates": [{"content": {"parts": [{"text": "not json"}]}}]}
    line = lambda k: json.dumps({"key": k, "response": json.dumps(answer)}) + "\n"
    write(tmp_path / "in/result-000.jsonl", line("a") + "\n" + line("a"))
    results.collect(spark, str(tmp_path / "in"), str(tmp_path / "cache"), str(tmp_path / "ck"))
    write(tmp_path / "in/result-001.jsonl", line("a") + line("b"))
    results.collect(spark, str(tmp_path / "in"), str(tmp_path / "cache"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "cache")).select("key", "raw_response_text", "validation_errors").collect()
    assert sorted(r.key for r in got) == ["a", "b"] and all("not valid JSON" in r.validation_errors[0] for r in got)
    later = {"candidates": [{"content": {"parts": [{"text": "{}"}]}}]}
    write(tmp_path / "in/result-002.jsonl", line("a") + json.dumps({"key": "a", "response": json.dumps(later)}))
    results.collect(spark, str(tmp_path / "in"), str(tmp_path / "cache"), str(tmp_path / "ck"))
    assert {r.key: r.raw_response_text for r in spark.read.parquet(str(tmp_path / "cache")).collect()} == {"a": "{}", "b": "not json"}
