import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_cache import instances
from tesseral.operators import batches, images, layout, metrics, selection
from tesseral.sources import tree


def png(path, pixels):
    """Writes 8-bit gray, RGB or RGBA pixels."""
    h, w = pixels.shape[:2]
    channels = pixels.shape[2] if pixels.ndim == 3 else 1
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    header = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


@pytest.fixture
def root(tmp_path):
    rng = np.random.default_rng(4)
    shapes = [(6, 5, 3), (6, 5), (6, 5, 4), (3, 9, 3)]
    kept = {}
    for k, shape in enumerate(shapes):
        kept[k] = rng.integers(0, 256, shape, dtype=np.uint8)
        png(f"{tmp_path}/1/a/images/{k}.png", kept[k])
    for k in range(4):
        png(f"{tmp_path}/1/b/images/{k}.png", kept[0])
    with open(f"{tmp_path}/1/b/images/2.png", "wb") as f:
        f.write(b"no image")
    return str(tmp_path), kept


def test_from_directories_to_composites(spark, root):
    top, kept = root
    entries = tree.images_of(tree.tree(spark, top), ".png").withColumn("instance", F.element_at(F.split("image_dir", "/"), -2))
    picks = selection.evenly_spaced(entries, ["instance"], ["filename"]).select("instance", "pos", F.concat(F.lit("file://"), "path").alias("path"))
    made, errors = images.composed(spark, picks, top, height=8, width=8)
    rgb = [kept[0], np.repeat(kept[1][:, :, None], 3, axis=2), kept[2][:, :, :3], kept[3]]
    want = images.grid(rgb, 8, 8)
    [r] = made.collect()
    assert (r.instance, r.width, r.height, bytes(r.data)) == ("a", 16, 16, want.tobytes()) and r.composite_sha256 == images.pixel_sha256(want)
    [e] = errors.collect()
    assert e.instance == "b" and e.error.startswith("cannot read ") and e.error.endswith("/b/images/2.png")
    few = picks.where("instance = 'a' and pos < 3")
    assert images.composed(spark, few, top)[1].first().error == "expected four images, received 3"


def test_prepared_batches_are_stored(spark, tmp_path):
    path = str(tmp_path / "work")
    index, state = batches.prepared(instances(spark), spark.createDataFrame([], "cache_key string, validation_errors array<string>"), ["key"], 4)
    batches.store_prepared(index, state, path)
    known, now = batches.stored(spark, path)
    assert known.count() == 8 and [r.chunk for r in batches.unsubmitted(now).orderBy("chunk").collect()] == [0, 1]
    one = batches.submitted(now, spark.createDataFrame([(1, "job-b")], "chunk int, job_name string"))
    assert batches.store_state(one.where("job_name is not null"), path) == 2
    assert {r.chunk: r.job_name for r in batches.stored(spark, path)[1].collect()} == {0: None, 1: "job-b"}
    with pytest.raises(Exception):
        batches.store_prepared(index, state, path)


def test_large_groups_are_picked_from_over_all_tasks(spark, monkeypatch):
    rows = spark.range(1000).selectExpr("case when id < 700 then 'hot' when id < 703 then 'few' when id < 850 then null else concat('g', id % 20) end as g", "(id * 7919) % 1000 as o")
    want = sorted((r.g or "", r.o, r.pos, r.group_size) for r in selection.evenly_spaced(rows, ["g"], ["o"], large_groups=False).collect())
    monkeypatch.setattr(selection, "LARGE", 100)
    got = selection.evenly_spaced(rows, ["g"], ["o"])
    assert sorted((r.g or "", r.o, r.pos, r.group_size) for r in got.collect()) == want and len(want) == 4 * 22 and got.columns == ["g", "o", "group_size", "pos"]


def test_guards_and_halves(spark):
    rows = spark.createDataFrame([("a.png",), ("a.txt",), ("b.png",), ("c.txt",), ("d.png",), ("d.JPG",), ("d.txt",), ("e.md",)], "name string")
    assert {(r.stem, r.error) for r in layout.unpaired(rows).collect()} == {("b", "image without caption"), ("c", "caption without image"), ("d", "several images")}
    with pytest.raises(ValueError):
        layout.rename_map(rows, start=-1)
    with pytest.raises(ValueError):
        selection.evenly_spaced(rows, ["name"], ["name"], 0)


def test_holm_over_a_large_family(spark):
    ps = [round(((i * 7919) % 1009) / 1009 * 0.002 * (1 + i % 5), 9) for i in range(1000)]
    rows = spark.createDataFrame(list(enumerate(ps)), "t int, p double").repartition(5)
    got = {r.t: r.adjusted for r in metrics.holm(rows, "t", "p").collect()}
    top, want = 0.0, {}
    for r, (p, t) in enumerate(sorted((p, t) for t, p in enumerate(ps))):
        top = max(top, p * (1000 - r))
        want[t] = min(1.0, top)
    assert got == pytest.approx(want) and 1.0 in want.values()
    assert metrics.holm(rows.limit(0), "t", "p").collect() == []
