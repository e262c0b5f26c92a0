import os

import pytest
from pyspark.sql import functions as F

from tesseral.operators import evaluation, layout, selection, splits
from tesseral.sources import placing, tree


def files_of(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(root) for n in names}


def put(root, **named):
    for name, content in named.items():
        path = root / name.replace("__", "/").replace("_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)


def plan(spark, root, *pairs):
    return spark.createDataFrame([(f"file://{root}/{a}", f"file://{root}/{b}") for a, b in pairs], "source string, target string")


def outcomes(rows, root):
    return {(r.source.rpartition("/")[2], r.target.rpartition("/")[2]): r.outcome for r in rows.collect()}


def test_copies_skip_same_bytes_and_tell_of_others(spark, tmp_path):
    put(tmp_path, in__a_png=b"A" * 3_000_000, in__a_txt=b"text", in__b_png=b"B", in__c_png=b"C", out__b_png=b"B", out__c_png=b"other")
    pairs = [("in/a.png", "out/x/a.png"), ("in/a.txt", "out/x/a.txt"), ("in/b.png", "out/b.png"), ("in/c.png", "out/c.png"), ("in/none", "out/none"), ("in/b.png", "out/x/a.png"), ("in/a.png", "out/x/a.png")]
    got = outcomes(placing.copy_files(plan(spark, tmp_path, *pairs)), tmp_path)
    assert got == {
        ("a.png", "a.png"): "copied", ("a.txt", "a.txt"): "copied", ("b.png", "b.png"): "same", ("c.png", "c.png"): "conflict", ("none", "none"): "no source", ("b.png", "a.png"): "target taken",
    }
    assert files_of(tmp_path / "out") == {"x/a.png": b"A" * 3_000_000, "x/a.txt": b"text", "b.png": b"B", "c.png": b"other"}
    again = outcomes(placing.copy_files(plan(spark, tmp_path, *pairs[:4])), tmp_path)
    assert sorted(again.values()) == ["conflict", "same", "same", "same"]


@pytest.mark.parametrize("move", [False, True])
def test_an_aborted_job_leaves_no_file(spark, tmp_path, monkeypatch, move):
    put(tmp_path, **{f"in__{i}_png": bytes([i]) for i in range(12)}, out__3_png=b"\x03", out__4_png=b"mine")
    before = files_of(tmp_path)
    os.mkdir(tmp_path / "in/11.png.d")
    pairs = [(f"in/{i}.png", f"out/{i}.png") for i in range(11)] + [("in/11.png.d", "out/11.png")]  # a directory cannot be read
    with pytest.raises(Exception):
        placing._written(plan(spark, tmp_path, *pairs).repartition(3), f"file://{tmp_path}/report", move)
    assert {k: v for k, v in files_of(tmp_path).items() if not k.startswith("report")} == before
    # the same report again, without what had failed; and an abort takes nothing of an earlier job away
    done = placing._written(plan(spark, tmp_path, *pairs[:3]), f"file://{tmp_path}/report", move)
    assert {r.outcome for r in done.collect()} == {"moved" if move else "copied"}
    with pytest.raises(Exception):
        placing._written(plan(spark, tmp_path, *pairs[5:]).repartition(3), f"file://{tmp_path}/report", move)
    assert set(files_of(tmp_path / "out")) == {"0.png", "1.png", "2.png", "3.png", "4.png"}


def test_split_is_materialised(spark, tmp_path):
    put(tmp_path, in__a_png=b"a", in__a_txt=b"1", in__b_png=b"b", in__b_txt=b"2", train__a_png=b"a")
    wanted = spark.createDataFrame([("a.png", "train"), ("a.txt", "train"), ("b.png", "holdout"), ("b.txt", "holdout")], "name string, split string")
    base = f"file://{tmp_path}/"
    rows = placing.copy_files(wanted.select(F.concat(F.lit(base + "in/"), "name").alias("source"), F.concat(F.lit(base), "split", F.lit("/"), "name").alias("target")))
    assert {k[1]: v for k, v in outcomes(rows, tmp_path).items()} == {"a.png": "same", "a.txt": "copied", "b.png": "copied", "b.txt": "copied"}
    present = rows.select(F.element_at(F.split("target", "/"), -1).alias("name"), "sha256")
    assert {r.action for r in splits.copy_plan(present, present).collect()} == {"skip"}
    assert set(files_of(tmp_path / "train")) == {"a.png", "a.txt"} and set(files_of(tmp_path / "holdout")) == {"b.png", "b.txt"}


def test_renumbering_in_place(spark, tmp_path):
    # 0001 is the name that the first file gets and that the second one has
    put(tmp_path, d__0000_png=b"first", d__0000_txt=b"f", d__0001_png=b"second", d__0001_txt=b"s", d__zz_jpg=b"third", d__zz_txt=b"t", d__keep_md=b"k")
    names = spark.createDataFrame([(n,) for n in os.listdir(tmp_path / "d")], "name string")
    base = f"file://{tmp_path}/d/"
    moves = layout.rename_map(names, start=1).select(F.concat(F.lit(base), "name").alias("source"), F.concat(F.lit(base), "new_name").alias("target"))
    assert {r.outcome for r in placing.move_files(moves).collect()} == {"moved"}
    assert files_of(tmp_path / "d") == {"0001.png": b"first", "0001.txt": b"f", "0002.png": b"second", "0002.txt": b"s", "0003.jpg": b"third", "0003.txt": b"t", "keep.md": b"k"}
    rows = plan(spark, tmp_path / "d", ("0001.png", "keep.md"), ("0002.png", "0002.png"), ("0003.jpg", "new.jpg"), ("gone", "x"))
    assert outcomes(placing.move_files(rows), tmp_path) == {("0001.png", "keep.md"): "conflict", ("0002.png", "0002.png"): "same", ("0003.jpg", "new.jpg"): "moved", ("gone", "x"): "no source"}
    left = files_of(tmp_path / "d")
    assert left["0001.png"] == b"first" and left["keep.md"] == b"k" and left["new.jpg"] == b"third" and len(left) == 7


def test_split_and_blind_copies_by_plan(spark, tmp_path):
    put(tmp_path, **{f"in__{n}_{e}": f"{n}{e}".encode() for n in "abc" for e in ("png", "txt")}, split__train__old_png=b"o")
    base = f"file://{tmp_path}"
    rows = spark.createDataFrame([(f"{base}/in/{n}.png", f"{base}/in/{n}.txt", "holdout" if n == "b" else "train") for n in "abc"], "image string, caption string, split string")
    assert {r.outcome for r in placing.copy_files(splits.placing_plan(rows, f"{base}/split/")).collect()} == {"copied"}
    assert set(files_of(tmp_path / "split")) == {"train/a.png", "train/a.txt", "train/c.png", "train/c.txt", "holdout/b.png", "holdout/b.txt", "train/old.png"}
    listing = lambda: splits.placed_errors(rows, tree.tree(spark, f"{base}/split"))
    assert [tuple(r) for r in listing().collect()] == [("train", "old.png", "not of the split")]
    (tmp_path / "split/train/old.png").rename(tmp_path / "old.png")
    (tmp_path / "split/holdout/b.txt").unlink()
    assert [tuple(r) for r in listing().collect()] == [("holdout", "b.txt", "missing")]
    records = spark.createDataFrame([("p", 1001, c, f"{base}/in/{f}.png") for c, f in (("base", "a"), ("lora", "b"))], "prompt_id string, seed int, condition string, output_path string")
    blind = evaluation.blinded_by_stream(records)
    assert {r.outcome for r in placing.copy_files(evaluation.blind_copies(blind, f"{base}/eval")).collect()} == {"copied"}
    label = {r.condition: r.blind_label for r in blind.collect()}
    assert files_of(tmp_path / "eval") == {f"images/pair-001_{label['base']}.png": b"apng", f"images/pair-001_{label['lora']}.png": b"bpng"}


@pytest.fixture
def objects(tmp_path):
    root = tmp_path / "data"
    put(root, **{f"12__i1__images__{k}_jpg": bytes([k]) for k in range(6)}, **{f"12__hidden__images__x{k}_jpg": bytes([k]) for k in range(4)}, **{"12__i1__other__y_jpg": b"y"})
    (root / "12/hidden").rename(root / "12/.hidden")
    (root / "7/empty/images").mkdir(parents=True)
    linked = root / "9/linked/images"
    linked.mkdir(parents=True)
    (linked / "0.jpg").write_bytes(b"0")
    for k in (1, 2):
        (linked / f"{k}.jpg").write_bytes(bytes([k]))
    (linked / "3.jpg").symlink_to(linked / "0.jpg")
    (root / "loop").symlink_to(root, target_is_directory=True)
    (root / "dead").symlink_to(root / "nowhere")
    return root


@pytest.mark.parametrize("reach", [1, 1000])
def test_a_tree_with_empty_directories_hidden_names_and_links(spark, objects, reach):
    rows = tree.tree(spark, f"file://{objects}", reach=reach).collect()
    by = {os.path.relpath(r.path, objects): r for r in rows}
    want = {os.path.relpath(os.path.join(d, n), objects) for d, dirs, names in os.walk(objects) for n in dirs + names}
    assert len(rows) == len(by) and set(by) == want
    assert by["7/empty/images"].kind == "directory" and by["12/.hidden/images/x0.jpg"].size == 1
    assert (by["loop"].kind, by["loop"].link, by["loop"].resolved) == ("directory", True, os.path.realpath(objects))
    assert (by["dead"].kind, by["dead"].link) == ("other", True)
    assert by["9/linked/images/3.jpg"].resolved == os.path.realpath(objects / "9/linked/images/0.jpg")
    with pytest.raises(NotADirectoryError):
        tree.tree(spark, f"{objects}/dead")


def test_selection_from_the_tree(spark, objects):
    entries = tree.tree(spark, str(objects))
    images = tree.images_of(entries)
    name = lambda p: os.path.relpath(p, objects)
    none = images.where("path is null").collect()
    assert [name(r.image_dir) for r in none] == ["7/empty/images"]  # seen, and too small
    counted = images.groupBy("image_dir").agg(F.count("path").alias("n")).where("n < 4").collect()
    assert [(name(r.image_dir), r.n) for r in counted] == [("7/empty/images", 0)]
    picks = selection.evenly_spaced(images.where("path is not null"), ["image_dir"], ["filename"])
    told = {name(r.image_dir): (r.n_picks, r.n_distinct, r.rejected) for r in tree.aliased(picks, ["image_dir"]).collect()}
    assert told == {"12/i1/images": (4, 4, False), "12/.hidden/images": (4, 4, False), "9/linked/images": (4, 3, True)}
