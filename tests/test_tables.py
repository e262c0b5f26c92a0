import random

import pytest
from pyspark.sql import functions as F

from tesseral.functions import text
from tesseral.operators import annotators, batches, evaluation, identity, layout, metrics, ordering, selection, splits


def test_even_spacing_for_every_size(spark):
    rows = [(n, i) for n in range(1, 41) for i in range(n)]
    random.Random(1).shuffle(rows)
    picked = selection.evenly_spaced(spark.createDataFrame(rows, "g int, i int"), ["g"], ["i"]).collect()
    want = {(n, k, k * n // 4) for n in range(4, 41) for k in range(4)}
    assert {(r.g, r.pos, r.i) for r in picked} == want
    again = selection.evenly_spaced(spark.createDataFrame(rows, "g int, i int"), ["g"], ["i"], large_groups=True).collect()
    assert {(r.g, r.pos, r.i, r.group_size) for r in again} == {(n, k, i, n) for n, k, i in want}
    assert selection.short_groups(spark.createDataFrame(rows, "g int, i int"), ["g"]).count() == 3


def test_global_numbers_and_sums(spark):
    values = list(range(500))
    random.Random(2).shuffle(values)
    df = spark.createDataFrame([(v, v % 7) for v in values], "v int, w int").repartition(9)
    got = {r.v: (r.n, r.s) for r in ordering.running(ordering.numbered(df, ["v"], "n"), ["v"], "w", "s").collect()}
    assert got == {v: (v, sum(x % 7 for x in range(v))) for v in range(500)}
    assert ordering.numbered(df.limit(0), ["v"]).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("  a b  ", 12345, "x/y/pic.JPG")], "t string, n int, p string")
    r = df.select(text.strip(F.col("t")).alias("t"), text.padded(F.col("n"), 4).alias("n"), text.suffix(F.col("p")).alias("s"), text.stem(F.col("p")).alias("m"), text.relative_to(F.col("p"), "x").alias("r"), text.resolved(F.col("p"), "/b").alias("a")).first()
    assert tuple(r) == ("a b", "12345", ".jpg", "pic", "y/pic.JPG", "/b/x/y/pic.JPG")
    assert df.select(text.sha_key(F.col("t"), F.lit(None).cast("string"))).first()[0] is None
    wrapped = df.select(text.wrapped(F.lit("one two-three four extraordinarily"), 8).alias("w")).first().w
    assert wrapped == ["one", "two-three", "four", "extraordinarily"]


def test_path_keys(spark):
    df = spark.createDataFrame([("file:/r/12/a b/images/00.jpg",)], "path string")
    r = df.select(*(c.alias(k) for k, c in identity.path_keys(F.col("path"), "/r").items())).first()
    assert (r.obj_id, r.instance, r.instance_dir, r.filename) == ("12", "12/a b", "a b", "00.jpg")


def test_results_reach_all_requests_with_the_key(spark):
    requests = spark.createDataFrame([("k1", 1), ("k1", 2), ("k2", 3), ("k3", 4)], "key string, r int")
    results = spark.createDataFrame([("k1", 1, "old", None), ("k1", 2, "new", None), ("k3", 3, None, "bad"), ("zz", 4, "x", None)], "key string, ordinal int, response string, error string")
    got = sorted((r.key, r.r or 0, r.status, r.response) for r in batches.matched_results(requests, results).collect())
    assert got == [("k1", 1, "answered", "new"), ("k1", 2, "answered", "new"), ("k2", 3, "unanswered", None), ("k3", 4, "error", None), ("zz", 0, "unknown", "x")]
    jobs = lambda *s: batches.exit_code(spark.createDataFrame([(x,) for x in s], "state string")).first()[0]
    assert (jobs("JOB_STATE_SUCCEEDED"), jobs("JOB_STATE_RUNNING"), jobs("JOB_STATE_FAILED", "JOB_STATE_RUNNING")) == (0, 2, 1)


def test_response_text_and_payload(spark):
    df = spark.createDataFrame([('{"candidates":[{"content":{"parts":[{"text":"a"},{"x":1},{"text":"b"}]}}]}',), ('{"candidates":[]}',)], "r string")
    assert [r[0] for r in df.select(batches.response_text(F.col("r"))).collect()] == ["ab", None]
    body = df.limit(1).select(batches.payload(F.lit(bytearray(b"x" * 100)), F.lit("cup"), 'see "{category}"')).first()[0]
    import base64
    import json

    content = json.loads(body)["contents"][0]
    image, text = content["parts"]
    assert content["role"] == "user" and text["text"] == 'see "cup"' and base64.b64decode(image["inlineData"]["data"]) == b"x" * 100
    schema = {"$defs": {"A": {"type": "string", "title": "A"}}, "type": "object", "properties": {"title": {"$ref": "#/$defs/A"}}}
    body = df.limit(1).select(batches.payload(F.lit(b"x"), F.lit("cup"), "x", schema=schema)).first()[0]
    assert json.loads(body)["generationConfig"] == {
        "maxOutputTokens": 1024, "temperature": 0.0, "responseMimeType": "application/json", "thinkingConfig": {"thinkingBudget": 0},
        "responseSchema": {"type": "object", "properties": {"title": {"type": "string"}}},
    }


def test_split_keeps_groups_whole(spark):
    rows = [(f"g{i % 10}", i) for i in range(23)]
    df = spark.createDataFrame(rows, "g string, i int")
    for exact in (False, True):
        got = splits.split(df, "g", fraction=0.25, exact=exact)
        sides = got.groupBy("g").agg(F.countDistinct("split").alias("n"), F.first("split").alias("s")).collect()
        assert all(r.n == 1 for r in sides) and sum(r.s == "holdout" for r in sides) == 2
    assert [splits.holdout_size(n, 0.5) for n in (2, 3, 5)] == [1, 2, 2]
    with pytest.raises(ValueError):
        splits.holdout_size(5, 1.0)
    leaks = splits.leakage(spark.createDataFrame([("a", "train"), ("a", "holdout"), ("b", "train"), ("b", "train")], "h string, split string"), "h")
    assert [(r.h, r.n) for r in leaks.collect()] == [("a", 2)]
    with pytest.raises(ValueError, match="overlap"):
        splits.require_empty(leaks, "overlap")


def test_pair_files(spark):
    manifest = spark.createDataFrame([("a.png", "a.txt"), ("b.png", "c.txt"), ("d.jpg", "d.txt"), ("a.png", "a.txt")], "output_image string, output_caption string")
    files = spark.createDataFrame([(n,) for n in ("a.png", "a.txt", "b.png", "c.txt", "d.jpg")], "name string")
    got = {(r.stem, r.error) for r in splits.pair_errors(manifest, files).collect()}
    assert got == {("b", "image and caption stems differ"), ("d", "image and caption must be .png and .txt"), ("a", "stem is repeated"), ("d", "missing file d.txt")}
    plan = splits.copy_plan(spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "name string, sha256 string"), spark.createDataFrame([("y", "1"), ("z", "2"), ("w", "3")], "name string, sha256 string"))
    assert {(r.name, r.action) for r in plan.collect()} == {("x", "copy"), ("y", "skip"), ("z", "conflict"), ("w", "extra")}


def test_evaluation_pairs(spark):
    tagged = " ".join(evaluation.REQUIRED_TAGS)
    prompts = spark.createDataFrame([("p1", tagged), ("p2", "[FOUR-VIEWS]"), ("p1", tagged), ("p3", None)], "id string, prompt string")
    assert {r.id for r in evaluation.prompt_errors(prompts).collect()} == {"p1", "p2", "p3"}
    plan = evaluation.generation_plan(prompts.limit(1))
    assert [(r.seed, r.condition) for r in plan.orderBy("seed", "condition").collect()] == [(1001, "base"), (1001, "lora"), (1002, "base"), (1002, "lora")]
    assert evaluation.pair_errors(plan).count() == 0
    assert evaluation.pair_errors(plan.where("not (seed = 1001 and condition = 'lora')")).count() == 1
    differs = evaluation.pair_errors(plan.withColumn("width", F.when(F.col("condition") == "lora", 7).otherwise(8)))
    assert {r.error for r in differs.collect()} == {"controlled fields differ: width"}
    blind = evaluation.blinded(plan)
    card = evaluation.scorecard(blind)
    assert "condition" not in card.columns and card.count() == 4 and {r.blind_label for r in card.collect()} == {"A", "B"}
    assert evaluation.blind_key(blind).count() == 4
    assert set(evaluation.generation_records(plan, {"run": "r1"}).columns) >= {"run", "generator_device", "lora_fused"}


def test_layout_and_renaming(spark):
    files = spark.createDataFrame([(n,) for n in ("b.png", "b.txt", "a.JPG", "a.txt", "c.png", "0002.png")], "name string")
    mapping = layout.rename_map(files)
    assert {(r.name, r.new_name) for r in mapping.collect()} == {("a.JPG", "0001.jpg"), ("a.txt", "0001.txt"), ("b.png", "0002.png"), ("b.txt", "0002.txt")}
    assert [r.new_name for r in layout.rename_collisions(mapping, files).collect()] == ["0002.png"]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate([5, 9, 1, 7])], "i int, label_height int")
    got = {r.i: (r.row, r.col, r.x, r.y) for r in layout.grid(rows, "i", columns=2, tile=64).collect()}
    assert got == {0: (0, 0, 0, 0), 1: (0, 1, 64, 0), 2: (1, 0, 0, 73), 3: (1, 1, 64, 73)}
    assert layout.sheet_size(4, 2, 64, [5, 9, 1, 7]) == (128, 64 + 9 + 64 + 7)
    fit = spark.range(1).select(layout.contain(F.lit(100), F.lit(50), 64).alias("f")).first().f
    assert (fit.width, fit.height, fit.x, fit.y) == (64, 32, 0, 16)


def test_metrics(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "g string, p string")
    assert metrics.macro_f1(rows, "g", "p").first().macro_f1 == pytest.approx((2 / 3 + 0.5 + 0) / 3)
    assert metrics.tuple_accuracy(rows, [("g", "p")]).first().exact_accuracy == 0.5
    claims = spark.createDataFrame([(["x", "y"], ["x", "z"])], "g array<string>, p array<string>")
    assert tuple(metrics.claims(claims, "g", "p").first()) == (0.5, 0.5, 2.0, 0.5)
    scored = spark.createDataFrame([(i, i / 100, int(i >= 20)) for i in range(100)], "i int, c double, y int")
    at = metrics.calibrated_threshold(scored, "c", "y", precision=0.9, coverage=0.5).first()
    assert at.c <= 0.3 and at.lower >= 0.9
    assert metrics.stratified(scored.withColumn("s", F.col("i") % 4), "s", "i", 0.4).count() == 40
    low, high, mean = metrics.bootstrap(scored, "i", "y", resamples=100).first()
    assert low < 0.8 < high and mean == pytest.approx(0.8, abs=0.03)
    ps = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "t string, p double")
    assert {r.t: round(r.adjusted, 9) for r in metrics.holm(ps, "t", "p").collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}
    gated = metrics.decide(scored.agg(F.avg("y").alias("m")), {"enough": F.col("m") > 0.5, "perfect": F.col("m") == 1}).first()
    assert (gated.enough, gated.perfect, gated.passed) == (True, False, False)
    assert metrics.select_model(ps, [F.col("p") > 0.02], [F.col("p")]).first().t == "c"
    kept = metrics.without_benchmark(claims, "p", spark.createDataFrame([("q",)], "h string"), "h")
    assert kept.count() == 1 and metrics.without_benchmark(claims, "p", spark.createDataFrame([("z",)], "h string"), "h").count() == 0
    assert metrics.repeats(ps, "t").count() == 9 and metrics.valid_rate(ps, F.col("p") < 0.035).first().valid_rate == pytest.approx(2 / 3)


def test_annotators_are_called_for_misses_only(spark):
    rows = spark.createDataFrame([("k1", "c1", "cup"), ("k2", "c2", "bad"), ("k3", "c3", "pot")], "cache_key string, composite_sha256 string, category string")
    cache = spark.createDataFrame([("k1", "kept")], "cache_key string, raw_response_text string")

    def factory():
        def call(composite, category):
            if category == "bad":
                raise ValueError("no answer")
            return f"{category}:{composite}"

        return call

    got = {r.cache_key: (r.raw_response_text, r.cached) for r in annotators.memoised(rows, cache, lambda m: annotators.annotate(m, factory)).collect()}
    assert got == {"k1": ("kept", True), "k2": (None, False), "k3": ("pot:c3", False)}
    assert annotators.recorded(rows, cache).where("error is null").count() == 1


def test_usage_levels_and_positions(spark):
    calls = spark.createDataFrame([("a", 100, 10), ("a", None, 30), ("b", 5, 5)], "model string, tokens_in int, tokens_out int")
    got = {r.model: (r.calls, r.tokens_in, r.tokens_out, round(r.cost, 9), round(r.cost_per_call, 9)) for r in metrics.usage_report(calls, ["model"], {"tokens_in": 2.0, "tokens_out": 10.0}).collect()}
    assert got == {"a": (2, 100, 40, 0.0006, 0.0003), "b": (1, 5, 5, 0.00006, 0.00006)}
    rows = spark.range(400).selectExpr("id % 10 as p", "id div 10 % 8 as s", "cast(id % 10 as double) as v")
    flat, deep = metrics.bootstrap(rows, "p", "v").first(), metrics.bootstrap(rows, ["p", "s"], "v").first()
    assert flat.low < 4.5 < flat.high and deep.low < 4.5 < deep.high
    left, right = spark.createDataFrame([("b",), ("a",), ("c",)], "x string"), spark.createDataFrame([(2,), (1,)], "y int")
    assert [(r.ordinal, r.x, r.y) for r in ordering.zipped(left, ["x"], right, ["y"]).orderBy("ordinal").collect()] == [(0, "a", 1), (1, "b", 2), (2, "c", None)]
