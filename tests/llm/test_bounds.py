"""Bounds of broadcasts lowered to nothing, and very long texts."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tesseral.llm import exact_dedup, licenses, line_dedup, mixing, near_dedup, packing, quality, queries, secrets, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize(
    "name,module,bound",
    [
        ("op1_best_fit_packing", packing, "BROADCAST_RUNS"),
        ("op2_quality_rules", quality, "BROADCAST_LINES"),
        ("op6_minhash_near_dedup", near_dedup, "BROADCAST_ROWS"),
        ("op7_license_scan", licenses, "BROADCAST_WORDS"),
        ("op12_secret_scan", secrets, "BROADCAST_BLOBS"),
    ],
)
def test_same_rows_without_broadcasts(spark, monkeypatch, name, module, bound):
    run = lambda: sorted(map(str, queries.QUERIES[name](spark, SF).drop("sequence_id", "offset").collect()))
    before = run()
    assert getattr(module, bound) > 0
    monkeypatch.setattr(module, bound, -1)
    assert run() == before and before


def long_docs(spark):
    words = " ".join(f"w{i % 997}x{i % 89}" for i in range(150_000))
    lines = "\n".join(f"line {i} has its own words {i * 7} and {i * 13}" for i in range(20_000))
    blank = "a" + " \t" * 300_000 + "b"
    rows = [(1, words, "en", "s", 1), (2, lines, "en", "s", 1), (3, blank, "de", "s", 1), (4, words, "en", "t", 1), (5, "short text", "en", "t", 1)]
    return spark.createDataFrame(rows, DOCS), {r[0]: r[1] for r in rows}


def test_very_long_texts(spark):
    docs, texts = long_docs(spark)
    got = {r.doc_id: r for r in exact_dedup.dedupe(docs).collect()}
    assert {i: (r.keep_id, r.group_size) for i, r in got.items()} == {1: (1, 2), 2: (2, 1), 3: (3, 1), 4: (1, 2), 5: (5, 1)}
    assert got[3].text_sha256 == hashlib.sha256(b"a b").hexdigest()
    got = {r.doc_id: r for r in line_dedup.dedupe(docs).collect()}
    assert {i: (r.n_lines, r.n_removed) for i, r in got.items()} == {1: (1, 0), 2: (20_000, 0), 3: (1, 0), 4: (1, 0), 5: (1, 0)}
    doubled = docs.where("doc_id = 2").withColumn("text", F.concat("text", F.lit("\n"), "text"))
    [r] = line_dedup.dedupe(doubled).collect()
    assert (r.n_lines, r.n_removed, r.clean_text) == (40_000, 20_000, texts[2])
    licence = "under the MIT license"
    got = licenses.scan(docs.withColumn("text", F.concat("text", F.lit(f" {licence}")))).collect()
    for r in got:
        n = len(re.findall("[a-zA-Z0-9]+", texts[r.doc_id]))
        assert (r.n_words, r.n_base, r.first_word, r.base_labels) == (n + 4, 1, n, "mit")
    copies = {r.doc_id for r in mixing.mix(docs, {"s": 1.0, "t": 1.0}, total=20 * sum(map(len, texts.values()))).collect()}
    assert copies == set(texts)
    assert {r.doc_id: r.class_id for r in near_dedup.dedupe(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 5}


def test_toxicity_of_very_long_texts(spark):
    mild, bad = "calm words about quiet gardens and rivers ", "grobwurst schnurz vileword nastyword "
    rows = [(i, (bad if i % 2 else mild) * 5, "en", "s", 1) for i in range(80)]
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.fit(docs.select("doc_id", "text"), docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))
    long = spark.createDataFrame([(1, mild * 20_000, "en", "s", 1), (2, mild * 10_000 + bad * 10_000, "en", "s", 1), (3, "", "en", "s", 1)], DOCS)
    got = {r.doc_id: r for r in toxicity.score(long.select("doc_id", "text"), model).collect()}
    assert got[2].predicted == 1 and got[2].score > got[1].score and all(0 <= r.score <= 1 for r in got.values())


def test_pipeline_of_very_long_texts(spark, tmp_path):
    import corpus_pipeline

    docs, _ = long_docs(spark)
    docs.where("doc_id <> 3").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {1, 2} and max(r.length for r in got) == packing.CONTEXT
    for key in {(r.doc_id, r.sequence_id) for r in got}:
        assert all(r.offset + r.length <= packing.CONTEXT for r in got if (r.doc_id, r.sequence_id) == key)
