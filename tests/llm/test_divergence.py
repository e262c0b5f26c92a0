import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tesseral.llm import divergence, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, min_docs):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
        groups.add((lang, source))
    out = []
    utf8 = lambda s: s.encode()
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = [s for g, s in groups if g == lang]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def share(c, t):
            return 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept))

        p = {s: {t: share(counts[lang, s], t) for t in kept} for s in sources}
        q = {t: share(whole, t) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], utf8(x[1])))
                out += [(lang, s, part, i, v, r + 1) for r, (v, i) in enumerate(ranked) if part == "pair" or r < 50]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["Größe", "größe", "漢字", "ABC", "abc", "ＡＢ", "\U0001f600", "é"]
    rows = []
    for i in range(500):
        lang = rng.choice(["en", "en", "en", "de", "", None])
        source = "hot" if rng.random() < 1 / 3 else rng.choice([f"s{j}" for j in range(14)] + ["", None, "漢"])
        text = rng.choice(["", None]) if rng.random() < 0.05 else " -9_".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))
        rows.append((i % 50, text, lang, source))
    rows += [(None, "only few", "xx", s) for s in ("a", "b", "b")] + [(None, "", "lone", "one")] + rows[:40]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"CHUNK": 7, "SOURCES": 3, "HELD": 50, "BUCKET": 100}])
def test_equals_brute_force(spark, monkeypatch, documents, sizes):
    if sizes:  # tasks get the sizes with the functions
        for name, value in sizes.items():
            monkeypatch.setattr(divergence, name, value)
        cell, count = divergence._cell, divergence._counted
        chunk, held = sizes["CHUNK"], sizes["HELD"]

        def small_cell(rows):
            divergence.CHUNK = chunk
            try:
                return cell(rows)
            finally:
                divergence.CHUNK = 4096

        def small_count(batches):
            divergence.HELD = held
            yield from count(batches)
            divergence.HELD = 200_000

        monkeypatch.setattr(divergence, "_cell", small_cell)
        monkeypatch.setattr(divergence, "_counted", small_count)
    want = brute([r[1:] for r in documents], 12)
    got = rows_of(divergence.audit(spark.createDataFrame(documents, SCHEMA).selectExpr("*", "1 as n", "2 as term"), min_docs=12))
    assert got == want and {r[2] for r in want} == {"pair", "term"} and any(r[0] == "xx" and r[4] == 0 for r in want)


def test_no_documents_and_a_very_long_one(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert divergence.audit(none).collect() == []
    rows = [(1, "ab " * 300_000 + "漢" * 200_000, "en", "a"), (2, "ab 漢", "en", "b")]
    got = rows_of(divergence.audit(spark.createDataFrame(rows, SCHEMA), min_docs=1))
    assert got == brute([r[1:] for r in rows], 1)


def test_shares_are_exact_at_any_size():
    counts = np.array([0, 1, 10**6, 2**52, 2**53 - 7])
    for total in (2**53, 2**56, 2**62):
        assert divergence._shares(counts, total, 5).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 25) for c in counts]
    assert divergence._shares(np.array([7]), 7, 1).tolist() == [10**9 + 1]


def test_query_equals_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    df = queries.QUERIES["op13_source_divergence"](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(f"select {', '.join(columns)} from ({queries.ORACLES['op13_source_divergence']})").fetchall()
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(want) and len(want) > 1000
