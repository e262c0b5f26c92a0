"""Quality rules, exact deduplication, mixing and the whole pipeline against brute force."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tesseral.llm import exact_dedup, licenses, line_dedup, mixing, near_dedup, packing, pii, quality

SPACE = "[\x20\x09-\x0d]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def brute_base(text):
    own = words(text)
    windows = defaultdict(list)
    for i in range(len(own) - 7):
        windows[tuple(own[i : i + 8])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def norm(line):
    return re.sub(SPACE, " ", line.lower()).strip(" ")


def brute_quality(rows, min_docs, percent, depleted):
    """(kept, clean text) of each (doc_id, text, source)."""
    texts, hosts, lines = defaultdict(set), defaultdict(set), defaultdict(set)
    with_line = defaultdict(set)
    for _, t, s in rows:
        own = {norm(x) for x in (t or "").split("\n") if words(x)}
        texts[s].add(t or "")
        for x in own:
            with_line[s, x].add(t or "")
        for k in range(0, 60, 12):  # near copies count once, in most of five ways to tell them
            group = min((hashlib.sha256(x.encode()).hexdigest()[k : k + 12] for x in own), default="")
            hosts[s, k].add(group)
            for x in own:
                lines[s, x, k].add(group)

    def above(some, every, least):
        return len(some) >= least and 100 * len(some) > percent * len(every)

    common = {(s, x) for (s, x), ts in with_line.items() if above(ts, texts[s], min_docs) and sum(above(lines[s, x, k], hosts[s, k], min(min_docs, 3)) for k in range(0, 60, 12)) >= 3}
    out = []
    for _, t, s in rows:
        n, _, _, _, rep = brute_base(t)
        own = (t or "").split("\n")
        gone = [bool(words(x)) and (s, norm(x)) in common for x in own]
        lost = sum(len(words(x)) for x, g in zip(own, gone) if g)
        kept = not (n < 20 or 100 * rep > 30 * n) and not 100 * lost > depleted * n
        out.append((kept, "\n".join(x for x, g in zip(own, gone) if not g) if any(gone) else t))
    return out


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


def made(seed=3, n=70):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lines = [prose(rng, rng.randint(3, 25)) for _ in range(rng.randint(1, 5))]
        if i % 2:
            lines.insert(0, " Shared  HEADER line of this host")
        if i % 10 == 3:
            lines = ["shared header line of this host"] * 6
        if i % 10 == 7:
            lines.append(lines[-1] + " " + lines[-1])
        rows.append((i, "\n".join(lines), ["a", "b", None][i % 3 if i % 2 else 0]))
    rows += [(n, None, "a"), (n + 1, "", "a"), (None, rows[0][1], "a"), (5, rows[5][1], rows[5][2])]
    return rows


def test_quality_equals_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], DOCS).withColumn("kept", F.lit("clash")).repartition(3)
    got = quality.judge(docs, min_docs=5, percent=5).collect()
    want = Counter()
    for (i, t, s), verdict in zip(rows, brute_quality(rows, 5, 5, quality.DEPLETED_PERCENT)):
        want[(i, s, *brute_base(t), *verdict)] += 1
    assert Counter((r.doc_id, r.source, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.kept, r.clean_text) for r in got) == want
    assert any(r.n_common_words for r in got) and len({r.kept for r in got}) == 2
    assert quality.judge(docs.limit(0)).collect() == []


def test_copies_do_not_make_lines_common(spark):
    text = prose(random.Random(1), 60)
    docs = spark.createDataFrame([(i, text, "en", "a", 1) for i in range(100)], DOCS)
    assert all(r.kept and r.n_common_words == 0 for r in quality.judge(docs).collect())


@pytest.mark.parametrize("hot", [3, 10_000])
def test_exact_dedup_equals_brute_force(spark, hot):
    rng = random.Random(4)
    pool = ["a b", "a  b", "a\t\nb", " a b", "", None, "   ", "é" * 50, "é" * 50 + "x", "z" * 100_000]
    rows = [(rng.choice([None, *range(300)]), rng.choice(pool), "clash") for _ in range(200)] + [(7, "same", ""), (7, "same", ""), (None, "only null", ""), (None, "only null", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(5)
    got = exact_dedup.dedupe(docs, hot_copies=hot).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(SPACE, " ", t or "")].append(i)
    assert len(got) == len(rows)
    kept = Counter()
    for r in got:
        key = re.sub(SPACE, " ", r.text or "")
        first = min((i for i in groups[key] if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.text_sha256) == (first, len(groups[key]), hashlib.sha256(key.encode()).hexdigest())
        if r.kept:
            assert r.doc_id == first
            kept[key] += 1
    assert kept == Counter(dict.fromkeys(groups, 1))
    assert exact_dedup.dedupe(docs.limit(0)).collect() == []


def drawn_by(doc_id, text, source):
    return str(doc_id) if doc_id is not None else hashlib.sha256(f"{'-' if source is None else source}\n{text or ''}".encode()).hexdigest()


def poisson(rate, drawn, seed=mixing.SEED):
    u = int(hashlib.md5(f"{seed}-count\n{drawn}".encode()).hexdigest()[:13], 16) / 16**13
    k, p, total = 0, math.exp(-rate), math.exp(-rate)
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def brute_copies(rows, weights=None):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(t or "")
    w = {s: math.sqrt(n) if weights is None else weights.get(s, 0) for s, n in size.items()}
    total, all_w = sum(size.values()), sum(w.values())
    return [poisson(1.0 if not size[s] else w[s] * total / all_w / size[s], drawn_by(i, t, s)) if not size[s] or w[s] else 0 for i, t, s in rows]


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0}])
def test_mixing_equals_brute_force(spark, weights):
    rows = [(i, "x" * (i % 50), "a" if i % 3 else "b") for i in range(300)] + [(None, "xyz", None), (900, None, "empty"), (5, "x" * 5, "a")]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], DOCS).repartition(4)
    got = mixing.mix(docs, weights).collect()
    want = Counter()
    for (i, t, s), n in zip(rows, brute_copies(rows, weights)):
        want.update((i, s, k) for k in range(n))
    assert Counter((r.doc_id, r.source, r.mix_copy) for r in got) == want
    keys = [r.mix_key for r in got]
    assert keys == sorted(keys)
    assert mixing.mix(docs.limit(0)).collect() == []


def test_large_rates_invert(spark):
    rows = spark.createDataFrame([(900.0,), (0.0,), (2.5,)], "rate double").select("rate", mixing.cumulated(F.col("rate")).alias("c")).collect()
    by = {r.rate: r.c for r in rows}
    assert by[0.0] == [1.0] and by[900.0][-1] == pytest.approx(1, abs=1e-9)
    began = time.perf_counter()
    (big,) = spark.createDataFrame([(1e6,)], "rate double").select(mixing.cumulated(F.col("rate")).alias("c")).first()
    assert time.perf_counter() - began < 5 and len(big) == 2 * (12 * 1000 + 24) + 1 and big[-1] == 1
    assert big[12 * 1000 + 24] == pytest.approx(0.5 + 2 / 3 / math.sqrt(2 * math.pi * 1e6), abs=1e-7)
    assert by[2.5][3] == pytest.approx(sum(math.exp(-2.5) * 2.5**k / math.factorial(k) for k in range(4)))
    with pytest.raises(ValueError):
        mixing.rates(spark.createDataFrame([], DOCS), {"a": -1.0})


def test_high_rates_replicate(spark):
    docs = spark.createDataFrame([(i, "x", "en", "small", 1) for i in range(40)] + [(99, "x" * 400_000, "en", "large", 1)], DOCS)
    got = Counter(r.doc_id for r in mixing.mix(docs, {"small": 1.0, "large": 1.0}).collect())
    assert {i: got[i] for i in range(40)} == {i: poisson_from_mode(200_020 / 40, i) for i in range(40)}


def poisson_from_mode(rate, doc_id):
    u = int(hashlib.md5(f"{mixing.SEED}-count\n{doc_id}".encode()).hexdigest()[:13], 16) / 16**13
    total, k = 0.0, 0
    while (total := total + math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))) <= u:
        k += 1
    return k


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    rows = [(i, t, s or "c") for i, t, s in made(5, 40) if i is not None]
    rows = list({i: (i, t, s) for i, t, s in rows}.values())
    base = prose(rng, 120).split()
    for k in range(4):
        own = list(base)
        own[10 * k + 5] = "edited"
        rows.append((500 + k, " ".join(own), "a"))
    rows += [(600, rows[-1][1].replace(" ", "  ", 3), "b"), (601, rows[-2][1], "a")]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    good = [(i, c, s) for (i, _, s), (kept, c) in zip(rows, brute_quality(rows, quality.COMMON_DOCS, quality.COMMON_PERCENT, quality.DEPLETED_PERCENT)) if kept]
    first = {}
    for i, t, s in sorted(good):
        first.setdefault(re.sub(SPACE, " ", t or ""), (i, t, s))
    sets = {i: {tuple(words(t.lower())[k : k + 5]) for k in range(len(words(t)) - 4)} for i, t, s in first.values()}
    parent = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                lo, hi = sorted((parent[i], parent[j]))
                parent = {k: lo if v == hi else v for k, v in parent.items()}
    unique = [(i, t, s) for i, t, s in first.values() if parent[i] == i]
    assert len(unique) < len(first) < len(good) < len(rows)
    want = Counter()
    for (i, t, s), n in zip(unique, brute_copies(unique)):
        tokens = len(packing.encode(t, packing._words(packing.default_tokenizer()))) // 4 + 1
        want[i] += n * -(-tokens // packing.CONTEXT)
    assert got == +want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_duplicates", "near_duplicates", "source_mixing", "best_fit_packing"]


def test_near_copies_do_not_make_lines_common(spark):
    rng = random.Random(2)
    lines = [prose(rng, 12) for _ in range(8)]
    rows = []
    for i in range(300):  # a hot host: a family of 60 near copies, and lines in 2, 6 and 9 % of the documents
        own = list(lines) if i % 5 == 0 else [prose(rng, 12) for _ in range(8)]
        own[-1] = prose(rng, 12)
        for step, name in ((50, "two"), (16, "six"), (11, "nine")):
            if i % step == 1:
                own.insert(1 + i % 7, f"the line in {name} hundredths of the documents")
        rows.append((i, "\n".join(own), "en", "a", 1))
    got = quality.judge(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r.kept for r in got)
    left = Counter(x for r in got for x in set(r.clean_text.split("\n")))
    assert all(left[x] == 60 for x in lines[:7])
    assert left["the line in two hundredths of the documents"] == 6
    assert not left["the line in six hundredths of the documents"] and not left["the line in nine hundredths of the documents"]
    assert {r.n_common_words for r in got} == {0, 8, 16}


def test_boilerplate_goes_whatever_stands_beside_it(spark):
    rng = random.Random(12)
    head, foot = [prose(rng, 9) for _ in range(3)], [prose(rng, 9) for _ in range(2)]
    bodies = [[prose(rng, 15) for _ in range(4)] for _ in range(40)]
    rows = [(i, "\n".join(head + own + foot), "en", "a", 1) for i, own in enumerate(bodies)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i].clean_text == "\n".join(own) and got[i].kept and got[i].n_common_words == 45 for i, own in enumerate(bodies))
    # four lines that all have, and an identifier: nothing else is left
    four = [prose(rng, n) for n in (12, 11, 11, 11)]
    rows = [(i, "\n".join(four + [f"document {i}"]), "en", "a", 1) for i in range(40)]
    got = quality.judge(spark.createDataFrame(rows, DOCS)).collect()
    assert not any(r.kept for r in got) and {r.n_common_words for r in got} == {45} and not any(r.base_failed for r in got)


def test_working_names_are_free(spark):
    names = ["__text", "__t1", "__lines", "__h", "__id", "__sha", "__k0", "__n", "__u", "first", "k0"]
    docs = spark.createDataFrame([(i, f"some words of text {i % 2} " * 9, "en", "a", 1) for i in range(4)], DOCS).withColumns({c: F.lit(c) for c in names})
    for run in (quality.judge, exact_dedup.dedupe, mixing.mix, near_dedup.dedupe, near_dedup.keep_one, line_dedup.dedupe, licenses.scan, pii.find, pii.sanitise):
        got = run(docs).collect()
        assert got and all(r[c] == c for r in got for c in names), run


def test_pipeline_of_nothing_and_of_null_ids(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    rng = random.Random(4)
    rows = [(None, prose(rng, 200), "en", None, None) for _ in range(3)] + [(None, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    # the empty document goes, the others differ and are drawn one by one; all are of one source, so the rate is 1
    pieces = Counter()
    for _, t, *_ in rows[:3]:
        tokens = len(packing.encode(t, packing._words(packing.default_tokenizer()))) // 4 + 1
        pieces[tokens] += poisson(1.0, drawn_by(None, t, None))
    assert all(r.doc_id is None and r.piece == 0 for r in got) and Counter(r.length for r in got) == +pieces and pieces.total() > 0


def test_documents_without_id_are_drawn_one_by_one(spark):
    rows = [(None, f"text {i}", "en", "ab"[i % 2], 1) for i in range(500)]
    for seed in ("mix-1", "mix-2", "mix-3"):
        got = mixing.mix(spark.createDataFrame(rows, DOCS), seed=seed).collect()
        assert 400 < len(got) < 600 and len({r.mix_key for r in got}) == len(got)
    doubled = mixing.mix(spark.createDataFrame(rows, DOCS), {"a": 1.0}, total=4 * sum(len(r[1]) for r in rows if r[3] == "a")).count()
    assert 850 < doubled < 1150


def test_quality_of_a_very_long_text(spark):
    own = [f"w{i}" for i in range(200_000)]
    text = "\n".join(" ".join(own[i : i + 50]) for i in range(0, len(own), 50)) + "\n" + " ".join(own[:40])
    (r,) = quality.judge(spark.createDataFrame([(1, text, "en", "a", 1)], DOCS)).collect()
    assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words, r.kept, r.clean_text) == (200_040, sum(map(len, own + own[:40])), 0, 80, True, text)
