import random
import re

import numpy as np
import pytest

from tesseral.llm import near_dedup

SCHEMA = "doc_id long, text string, kept string"


def shingle_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)), tuple(words)


def brute(rows):
    sets = {}
    for i, t in rows:
        s = shingle_set(t)
        words = s[1] if isinstance(s, tuple) else s
        sets[i] = (s[0] if isinstance(s, tuple) else s, words)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i][0], sets[j][0]
            shared = len(a & b)
            if sets[i][1] == sets[j][1] or (shared and shared >= 0.8 * (len(a) + len(b) - shared)):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in ids}


def made(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    rows, n = [], 0
    for size in (1, 1, 1, 2, 2, 3, 5, 40):
        for _ in range(3):
            base = rng.choices(vocabulary, k=rng.randint(60, 200))
            for c in range(size):
                words = list(base)
                for _ in range(rng.randint(0, len(words) // 50) if c else 0):
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
                rows.append((n, " ".join(words)))
                n += 1
    common = " ".join(rng.choices(vocabulary, k=50))
    for _ in range(20):
        rows.append((n, common + "\n" + " ".join(rng.choices(vocabulary, k=60))))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "Same few words"), (n + 4, "same  few\nwords"), (n + 5, "one"), (n + 6, "same few")]
    rng.shuffle(rows)
    return rows


def test_classes_equal_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA).repartition(5)
    got = near_dedup.dedupe(docs).collect()
    want = brute(rows)
    assert {r.doc_id: r.class_id for r in got} == want
    assert {r.doc_id for r in got if r.kept} == set(want.values())
    assert len(near_dedup.keep_one(docs).collect()) == len(set(want.values()))


def test_nulls_repeats_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text, ""), (None, text, ""), (5, text + " more", ""), (5, text + " more", ""), (6, text + " tail", "")]
    got = near_dedup.dedupe(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5 and len({r.class_id for r in got}) == 1
    assert near_dedup.dedupe(spark.createDataFrame([], SCHEMA)).collect() == []


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    for shared in (0.5, 0.8, 0.95):
        n = 1000
        a = rng.integers(1, 1 << 62, n)
        b = a.copy()
        swap = int(n * (1 - shared) / (1 + shared))
        b[:swap] = rng.integers(1, 1 << 62, swap)
        sig = near_dedup.signatures(np.concatenate([a, b]).view(np.uint64), np.array([0, n, 2 * n]), 2048)
        true = (n - swap) / (n + swap)
        assert abs((sig[0] == sig[1]).mean() - true) < 0.04


def test_weights_count():
    a = np.repeat(np.arange(1, 11), [1] * 9 + [50]).astype(np.uint64)
    b = np.repeat(np.array([*range(101, 110), 10]), [1] * 9 + [50]).astype(np.uint64)
    sig = near_dedup.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 2048)
    w = 1 + np.log(50)
    assert (sig[0] == sig[1]).mean() == pytest.approx(w / (w + 18), abs=0.04)


def test_empty_texts_have_empty_signatures():
    sig = near_dedup.signatures(np.array([7], np.uint64), np.array([0, 0, 1, 1]), 8)
    assert sig.tolist() == [[0] * 8, [7] * 8, [0] * 8]


def test_a_passage_repeated_in_one_copy_only(spark):
    rng = random.Random(4)
    rows = []
    for i in range(12):
        words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
        rows += [(2 * i, " ".join(words), ""), (2 * i + 1, " ".join(words[:90] * 100 + words[90:]), "")]
    got = near_dedup.dedupe(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: i - i % 2 for i in range(24)}


def test_a_document_with_two_texts(spark):
    rng = random.Random(6)
    a, b = (" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(80)) for _ in range(2))
    docs = spark.createDataFrame([(3, b, ""), (5, a, ""), (5, b, ""), (7, a, "")], SCHEMA)
    got = {(r.doc_id, r.text): (r.class_id, r.kept) for r in near_dedup.dedupe(docs).collect()}
    assert got == {(3, b): (3, True), (5, b): (3, False), (5, a): (5, True), (7, a): (5, False)}
    assert sorted((r.doc_id, r.text) for r in near_dedup.keep_one(docs).collect()) == sorted([(3, b), (5, a)])


def test_links_of_weighted_texts_are_found(spark):
    """Pairs just above the similarity, one of which repeats a part of its shingles many times."""
    rng = random.Random(7)
    rows = []
    for i in range(120):
        words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(204)]
        other = list(words)
        other[-19:] = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(19)]
        part = (80, 40)[i % 2]
        other = other[:part] * (3, 6, 20)[i % 3] + other
        rows += [(2 * i, " ".join(words), ""), (2 * i + 1, " ".join(other), "")]
    links = [shared >= 0.8 * (len(x) + len(y) - shared) for x, y in ((shingle_set(rows[2 * i][1])[0], shingle_set(rows[2 * i + 1][1])[0]) for i in range(120)) for shared in [len(x & y)]]
    assert sum(links) > 100
    found = {r.doc_id: r.class_id for r in near_dedup.dedupe(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    lost = [i for i, link in enumerate(links) if link and found[2 * i] != found[2 * i + 1]]
    assert len(lost) <= 0.01 * sum(links), lost


def test_bounds_keep_every_link():
    """Sets at any similarity: the parities never tell them further apart than they are."""
    rng = np.random.default_rng(3)
    for n, other in ((50, 5), (300, 40), (3000, 900), (1, 0), (40, 40)):
        a = rng.integers(1, 1 << 62, n).astype(np.uint64)
        b = np.concatenate([a[other:], rng.integers(1, 1 << 62, other).astype(np.uint64)])
        odd = near_dedup.parities(np.concatenate([a, b]), np.array([0, n, 2 * n])).view(np.uint64)
        bits = sum(int(x ^ y).bit_count() for x, y in zip(*odd.tolist()))
        assert bits <= 2 * other and (n > 1000 or bits >= 1.6 * other)


def test_a_very_long_text_and_ties(spark):
    long = " ".join(f"w{i % 977} x{i}" for i in range(60_000))
    rows = [(1, long, ""), (2, long + " end", ""), (2, long + " end", ""), (9, "short", ""), (8, "short", ""), (8, "SHORT ", "")]
    got = near_dedup.dedupe(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.class_id, r.kept) for r in got) == [(1, 1, True), (2, 1, False), (2, 1, False), (8, 8, True), (8, 8, True), (9, 8, False)]
