import math
import random
import re
import zlib

import numpy as np
import pytest

from tesseral.llm import toxicity

DOCS = "doc_id long, text string, score string, lang string"


def made(n=240):
    rng = random.Random(4)
    syllables = ["an", "re", "th", "on", "in", "ly", "ou", "er", "st", "ea"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(20, 150))]
        toxic = i % 3 == 0
        if toxic:
            for w in rng.choices(["blockhead", "nitwitted", "pigbrained"], k=3):
                words[rng.randrange(len(words))] = w
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = made()
    extra = [(9001, None, 0), (9002, "", 0), (None, "blockhead", 1), (9003, "an re nitwittedd on th " * 30, None), (9003, "an re nitwittedd on th " * 30, None)]
    docs = spark.createDataFrame([(i, t, "clash", "en") for i, t, _ in rows + extra], DOCS).repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows + extra if y is not None], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out()).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: y for i, _, y in rows}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id in truth:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    by = {r.doc_id: r for r in got}
    assert by[9001].score == by[9002].score < 0.5
    assert by[9003].predicted == 1  # an unseen misspelling


def test_no_labels_and_empty_table(spark):
    model = toxicity.train([], [])
    docs = spark.createDataFrame([], DOCS)
    assert toxicity.score(docs, model).collect() == []
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels).bucket_scores().shape == (toxicity.BUCKETS,)


def test_grams_stay_inside_words():
    bucket, owner = toxicity.bags(["abc", "abcdef"])
    assert np.bincount(owner).tolist() == [1 + 2 + 1, 1 + 5 + 4]
    single, _ = toxicity.bags(["abcdef"])
    assert set(single) == set(bucket[owner == 1])


def grams(word, buckets):
    """Buckets of a word's n-grams and of the word itself, number by number."""
    full, most = 1 << 64, (1 << 64) - 1
    points = [ord(c) for c in f"<{word}>"]

    def mix(x):
        x = (x ^ (x >> 31)) * 0x9E3779B97F4A7C15 & most
        return x ^ (x >> 29)

    found = [mix(sum(mix((p * 0x100000001B3 + i) & most) for i, p in enumerate(points)) % full)]
    for n in toxicity.NGRAMS:
        for i in range(len(points) - n + 1):
            h = n
            for p in points[i : i + n]:
                h = (h * 0x5851F42D4C957F2D + p) & most
            found.append(mix(h))
    return [h % buckets for h in found]


def passages(text, buckets):
    words = re.findall(r"[^\W_]+", text.lower())
    return [[grams(w, buckets) for w in words[i : i + toxicity.PASSAGE]] for i in range(0, len(words), toxicity.PASSAGE)]


def probability(passage, emb, w, bias):
    score = sum(sum(sum(e * (w[d][1] - w[d][0]) for d, e in enumerate(emb[b])) for b in word) / len(word) for word in passage) / len(passage)
    return 1 / (1 + math.exp(-(score + bias[1] - bias[0])))


def plain_train(texts, labels, buckets, steps, seed):
    """The joint training written out: loss, chain rule and Adam, parameter by parameter."""
    rng = np.random.default_rng(seed)
    emb = ((rng.random((buckets, toxicity.DIMENSIONS)) - 0.5) / toxicity.DIMENSIONS).tolist()
    w = (rng.random((toxicity.DIMENSIONS, 2)) - 0.5).tolist()
    bias = [0.0, toxicity.START_BIAS]
    data = [(y, p) for y, p in zip(labels, (passages(t, buckets) for t in texts)) if p]
    part = {k: 0.5 / max(1, sum(y == k for y, _ in data)) for k in (0, 1)}
    m = [np.zeros((buckets, toxicity.DIMENSIONS)), np.zeros((toxicity.DIMENSIONS, 2)), np.zeros(2)]
    v = [x.copy() for x in m]
    for step in range(1, steps + 1):
        g = [np.zeros_like(x) for x in m]
        for y, parts in data:
            ps = [probability(p, emb, w, bias) for p in parts]
            clean = math.prod(1 - p for p in ps)
            for p, words in zip(ps, parts):
                # the loss is -ln(1 - clean) of a toxic text, -ln(clean) of another
                d = part[y] * p * (-clean / (1 - clean) if y else 1.0)
                g[2] += [-d, d]
                for word in words:
                    for b in word:
                        for k in range(toxicity.DIMENSIONS):
                            each = d / len(words) / len(word)
                            g[0][b, k] += each * (w[k][1] - w[k][0])
                            g[1][k] += [-each * emb[b][k], each * emb[b][k]]
        rate = toxicity.RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        new = []
        for i, (value, own) in enumerate(((emb, rate), (w, rate), (bias, toxicity.BIAS_RATE))):
            m[i] = 0.9 * m[i] + 0.1 * g[i]
            v[i] = 0.99 * v[i] + 0.01 * g[i] ** 2
            size = np.sqrt(v[i] / (1 - 0.99**step))
            new.append((np.array(value) - own / (1 - 0.9**step) * m[i] / (size + toxicity.FLOOR * size.max() + 1e-12)).tolist())
        emb, w, bias = new
    return emb, w, bias


def test_training_and_scoring_equal_plain_loops():
    rows = [(t, y) for _, t, y in made(12)]
    texts, labels = [" ".join(t.split()[:14]) for t, _ in rows] + ["", "x"], [y for _, y in rows] + [1, 0]
    buckets, steps = 64, 5
    emb, w, bias = plain_train(texts, labels, buckets, steps, 3)
    model = toxicity.train(texts, labels, buckets=buckets, steps=steps, seed=3)
    assert np.allclose(model.embeddings, emb, atol=1e-5) and np.allclose(model.weights, w, atol=1e-5) and np.allclose(model.bias, bias, atol=1e-6)
    mine = toxicity.score_texts(texts, model.bucket_scores().astype(float), float(model.bias[1] - model.bias[0]), {})
    for t, s in zip(texts, mine):
        none = 1 / (1 + math.exp(-(model.bias[1] - model.bias[0])))
        clean = [1 - probability(p, model.embeddings.astype(float), model.weights.astype(float), model.bias.astype(float)) for p in passages(t, buckets)]
        assert s == pytest.approx(1 - math.prod(clean or [1 - none]), abs=1e-6)
