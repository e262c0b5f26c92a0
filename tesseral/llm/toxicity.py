"""Toxicity by subword-bag embeddings.

A word is the average of the embeddings of its character n-grams, a passage the average of its
words, and a linear softmax scores the passage; embeddings and softmax are trained jointly in numpy.
Misspellings that training never saw share most n-grams with the words it did see. A text is judged
by all of its passages, so a few words count in a text of any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Bound of the training sample: labels of each class, and the longest text in characters.
SAMPLE = {1: 2000, 0: 4000}
SAMPLE_CHARS = 6_000
BUCKETS, DIMENSIONS, PASSAGE = 1 << 17, 4, 4
NGRAMS = (4, 5)
STEPS, RATE, BIAS_RATE, START_BIAS, SEED = 200, 0.6, 0.01, -11.0, 11
#: Gradients below this part of the largest one move a parameter in proportion to them, so that
#: what only a few texts have is not learned as fast as what hundreds share.
FLOOR = 0.03
WORD = re.compile(r"[^\W_]+")
CACHE_WORDS = 500_000
#: Characters that are scored at once, besides one text.
CHUNK_CHARS = 2_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def bags(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every character n-gram of the words with their ends marked, and of each
    word as a whole."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lengths)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    place = (np.arange(len(points)) - starts[word]).astype(np.uint64)
    whole = np.add.reduceat(_mix(points * np.uint64(0x100000001B3) + place), starts) if len(words) else np.zeros(0, np.uint64)
    found, owner = [_mix(whole)], [np.arange(len(words))]
    for n in NGRAMS:
        inside = np.flatnonzero(word[: len(word) - n + 1] == word[n - 1 :]) if len(word) >= n else np.zeros(0, np.int64)
        h = np.full(len(inside), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x5851F42D4C957F2D) + points[inside + k]
        found.append(_mix(h))
        owner.append(word[inside])
    return (np.concatenate(found) % np.uint64(buckets)).astype(np.int64), np.concatenate(owner)


class Model(NamedTuple):
    """What scoring needs: the embeddings, and the softmax's weights and bias for two classes."""

    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def bucket_scores(self) -> np.ndarray:
        """Each bucket's share of the toxic logit against the other one; averages pass through."""
        return self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])


def train(texts: list[str], labels: list[int], *, buckets: int = BUCKETS, steps: int = STEPS, seed: int = SEED) -> Model:
    """Adam over the whole sample. A text is toxic unless all of its passages are clean (noisy or),
    so the gradient goes to the passages that speak for toxicity. As the softmax is linear, every
    embedding's gradient is a number times the difference of the two weight columns: sums run over
    numbers, never over vectors."""
    rng = np.random.default_rng(seed)
    emb = ((rng.random((buckets, DIMENSIONS)) - 0.5) / DIMENSIONS).astype(np.float32)
    w = (rng.random((DIMENSIONS, 2)) - 0.5).astype(np.float32)
    bias = np.array([0, START_BIAS], np.float32)
    words = [WORD.findall(t.lower()) for t in texts]
    y = np.array([k for k, x in zip(labels, words) if x], np.float64)
    words = [x for x in words if x]
    if not words:
        return Model(emb, w, bias)
    index: dict[str, int] = {}
    token = np.fromiter((index.setdefault(x, len(index)) for own in words for x in own), np.int32)
    gram, owner = bags(list(index), buckets)
    grams_of = np.bincount(owner, minlength=len(index))
    lengths = np.fromiter(map(len, words), np.int64)
    del words
    passages = -(-lengths // PASSAGE)
    text_of = np.repeat(np.arange(len(y)), passages)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    start = np.concatenate([[0], np.cumsum(passages)[:-1]])
    p_start = first[text_of] + PASSAGE * (np.arange(len(text_of)) - start[text_of])
    p_size = np.diff(np.append(p_start, len(token)))
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))  # classes weigh alike
    params, moments = [emb, w, bias], [(np.zeros_like(x), np.zeros_like(x)) for x in (emb, w, bias)]
    for step in range(1, steps + 1):
        diff = w[:, 1] - w[:, 0]
        word_score = np.bincount(owner, (emb @ diff)[gram], len(index)) / grams_of
        logit = np.clip(np.add.reduceat(word_score[token], p_start) / p_size + (bias[1] - bias[0]), -30, 30)
        p = 1 / (1 + np.exp(-logit))
        clean = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), start)
        some = np.maximum(-np.expm1(clean), 1e-9)
        d_logit = share[text_of] * p * np.where(y > 0, -np.exp(clean) / some, 1.0)[text_of]
        d_word = np.bincount(token, np.repeat(d_logit / p_size, p_size), len(index)) / grams_of
        c = np.bincount(gram, d_word[owner], buckets)
        d_diff = emb.T @ c.astype(np.float32)
        grads = [np.outer(c, diff).astype(np.float32), np.stack([-d_diff, d_diff], axis=1), np.array([-1, 1]) * d_logit.sum()]
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for value, (m, v), g, own in zip(params, moments, grads, (rate, rate, BIAS_RATE)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            size = np.sqrt(v / (1 - 0.99**step))
            value -= (own / (1 - 0.9**step) * m / (size + FLOOR * size.max() + 1e-12)).astype(np.float32)
    return Model(emb, w, bias)


def sample(docs: DataFrame, labels: DataFrame, *, label: str = "toxic") -> tuple[list[str], list[int]]:
    """The training texts: of the labels whose crc32(doc_id as text) mod 5 is not 0, those SAMPLE of
    each class with the smallest hash of the id, as far as their texts are not longer than
    SAMPLE_CHARS. The ids are chosen from the labels alone, so at most that many ids are broadcast
    to the texts and at most that many texts come back."""
    known = labels.where(F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("__y"))
    ids = [r for y, most in SAMPLE.items() for r in known.where(F.col("__y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    chosen = docs.sparkSession.createDataFrame([(int(r["doc_id"]), r["__y"]) for r in ids], "doc_id long, __y int")
    rows = (
        docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("__text"))
        .where(F.length("__text") <= SAMPLE_CHARS)
        .join(F.broadcast(chosen), "doc_id")
        .dropDuplicates(["doc_id"])
        .collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    return [r["__text"] for r in rows], [r["__y"] for r in rows]


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training; a null id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def score_texts(texts: list[str], scores: np.ndarray, bias: float, known: dict[str, float]) -> list[float]:
    """Probabilities of toxicity. `known` keeps words' scores from call to call. A text without
    words has the probability of one passage without any."""
    words = [WORD.findall(t.lower()) for t in texts]
    if len(known) > CACHE_WORDS:
        known.clear()
    new = list(set().union(*words) - known.keys())
    if new:
        bucket, owner = bags(new, len(scores))
        known.update(zip(new, (np.bincount(owner, scores[bucket], len(new)) / np.bincount(owner, minlength=len(new))).tolist()))
    out = []
    for own in words:
        found = np.fromiter(map(known.__getitem__, own), np.float64, len(own)) if own else np.zeros(1)
        starts = np.arange(0, len(found), PASSAGE)
        logit = np.clip(np.add.reduceat(found, starts) / np.diff(np.append(starts, len(found))) + bias, -30, 30)
        out.append(float(-np.expm1(-np.logaddexp(0, logit).sum())))
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with score and predicted (1 from 0.5 on) added; only the text is looked at. The model
    is a fixed number of buckets whatever the input (`BUCKETS` floats are broadcast). A null text
    counts as empty. Repeated rows get equal scores, an empty table an empty result; input columns
    of those names are replaced."""
    docs = docs.drop("score", "predicted")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.bucket_scores().astype(np.float64))
    bias = float(model.bias[1] - model.bias[0])

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for texts in batches:
            out, own, held = [], [], 0
            for t in texts:
                own.append(t or "")
                held += len(own[-1])
                if held > CHUNK_CHARS:
                    out += score_texts(own, shared.value, bias, known)
                    own, held = [], 0
            yield pd.Series(out + score_texts(own, shared.value, bias, known), dtype="float64")

    out = docs.withColumn("score", scored(text_or_empty()))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(*sample(docs, labels))
