"""How the sources of a language differ in their words: an audit by integer-dictionary encoding.

The kept terms of all languages get numbers in the order of their UTF-8 bytes. Counted terms are turned
into numbers by binary search in sorted arrays of kept terms, and counted by group into dense vectors of
CHUNK neighbouring numbers. Vectors of one stretch of numbers meet in cells of two blocks of sources;
sums over the stretches and the best of each stretch give the whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .common import partitions, settle, working

#: A language keeps the terms of at least so many of its documents.
MIN_DOCS = 30
SMOOTHING, UNIT = 5, 1_000_000_000
TOP_TERMS = 50
#: Neighbouring kept terms in a dense vector, and sources in a block (about, as they are dealt by hash).
CHUNK, SOURCES = 4096, 128
#: Terms that a task counts before it passes them on, and counted terms in a bucket of the dictionary.
HELD, BUCKET = 200_000, 200_000

#: What stands between terms becomes a blank, A-Z become lower case; bytes of other letters stay.
BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences and documents of each term among the task's rows, and
    a row with an empty term for each group."""
    n: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)
    held = 0

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in n.items():
            terms, seen = list(own), docs[lang, source]
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(list(own.values()), pa.int64()), pa.array([seen[t] for t in terms], pa.int64())], ["lang", "source", "term", "n", "docs"]
            )

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            words = text.as_py().translate(BYTES).split()
            own = n[lang, source]
            before = len(own)
            own.update(words)
            own[b""] += 0
            docs[lang, source].update(set(words))
            held += len(own) - before
            if held >= HELD:
                yield from passed_on()
                n.clear()
                docs.clear()
                held = 0
    yield from passed_on()


def _numbers_of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Counted terms of a bucket with the numbers of those that are among its kept ones."""
    kept = right.sort_values("key")
    keys, terms = kept["key"].to_numpy(dtype=object), left["key"].to_numpy(dtype=object)
    if not len(keys) or not len(terms):
        return pd.DataFrame({"lang": [], "source": [], "id": [], "n": []})
    at = np.minimum(np.searchsorted(keys, terms), len(keys) - 1)
    hit = keys[at] == terms
    return pd.DataFrame({"lang": left["lang"][hit], "source": left["source"][hit], "id": kept["id"].to_numpy()[at[hit]], "n": left["n"][hit]})


def _shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + SMOOTHING) / (total + SMOOTHING * terms)), by long division in steps of
    1000 so that nothing overflows; with Python's integers where even that would."""
    below = total + SMOOTHING * terms
    rest = counts + SMOOTHING if below < 2**63 // 1000 else counts.astype(object) + SMOOTHING
    out, rest = rest // below, rest % below
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // below, rest % below
    return (out + 1).astype(np.int64)


RESULT = "lang string, source string, other string, id long, value long"


def _cell(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one stretch of numbers and two blocks of sources: the pairs' parts of their sums, and, if both
    blocks are one, the sources' best terms. The row without source is the language itself."""
    head = rows.iloc[0]
    lang, terms, chunk = head["lang"], int(head["terms"]), int(head["chunk"])
    width = max(min(CHUNK, terms - chunk * CHUNK), 0)
    rows = rows.sort_values("source")

    def dense(at: object, n: object, total: int) -> tuple[np.ndarray, np.ndarray]:
        # sums of whole numbers below 2^53 are exact as doubles
        counts = np.zeros(width, np.int64) if at is None else np.bincount(np.asarray(at, np.int64), np.asarray(n, np.float64), minlength=width).astype(np.int64)
        return counts, _shares(counts, int(total), terms) if width else counts

    vectors = {s: (b, *dense(at, n, total)) for s, b, at, n, total in zip(rows["source"], rows["block"], rows["at"], rows["n"], rows["total"]) if s is not None}
    lo, hi = int(head["lo"]), int(head["hi"])
    out = []
    left, right = ([s for s, v in vectors.items() if v[0] == b] for b in (lo, hi))
    matrix = np.array([vectors[s][2] for s in right]).reshape(len(right), width)
    for i, s in enumerate(left):
        others = slice(i + 1, None) if lo == hi else slice(None)
        values = np.abs(matrix[others] - vectors[s][2]).sum(axis=1)
        out += [(lang, s, o, None, int(v)) for o, v in zip(right[others], values)]
    of_lang = rows[rows["source"].isna()]
    if lo == hi and width and len(of_lang):
        whole = of_lang.iloc[0]
        _, q = dense(whole["at"], whole["n"], whole["total"])
        for s in left:
            _, counts, p = vectors[s]
            more = np.flatnonzero((counts > 0) & (p > q))
            best = more[np.lexsort((more, -(p - q)[more]))][:TOP_TERMS]
            out += [(lang, s, None, int(whole["first"]) + chunk * CHUNK + int(i), int(p[i] - q[i])) for i in best]
    return pd.DataFrame(out, columns=["lang", "source", "other", "id", "value"]).astype({"id": "Int64"})


def audit(docs: DataFrame, *, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank) of each group of `docs` (lang, source, text).

    Part `pair`: the other sources of the language by the sum, over all its kept terms, of how far the
    terms' shares are apart; 0 if it keeps none. Part `term`: the kept terms that the group has more
    often than its language, by how much, at most TOP_TERMS. Ranks are by falling value, then by the
    item's UTF-8 bytes. All arithmetic is in whole numbers.

    Null texts, languages and sources are empty ones. A document counts as often as its row is there. A
    group without terms has pairs, a source that is alone in its language none. No rows give none. Other
    columns are not looked at.
    """
    spark = docs.sparkSession
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    with working(spark) as put:
        plain = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
        parts = plain.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
        counts = put(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
        is_term = F.octet_length("term") > 0
        kept = counts.where(is_term).groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
        kept = put(numbered(kept.drop("docs"), ["lang", "term"], "id"))
        langs = put(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.min("id").alias("first"), F.sum("n").alias("total")))

        # terms to numbers
        buckets = max(partitions(spark), -(-counts.count() // BUCKET))
        key = F.concat(F.col("lang").cast("binary"), F.lit(bytearray(1)), F.col("term"))  # no term has a zero byte
        keyed = lambda rows, *columns: rows.select(*columns, key.alias("key")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
        left, right = keyed(counts.where(is_term), "lang", "source", "n"), keyed(kept, "id")
        encoded = put(left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInPandas(_numbers_of, "lang string, source string, id long, n long"))

        # groups, each with its block and as much of its vectors as is not zero
        of_group = encoded.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = counts.where(~is_term).select("lang", "source")
        blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES).alias("blocks"))
        members = (
            groups.join(of_group, ["lang", "source"], "left").join(blocks, "lang").join(langs.select("lang", "terms", "first"), "lang", "left")
            .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("first", F.lit(0)).alias("first"), "blocks")
        )
        place = F.col("id") - F.col("first")
        placed = lambda rows: rows.join(langs.select("lang", "first"), "lang").select("lang", *(c for c in ("source",) if c in rows.columns), F.expr(f"(id - first) div {CHUNK}").alias("chunk"), (place % CHUNK).cast("int").alias("at"), "n")
        gathered = (F.collect_list(F.struct("at", "n")).alias("v"),)
        vectors = placed(encoded).groupBy("lang", "source", "chunk").agg(*gathered)
        stretches = F.explode(F.expr(f"sequence(0L, greatest(terms - 1, 0) div {CHUNK})")).alias("chunk")
        every = members.select("*", F.pmod(F.xxhash64("source"), F.col("blocks")).alias("block"), stretches).join(vectors, ["lang", "source", "chunk"], "left")
        spread = every.select("*", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("__o"))
        cells = spread.select("*", F.least("block", "__o").alias("lo"), F.greatest("block", "__o").alias("hi"))
        whole = placed(kept).groupBy("lang", "chunk").agg(*gathered).join(langs, "lang").join(blocks, "lang")
        whole = whole.select("*", F.lit(None).cast("string").alias("source"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
        columns = ("lang", "source", "total", "terms", "first", "chunk", "block", "lo", "hi", F.col("v.at").alias("at"), F.col("v.n").alias("n"))
        cells = cells.select(*columns).unionByName(whole.select("*", F.col("block").alias("lo"), F.col("block").alias("hi")).select(*columns))
        found = put(cells.groupBy("lang", "chunk", "lo", "hi").applyInPandas(_cell, RESULT))

        pairs = found.where("other is not null").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
        both = pairs.select("lang", "source", F.col("other").alias("item"), "value").unionByName(pairs.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), "value"))
        by_value = lambda tie: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), tie)).cast("int").alias("rank")
        ranked = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", by_value("item"))
        best = found.where("id is not null").select("lang", "source", "id", "value", by_value("id")).where(F.col("rank") <= TOP_TERMS)
        named = best.join(kept.select("id", F.col("term").cast("string").alias("item")), "id")
        out = ranked.unionByName(named.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
        return settle(out)
