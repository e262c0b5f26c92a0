"""Near-duplicate documents by ProbMinHash.

Weighted five-word shingles are read as rates of Poisson processes: each shingle sends points into
the signature's registers, in order of time, until no register can still be beaten. The registers
estimate the probability Jaccard similarity; bands of registers give candidates, and the exact
similarity of the shingle sets decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import content_keys, paired, settle, shielded, sparing, text_or_empty, words_of, working

SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8 a pair meets in some band with probability 0.99994; at 0.2 with 0.002.
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
#: Classes of shingles whose parities bound from below in how many shingles two sets differ.
PARITIES = 2048
#: Numbers of 64 parities each into which they are folded where many pairs are looked at.
COARSE = 8
#: Shingles that a signature batch holds at most, besides one text.
BATCH_SHINGLES = 400_000
#: Tables of up to this many rows (up to 32 bytes each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Far below what one shingle changes in a comparison of similarities, far above rounding.
EPSILON = 1e-9
MAX_ROUNDS = 60


def shingles(text: Column) -> dict[str, Column]:
    """Columns to add in turn; the last, __s, has a 64-bit hash for each place of a five-word
    shingle. Shorter texts have one shingle of all their words, empty ones none."""

    return {
        "__w": F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w)),
        "__w2": paired("__w", "__w", 1),
        "__w4": paired("__w2", "__w2", 2),
        "__s": F.expr(
            f"case when size(__w) = 0 then cast(array() as array<bigint>) when size(__w) < {SHINGLE} then array(xxhash64(__w))"
            f" else zip_with(slice(__w4, 1, greatest(size(__w) - 4, 0)), slice(__w, 5, greatest(size(__w) - 4, 0)), (a, b) -> xxhash64(a, b)) end"
        ),
    }


def with_shingles(df: DataFrame, text: Column) -> DataFrame:
    own = df.columns
    for name, column in shingles(text).items():
        df = df.withColumn(name, column)
    return df.select(*own, "__s")


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: well mixed 64-bit numbers from any."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def signatures(values: np.ndarray, offsets: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures, one row per text; `values` holds the texts' shingle hashes one text
    after another. A shingle's weight is 1 + ln of how often the text has it.

    In round k every active shingle sends its k-th point: its time grows by an exponential step over
    the weight, its register is drawn from the same hash. The earliest point of a register wins, its
    shingle is the register's value. A shingle whose time has passed the latest register is done:
    the rounds end when none is left.
    """
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    first = np.ones(len(v), bool)
    first[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(first)
    times_seen = np.diff(np.append(at, len(v)))
    v, o = v[at].astype(np.uint64), o[at]
    weight = 1 + np.log(times_seen)
    best = np.full(n * registers, np.inf)
    value = np.zeros(n * registers, np.uint64)
    state, clock, k = v.copy(), np.zeros(len(v)), 0
    while len(v):
        k += 1
        state = _mix(state + np.uint64(0x9E3779B97F4A7C15))
        step = -np.log((state >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
        clock = clock + step / weight
        slot = o * registers + (_mix(state ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(best, slot, clock)
        won = best[slot] == clock
        value[slot[won]] = v[won]
        latest = best.reshape(n, registers).max(axis=1)
        on = clock < latest[o]
        v, o, weight, state, clock = v[on], o[on], weight[on], state[on], clock[on]
    return value.reshape(n, registers)


def _slices(batch: pa.RecordBatch, texts: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, hashes, offsets) of up to `texts` texts and BATCH_SHINGLES shingles at a time; the
    hashes are the batch's last column."""
    column = batch.column(batch.num_columns - 1)
    offsets, values = np.asarray(column.offsets), np.asarray(column.values)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BATCH_SHINGLES)) - 1)
        end = min(end, len(column), start + texts)
        own = offsets[start : end + 1]
        yield slice(start, end), values[own[0] : own[-1]].view(np.uint64), own - own[0]
        start = end


def _distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets with each text's repeated shingles left out."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    first = np.ones(len(v), bool)
    first[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return v[first], np.concatenate([[0], np.cumsum(np.bincount(o[first], minlength=n))])


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A number for each band of each signature, made from the band's place and registers."""
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sig), 1))
    parts = sig.reshape(len(sig), BANDS, ROWS)
    for r in range(ROWS):
        keys = _mix(keys * np.uint64(0x100000001B3) + parts[:, :, r])
    return keys.view(np.int64)


def parities(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, whether each of PARITIES classes holds an odd number of its distinct shingles,
    packed into numbers. A shingle that only one of two texts has turns one class over, so two sets
    differ in at least as many shingles as their parities in bits."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    classes = (_mix(values ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(PARITIES)).astype(np.int64)
    odd = (np.bincount(owner * PARITIES + classes, minlength=n * PARITIES) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, PARITIES), axis=1).view(np.int64)


def _signed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Band keys and parities of the shingle sets, whose similarity decides on links; texts that
    repeat shingles get the keys of their weighted signatures as well, which differ only there."""
    for rows, values, offsets in _slices(batch, 512):
        once, ends = _distinct(values, offsets)
        keys = band_keys(signatures(once, ends))
        use = np.repeat((np.diff(ends) > 0)[:, None], BANDS, axis=1)
        again = np.flatnonzero(np.diff(offsets) != np.diff(ends))
        more = np.zeros_like(keys)
        also = np.zeros_like(use)
        if len(again):
            parts = [values[offsets[i] : offsets[i + 1]] for i in again]
            more[again] = band_keys(signatures(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])))
            also[again] = more[again] != keys[again]
        use = np.hstack([use, also])
        places = np.concatenate([[0], np.cumsum(use.sum(axis=1))]).astype(np.int32)
        odd = parities(once, ends)
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(i).slice(rows.start, rows.stop - rows.start) for i in range(3)),
                pa.array(np.diff(ends).astype(np.int32)),
                pa.ListArray.from_arrays(places, np.hstack([keys, more])[use]),
                pa.ListArray.from_arrays(np.arange(0, odd.size + 1, odd.shape[1], dtype=np.int32), odd.ravel()),
            ],
            names=["id", "k0", "k1", "n", "keys", "odd"],
        )


@sparing
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _signed(batch)
        del batch  # before the next one is read


def _identified(docs: DataFrame) -> DataFrame:
    """(__id, __text): a null doc_id is replaced by a hash of the text, a null text is empty."""
    return docs.select(_id().alias("__id"), text_or_empty().alias("__text"))


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text_or_empty()))


def _keys(text: Column) -> tuple[Column, Column]:
    return content_keys(words_of(F.lower(text)))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(k0, k1, first, last, n, keys, odd): the distinct word sequences, by content key, with the
    smallest and largest document of each, and what _signed finds. Rows are signed where they lie; copies are dropped
    afterwards, within tasks first, so that no text moves."""
    k0, k1 = _keys(F.col("__text"))
    rows = with_shingles(_identified(docs).select("__id", k0.alias("k0"), k1.alias("k1"), "__text"), F.col("__text"))
    signed = rows.select("__id", "k0", "k1", "__s").mapInArrow(_sign, "id long, k0 long, k1 long, n int, keys array<long>, odd array<long>")
    return signed.groupBy("k0", "k1").agg(F.min("id").alias("first"), F.max("id").alias("last"), *(F.first(c).alias(c) for c in ("n", "keys", "odd")))


def _bounded(df: DataFrame) -> DataFrame:
    """A settled table, marked for broadcast while it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, s): the shingle sets of the texts that `wanted` (node, first, k0, k1; settled) names.
    Words are cut only in rows whose document is asked for; repeated rows count once."""
    found = _identified(docs).join(_bounded(wanted.withColumnRenamed("first", "__id")), "__id")
    words = found.withColumn("__words", words_of(F.lower(F.col("__text"))))
    k0, k1 = content_keys(F.col("__words"))
    same = words.where((k0 == F.col("k0")) & (k1 == F.col("k1")))
    own = with_shingles(same.select("node", "__text"), F.col("__text"))
    return own.select("node", F.array_distinct("__s").alias("s")).dropDuplicates(["node"])


def _most_apart(similarity: float) -> float:
    """Sets of that similarity differ in at most this part of the sum of their sizes."""
    return (1 - similarity) / (1 + similarity)


def _may_link(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """(a, b, apart) of the pairs that exact bounds allow: `apart` is the least part of both sets'
    sizes in which they can differ, by their sizes and by their parities."""
    side = lambda c: sketches.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("odd").alias(f"odd{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    bits = F.expr("aggregate(zip_with(odda, oddb, (p, q) -> bit_count(p ^ q)), 0, (s, k) -> s + k)")
    apart = F.greatest(bits, F.abs(F.col("na") - F.col("nb"))) / (F.col("na") + F.col("nb"))
    return both.select("a", "b", apart.alias("apart")).where(F.col("apart") <= _most_apart(similarity) + EPSILON)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets are that similar."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("s").alias(f"s{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared + EPSILON >= F.lit(similarity) * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def components(edges: DataFrame, settle: Callable[[DataFrame], DataFrame] = settle) -> DataFrame:
    """(node, comp): the smallest node of each connected component, for nodes with an edge (a, b).
    Alternating large-star and small-star steps; each step's edges are written to the shared folder."""
    edges = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = settle(small.select("e.u", "e.v").where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v"), F.col("v"))).distinct()


def _still_apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose ends have different labels, with these as la and lb."""
    side = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"l{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where("la <> lb")


def _linked(pairs: DataFrame, sets: DataFrame, labels: DataFrame, similarity: float, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`labels` (node, comp) brought up to date by the links among the settled pairs (a, b, apart).
    First each node's most promising pair is verified, then every pair that is still apart: so texts
    of one large group are mostly compared once each, and no link between different components is
    left out."""
    if not pairs.limit(1).count():
        return labels
    side = lambda x, y: pairs.select(F.col(x).alias("x"), F.struct("apart", F.col(y).alias("y")).alias("o"))
    best = side("a", "b").union(side("b", "a")).groupBy("x").agg(F.min("o").alias("o"))
    best = best.select(F.least("x", "o.y").alias("a"), F.greatest("x", "o.y").alias("b")).distinct()
    for wave in (best, pairs):
        found = settle(_verified(_still_apart(wave, labels), sets, similarity))
        if found.limit(1).count():
            merged = components(_still_apart(found, labels).select(F.col("la").alias("a"), F.col("lb").alias("b")), settle)
            merged = merged.select(F.col("node").alias("comp"), F.col("comp").alias("now"))
            labels = settle(labels.join(merged, "comp", "left").select("node", F.coalesce("now", "comp").alias("comp")))
    return labels


def _coarse(odd: str) -> list[Column]:
    """The parities of COARSE times 64 larger classes, a number each: as exact, and less close."""
    each = PARITIES // 64 // COARSE
    return [F.expr(f"aggregate(slice({odd}, {1 + each * i}, {each}), 0L, (a, b) -> a ^ b)").alias(f"odd{i}") for i in range(COARSE)]


def _prefix_pairs(sets: DataFrame, sketches: DataFrame, labels: DataFrame, similarity: float, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b) of all texts in different components that can be that similar: in a common order of
    shingles, the rarest first, similar sets share one of their first n - ceil(similarity * n) + 1.
    Shingles of a single text are passed over. At the first shingle that two texts share, what follows
    it in either bounds how many more they share; so do the parities."""
    each = sets.select("node", F.explode("s").alias("x"))
    counts = each.groupBy("x").agg(F.count("*").alias("k")).where("k > 1")
    shared = each.join(counts, "x").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("o"))
    sized = sets.select("node", F.size("s").alias("n")).join(shared, "node").join(labels, "node")
    lead = F.size("o") + 1 - F.ceil(F.lit(similarity) * F.col("n") - EPSILON).cast("int")
    firsts = sized.where(lead > 0).select("node", "comp", "n", F.size("o").alias("c"), F.posexplode(F.slice("o", F.lit(1), lead)).alias("i", "e"))
    firsts = settle(firsts.select("node", "comp", "n", "c", "i", F.col("e.x").alias("x")).join(sketches.select("node", *_coarse("odd")), "node"))
    x, y = firsts.alias("x"), firsts.alias("y")
    sizes = F.col("x.n") + F.col("y.n")
    enough = F.least(F.col("x.c") - F.col("x.i"), F.col("y.c") - F.col("y.i")) >= F.lit(similarity / (1 + similarity)) * sizes - EPSILON
    close = F.expr(" + ".join(f"bit_count(x.odd{i} ^ y.odd{i})" for i in range(COARSE))) <= F.lit(_most_apart(similarity)) * sizes + EPSILON
    mates = x.join(y, (F.col("x.x") == F.col("y.x")) & (F.col("x.comp") < F.col("y.comp")) & enough & close)
    return mates.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def cluster(docs: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """(k0, k1, first, last, class_id, stays): every distinct text by its content key, with its smallest
    and largest document, its class, which is named by the class's smallest document, and whether it
    is the text that stays.

    A link joins two texts whose sets of five-word shingles (lower case, cut at white space) have
    Jaccard similarity `similarity` or more, as far as some band of the signatures shows it. Classes
    are the connected components of the links. Texts with the same words are one text whatever their
    length; so are empty ones.

    In each bucket (of one band) every text is first compared with one of them only, a different one
    in each bucket: a group of thousands of near copies costs its size, not its square, and is joined
    up even where many of its pairs are not links. Texts of one bucket that are then still in different
    components meet again by the rarest of their shingles, which loses none of their links and finds
    some that no band has shown. Only exact bounds keep a pair from being verified.
    """
    with working(docs.sparkSession) as put:
        texts = put(distinct_texts(docs).withColumn("node", F.monotonically_increasing_id()))
        # the smallest node after a bucket's own permutation leads it
        rows = texts.select("node", F.explode("keys").alias("key"))
        leads = rows.groupBy("key").agg(F.expr("min(node ^ xxhash64(key))").alias("lead"), F.count("*").alias("many")).where("many > 1")
        rows = put(rows.join(leads, "key").select("node", "key", F.expr("lead ^ xxhash64(key)").alias("top")))
        nodes = rows.select("node").distinct()
        sketches = put(texts.select("node", "n", "odd", "first", "k0", "k1").join(nodes, "node"))
        sets = put(shingle_sets(docs, sketches.select("node", "first", "k0", "k1")))
        labels = put(sketches.select("node", F.col("node").alias("comp")))
        stars = rows.where("node <> top").select(F.least("top", "node").alias("a"), F.greatest("top", "node").alias("b")).distinct()
        labels = _linked(put(_may_link(stars, sketches, similarity)), sets, labels, similarity, put)

        # what the stars have left: texts of buckets with more than one component
        owned = rows.select("node", "key").join(labels, "node")
        split = owned.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        left = put(owned.join(split, "key").select("node").distinct())
        if left.limit(1).count():
            mates = _prefix_pairs(put(sets.join(left, "node")), sketches, labels, similarity, put)
            labels = _linked(put(_may_link(mates, sketches, similarity)), sets, labels, similarity, put)

        own = texts.select("node", "k0", "k1", "first", "last").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        named = own.groupBy("comp").agg(F.min("first").alias("class_id"))
        tied = own.join(named, "comp").where(F.col("first") == F.col("class_id")).groupBy("comp").agg(F.min("node").alias("kept"), F.first("class_id").alias("class_id"))
        return settle(own.join(tied, "comp").select("k0", "k1", "first", "last", "class_id", (F.col("node") == F.col("kept")).alias("stays")))


@shielded
def dedupe(docs: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` with class_id and kept: one document of each class stays, the smallest.

    Nulls: a null text is empty; a null doc_id is replaced by a hash of its text for class_id. Of
    repeated rows (same doc_id and words) all get the same class_id and verdict; rows with one doc_id
    but different words are judged each by its own text. Ties of classes on their smallest doc_id are
    settled by text, so one text stays. Empty table: empty result. Input columns named class_id or
    kept are replaced; others are carried along.
    """
    docs = docs.drop("class_id", "kept")
    rows = _with_keys(docs)
    found = cluster(docs, similarity=similarity).select(F.col("k0").alias("__c0"), F.col("k1").alias("__c1"), F.col("class_id").alias("__class"), "stays")
    found = found.withColumnRenamed("stays", "__stays")
    joined = rows.join(found, (F.col("__k0") == F.col("__c0")) & (F.col("__k1") == F.col("__c1")))
    kept = F.col("__stays") & (F.col("__id") == F.col("__class"))
    return joined.select(*docs.columns, F.col("__class").alias("class_id"), kept.alias("kept"))


def _with_keys(docs: DataFrame) -> DataFrame:
    k0, k1 = _keys(text_or_empty())
    return docs.select("*", _id().alias("__id"), k0.alias("__k0"), k1.alias("__k1"))


@shielded
def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that `dedupe` keeps, with their own columns; the same cases have the same
    results. Only the keys of what goes are joined, so rows move only if these are too many to
    broadcast."""
    found = cluster(docs, **options)
    # of the text that stays, other documents go
    but = F.when(F.col("stays"), F.col("first"))
    goes = found.where(~F.col("stays") | (F.col("first") < F.col("last")))
    goes = _bounded(settle(goes.select(F.col("k0").alias("__c0"), F.col("k1").alias("__c1"), but.alias("__but"))))
    gone = (F.col("__k0") == F.col("__c0")) & (F.col("__k1") == F.col("__c1")) & ~F.col("__id").eqNullSafe(F.col("__but"))
    return _with_keys(docs).join(goes, gone, "left_anti").select(*docs.columns)
