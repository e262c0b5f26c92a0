"""Quality rules with cross-document line frequency.

Normalised lines are hashed, distinct documents are counted for each line and host, lines above the
limits are removed, and documents that lose too much are rejected. Near copies count as one document:
those that share most of their lines mostly share the least of their lines' hashes, by which they are
counted, with several hashes so that no family depends on one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, bound, content_keys, has_word, paired, settle, shielded, text_or_empty, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: A line is common on a host when at least this many of the host's distinct documents have it and
#: they are more than this percentage of them; near copies count as one.
COMMON_DOCS, COMMON_PERCENT = 5, 5
#: A document is depleted when its common lines hold more than this percentage of its words.
DEPLETED_PERCENT = 80


#: White space that does not end a line.
IN_LINE = r"[\x20\x09\x0B-\x0D]+"
#: Tables of common lines of up to this many (16 bytes each) are broadcast to the rows.
BROADCAST_LINES = 1_000_000
LINES = "array<struct<l1:bigint,l2:bigint>>"
#: Where near copies count once, so many groups of them must have a line, and more than the percentage
#: of the host's groups, in most of the ways to tell near copies: as many parts of a line's SHA-256, of
#: so many digits (48 bits), serve as its hashes.
COMMON_GROUPS, GROUPINGS, DIGITS = 3, 5, 12


def normalised_lines(text: Column) -> Column:
    """All lines in order, in lower case, white space collapsed; those without a word are empty."""
    return F.transform(F.split(F.regexp_replace(F.lower(text), IN_LINE, " "), "\n"), lambda line: F.trim(line))


def _line_key(line: Column) -> Column:
    return F.struct(*(k.alias(f"l{i}") for i, k in enumerate(content_keys(line), 1)))


def window_hashes(words: Column) -> dict[str, Column]:
    """Columns to add in turn; the last, __h8, has a 64-bit hash of each window of eight words.
    Hashes of one, two and four words are combined by doubling, so no window is sliced out."""

    return {"__h": F.transform(words, lambda w: F.xxhash64(w)), "__h2": paired("__h", "__h", 1), "__h4": paired("__h2", "__h2", 2), "__h8": paired("__h4", "__h4", 4)}


def _stats(docs: DataFrame) -> DataFrame:
    """The base figures of each row, beside its other columns; __text is the text."""
    text = F.col("__text")
    out = docs.withColumn("__words", words_of(text))
    hashes = window_hashes(F.col("__words"))
    for name, column in hashes.items():
        out = out.withColumn(name, column)
        if name == "__h":
            out = out.withColumn("n_words", F.size("__words").cast("long")).drop("__words")
    # only texts with a repeated window sort their windows and look for the places
    out = out.withColumn("__again", F.size("__h8") > F.size(F.array_distinct("__h8")))
    starts = F.expr(
        """case when __again then
             array_sort(array_distinct(flatten(transform(
               filter(
                 zip_with(__sorted, slice(__sorted, 2, size(__sorted)), (a, b) ->
                   if(b is not null and a.h = b.h, array(a.i, b.i), cast(array() as array<int>))),
                 p -> size(p) > 0),
               p -> p))))
           else cast(array() as array<int>) end"""
    )
    out = out.withColumn(
        "__sorted",
        F.expr(
            "case when __again then sort_array(transform(__h8, (h, i) -> struct(h as h, i as i)))"
            " else cast(array() as array<struct<h:bigint,i:int>>) end"
        ),
    )
    out = out.withColumn("__starts", starts).drop("__h", "__h2", "__h4", "__h8", "__sorted", "__again")
    covered = F.expr(
        f"""case when size(__starts) = 0 then 0L else
              {WINDOW}L + aggregate(zip_with(slice(__starts, 2, size(__starts)), slice(__starts, 1, size(__starts) - 1),
                (b, a) -> least({WINDOW}, b - a)), 0L, (s, x) -> s + x) end"""
    )
    lines = F.filter(F.split(text, "\n"), has_word)
    return (
        out.withColumn("n_repeat_words", covered)
        .withColumn("word_chars", F.length(F.translate(text, SPACE_CHARS, "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
        .withColumn("__lines", lines)
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .drop("__starts", "__lines")
        .withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        )
    )


def _by_host(lines: DataFrame) -> DataFrame:
    """(__h, __common): the lines of each host as one array, broadcast while all of them are few. A
    common line needs a share `percent` of its host's documents, so a host has at most
    100 / percent times as many as its documents have lines on average."""
    lines = settle(lines.select(F.col("__host").alias("__h"), "__l1", "__l2"))
    found = lines.groupBy("__h").agg(F.collect_list(F.struct(F.col("__l1").alias("l1"), F.col("__l2").alias("l2"))).alias("__common"))
    return F.broadcast(found) if lines.count() <= BROADCAST_LINES else found


def _places(lines: str) -> Column:
    """The places in an array of normalised lines whose line is one of __common."""
    some = F.arrays_overlap(F.transform(lines, lambda x: F.xxhash64(x)), F.col("__common.l1"))
    each = F.transform(lines, lambda x, i: F.when(F.array_contains("__common", _line_key(x)), i))
    return F.when(some, F.filter(each, lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>"))


def common_lines(docs: DataFrame, *, host: str = "source", min_docs: int = COMMON_DOCS, percent: float = COMMON_PERCENT) -> DataFrame:
    """(__host, __l1, __l2) of the lines that are common on a host.

    First distinct texts are counted, combined before the shuffle; lines below the limits are out. What
    is left is counted again, near copies once: by the least hash of the document's lines, as are the
    host's documents. A line must be above the limits in most of the GROUPINGS such counts, where
    COMMON_GROUPS takes the place of `min_docs` if that is more."""
    t1, t2 = content_keys(text_or_empty())
    lines = F.array_distinct(F.filter(normalised_lines(text_or_empty()), lambda x: x != ""))
    texts = docs.select(F.col(host).alias("__host"), t1.alias("__t1"), t2.alias("__t2"), lines.alias("__lines"))
    above = lambda least: (F.col("n") >= least) & (100 * F.col("n") > percent * F.col("n_host"))
    sizes = texts.select(F.col("__host").alias("__h"), "__t1", "__t2").distinct().groupBy("__h").agg(F.count("*").alias("n_host"))

    # outer: Spark would else filter on the array's size before it, and build the array once more for that
    each = texts.select("__host", "__t1", "__t2", F.explode_outer("__lines").alias("line")).where(F.col("line").isNotNull())
    l1, l2 = content_keys(F.col("line"))
    counted = each.select("__host", l1.alias("__l1"), l2.alias("__l2"), "__t1", "__t2").distinct().groupBy("__host", "__l1", "__l2").agg(F.count("*").alias("n"))
    able = counted.where(F.col("n") >= min_docs).join(sizes, F.col("__host").eqNullSafe(F.col("__h"))).where(above(min_docs)).select("__host", "__l1", "__l2")
    able = _by_host(able)

    hashes = F.transform("__lines", lambda x: F.sha2(x, 256))
    part = lambda k: lambda h: F.substring(h, 1 + DIGITS * k, DIGITS)
    least = bound(hashes, lambda hs: F.array(*(F.array_min(F.transform(hs, part(k))) for k in range(GROUPINGS))))
    grouped = texts.select("__host", "__lines", least.alias("__least"))
    beside = grouped.join(able, F.col("__host").eqNullSafe(F.col("__h")), "left").withColumn("__common", F.coalesce("__common", F.array().cast(LINES)))
    # one pass for both counts: no line stands for the host itself
    keys = F.concat(F.array(F.lit(None)).cast(LINES), F.transform("__at", lambda i: _line_key(F.get("__lines", i))))
    found = beside.withColumn("__at", _places("__lines")).select("__host", "__least", F.explode_outer(keys).alias("l")).select("__host", "l", F.posexplode_outer("__least").alias("k", "g"))
    counts = settle(found.distinct().groupBy("__host", "l", "k").agg(F.count("*").alias("n")))
    hosts = counts.where("l is null").select(F.col("__host").alias("__h"), F.col("k").alias("__k"), F.col("n").alias("n_host"))
    counts = counts.where("l is not null").select("__host", F.col("l.l1").alias("__l1"), F.col("l.l2").alias("__l2"), "k", "n")
    sized = counts.join(hosts, F.col("__host").eqNullSafe(F.col("__h")) & (F.col("k") == F.col("__k")))
    most = sized.groupBy("__host", "__l1", "__l2").agg(F.count_if(above(min(min_docs, COMMON_GROUPS))).alias("n")).where(F.col("n") > GROUPINGS // 2)
    return most.select("__host", "__l1", "__l2")


@shielded
def judge(
    docs: DataFrame,
    *,
    host: str = "source",
    min_docs: int = COMMON_DOCS,
    percent: float = COMMON_PERCENT,
    depleted_percent: float = DEPLETED_PERCENT,
) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_common_words, kept and clean_text (the text without the common lines of its host) added.

    Lines are counted by (host, line hash); then each row looks its own lines up in the array of
    its host's common lines, so no text is shuffled. A hot host, line or text is only a key of
    counts that are combined before the shuffle. Should the common lines of all hosts be too many to
    broadcast, rows join their host's by a shuffle that adaptive execution splits where it is skewed.

    Nulls: a null text has no words and fails; a null host is a host of its own; doc_id is not
    looked at, so repeated rows get equal verdicts. Empty table: empty result. Input columns named
    like an added one are replaced; others are carried along.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_common_words", "kept", "clean_text"]
    docs = docs.drop(*added)
    own = docs.columns
    common = _by_host(common_lines(docs, host=host, min_docs=min_docs, percent=percent))
    rows = _stats(docs.select("*", text_or_empty().alias("__text")))
    joined = rows.join(common, F.col(host).eqNullSafe(F.col("__h")), "left").withColumn("__common", F.coalesce("__common", F.array().cast(LINES)))
    joined = joined.withColumn("__lines", normalised_lines(F.col("__text"))).withColumn("__gone", _places("__lines")).drop("__common")
    lost = F.aggregate(F.transform("__gone", lambda i: F.size(words_of(F.get("__lines", i)))), F.lit(0), lambda a, n: a + n)
    joined = joined.withColumn("n_common_words", lost.cast("long"))
    depleted = 100 * F.col("n_common_words") > depleted_percent * F.col("n_words")
    clean = F.when(F.size("__gone") == 0, F.col("text")).otherwise(
        F.array_join(F.filter(F.split("__text", "\n"), lambda line, i: ~F.array_contains("__gone", i)), "\n")
    )
    # one sum of null-tolerant terms: a filter on it can neither be taken apart nor imply a filter on
    # its terms, which Spark would push down to where their whole expressions are computed again
    kept = F.coalesce(F.col("base_failed").cast("int"), F.lit(0)) + F.coalesce(depleted.cast("int"), F.lit(0)) == 0
    return joined.select(*own, *added[:7], kept.alias("kept"), clean.alias("clean_text"))


@shielded
def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The columns of `docs` for the rows that stay, their common lines removed; n_chars, if there,
    is brought up to date. Nulls, ties, repeated rows and empty tables: as in `judge`."""
    good = judge(docs, **options).where("kept")
    out = {"text": F.col("clean_text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length("clean_text").cast("long")
    return good.select(*(out.get(c, F.col(c)).alias(c) for c in docs.columns))
