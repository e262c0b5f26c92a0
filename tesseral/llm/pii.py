"""Personal data: pattern matches, and information-theoretic sanitisation of what gives them away.

Patterns find the protected entities. The corpus then tells how strongly a term near an entity
reveals it: the pointwise mutual information of both, as part of the entity's own information. Terms
above the disclosure thresholds are generalised or removed along with the matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filters import bits_for, bloom, might_have
from .common import bound, content_keys, fold, settle, shielded, text_or_empty, working

#: Kinds in the order of the contract. The patterns are the contract's; possessive quantifiers and
#: the conditions on where a match may begin only keep the matcher from trying starts and lengths
#: that cannot succeed, so that long texts take linear time.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for the pattern to be tried at all.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
SPACE_CHAR = r"[\x20\x09-\x0D]"
#: Characters on either side of a match whose words count as its context.
CONTEXT_CHARS = 80
#: Distinct texts that must have a term in an entity's context, and the parts of the entity's
#: information from which a term is generalised or removed. Nearly every entity stands in one text
#: only, so any support counts: a term beside one person's address and nowhere else gives it away.
MIN_TEXTS, GENERALISE_FROM, REMOVE_FROM = 1, 0.8, 0.95

#: Terms are the words between characters other than these, without JOINER at their ends; they have a
#: letter and no @, for addresses are the patterns' part.
IN_TOKEN = r"\p{L}\p{M}\p{N}@._%+-"
JOINERS = "@._%+-"
CUT, JOINER = f"[^{IN_TOKEN}]", f"[{JOINERS}]"

SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string,share:double>>"
MATCH = "array<struct<kind:string,rank:int,start:int,end:int,value:string,left:string,right:string>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(digits)
    each = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: (lambda d, twice: F.when(twice, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))(
            F.substring(digits, i, F.lit(1)).cast("int"), (n - i) % 2 == 1
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        digits = F.translate(value, " -", "")
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.translate(value, "+ ().-", "")).between(10, 15)
    return F.lit(True)


def matches(text: Column, kind: str) -> Column:
    """The kind's leftmost non-overlapping matches that hold, with their places (code points, end
    exclusive) and up to CONTEXT_CHARS characters of what lies between them and the next ones. The
    pieces between matches and the matches themselves give the places as running sums of lengths."""
    pattern, rank = F.lit(PATTERNS[kind]), KINDS.index(kind)
    between = F.split(text, PATTERNS[kind], -1)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    zipped = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)), found, F.slice(between, F.lit(2), F.size(found)))

    def step(at: Column, m: Column) -> tuple[Column, Column]:
        begin = at + F.length(m["0"])
        end = begin + F.length(m["1"])
        one = F.struct(
            F.lit(kind).alias("kind"),
            F.lit(rank).alias("rank"),
            begin.alias("start"),
            end.alias("end"),
            m["1"].alias("value"),
            F.right(m["0"], F.lit(CONTEXT_CHARS)).alias("left"),
            F.left(m["2"], F.lit(CONTEXT_CHARS)).alias("right"),
        )
        return end, F.array(one)

    every = fold(zipped, MATCH, F.lit(0), step)
    good = F.filter(every, lambda m: _valid(kind, m["value"]))
    return F.when(text.rlike(HINTS[kind]), good).otherwise(F.array().cast(MATCH))


def with_matches(docs: DataFrame) -> DataFrame:
    """Adds __m: all matches of all kinds by start, then kind."""
    text = text_or_empty()
    for kind in KINDS:
        docs = docs.withColumn(f"__m_{kind}", matches(text, kind))
    every = F.concat(*(F.col(f"__m_{k}") for k in KINDS))
    by_place = F.array_sort(F.transform(every, lambda m: F.struct(m["start"].alias("start"), m["rank"].alias("rank"), m["end"].alias("end"), m["kind"].alias("kind"), m["value"].alias("value"), m["left"].alias("left"), m["right"].alias("right"))))
    return docs.withColumn("__m", by_place)


def _core(token: Column) -> Column:
    """A token without the joiners at its ends."""
    return F.btrim(token, F.lit(JOINERS))


def _is_term(core: Column) -> Column:
    return core.rlike(r"\p{L}") & ~F.contains(core, F.lit("@"))


def _words(text: Column) -> Column:
    """The distinct tokens of a text in lower case, without the joiners at their ends."""
    return F.array_distinct(F.transform(F.split(text, f"{CUT}+"), lambda w: F.lower(_core(w))))


def _terms(matched: DataFrame) -> DataFrame:
    """(__t1, __t2, e1, e2, term): words in the context of each match. A word that the context's edge
    or the match itself may cut is left out."""
    m = matched.select("__t1", "__t2", F.explode("__m").alias("m"))
    e1, e2 = content_keys(F.col("m.kind"), F.col("m.value"))
    inner = lambda side: (lambda w: F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0))))(F.split(F.col(f"m.{side}"), CUT))
    each = m.select("__t1", "__t2", e1.alias("e1"), e2.alias("e2"), F.explode(F.concat(inner("left"), inner("right"))).alias("__word"))
    core = each.select("__t1", "__t2", "e1", "e2", _core(F.col("__word")).alias("__core")).where(_is_term(F.col("__core")))
    return core.select("__t1", "__t2", "e1", "e2", F.lower("__core").alias("term")).distinct()


def _uses(keyed: DataFrame, terms: DataFrame) -> DataFrame:
    """(__t1, __t2, term): the distinct texts that have one of the terms (settled) anywhere, and a few
    words that are no terms. Words meet a filter of the terms where they lie, whose size is bounded
    whatever their number; only what passes is shuffled, at every size."""
    bits = bits_for(terms.count())
    words = keyed.select("__t1", "__t2", F.explode_outer(_words(text_or_empty())).alias("term"))
    return words.where(might_have(bloom(terms, "term", bits), F.col("term"), bits)).distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    t1, t2 = content_keys(text_or_empty())
    return docs.select(t1.alias("__t1"), t2.alias("__t2"), "text")


def _places(text: Column, shares: Column) -> Column:
    """Spans of all the tokens of a text that stand in the map `shares`. Tokens are looked up one by
    one; places are summed up from hit to hit, so each token's length is added once."""

    def spans(tokens: Column, lengths: Column, hits: Column) -> Column:
        def step(at: Column, hit: Column) -> tuple[Column, Column]:
            token, ahead = F.get(tokens, hit["i"]), hit["i"] - at["i"]
            start = at["place"] + ahead + F.aggregate(F.slice(lengths, at["i"] + 1, ahead), F.lit(0), lambda a, n: a + n)
            begin = start + F.length(token) - F.length(F.ltrim(token, F.lit(JOINERS)))
            one = F.struct(
                begin.alias("start"), F.lit(len(KINDS)).alias("rank"), (begin + F.length(hit["core"])).alias("end"),
                F.lit("term").alias("kind"), hit["core"].alias("value"), F.element_at(shares, hit["core"]).alias("share"),
            )
            return F.struct(hit["i"].alias("i"), start.alias("place")), F.array(one)

        return fold(hits, SPANS, F.struct(F.lit(0).alias("i"), F.lit(0).alias("place")), step)

    def found(tokens: Column) -> Column:
        each = F.transform(tokens, lambda w, i: F.struct(i.alias("i"), F.lower(_core(w)).alias("core")))
        hits = F.filter(each, lambda h: F.array_contains(F.map_keys(shares), h["core"]))
        return bound(F.transform(tokens, lambda w: F.length(w)), lambda lengths: bound(hits, lambda h: spans(tokens, lengths, h)))

    return bound(F.split(text, CUT, -1), found)


def _disclosing(docs: DataFrame, min_texts: int, disclosed: float, meetings: int) -> tuple[DataFrame, DataFrame]:
    """`disclosing`, and (__t1, __t2, term, share) of the texts that have such a term, both settled."""
    with working(docs.sparkSession) as put:
        text = text_or_empty()
        keyed = _keyed(docs)
        hinted = keyed.where(F.greatest(*(text.rlike(h).cast("int") for h in HINTS.values())) == 1)
        matched = put(with_matches(hinted).select("__t1", "__t2", "__m"))
        terms = put(_terms(matched))
        pairs = terms.select("e1", "e2", "term", "__t1", "__t2").distinct().groupBy("e1", "e2", "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= min_texts)
        e1, e2 = content_keys(F.col("m.kind"), F.col("m.value"))
        entities = (
            matched.select("__t1", "__t2", F.explode("__m").alias("m"))
            .select("__t1", "__t2", e1.alias("e1"), e2.alias("e2"))
            .distinct()
            .groupBy("e1", "e2")
            .agg(F.count("*").alias("n_e"))
            .where(F.col("n_e") >= min_texts)
        )
        n = keyed.select("__t1", "__t2").distinct().count()
        information = F.ln(F.lit(float(max(n, 1))) / F.col("n_e"))
        share = lambda texts: F.lit(1.0) + F.try_divide(F.ln(F.col("n_et") / F.greatest(texts, "n_et")), information)
        # a term stands in no fewer texts than those with matches that have it: counted over these few
        # already, common words are out, and only what is left is counted over all texts
        near = _uses(hinted, put(terms.select("term").distinct())).groupBy("term").agg(F.count("*").alias("n_ct"))
        met = lambda texts: (F.col("n_et") >= meetings) | (F.col(texts) <= 1)
        able = put(pairs.join(entities, ["e1", "e2"]).join(near, "term").where((F.col("n_e") < n) & (share("n_ct") >= disclosed) & met("n_ct")))
        uses = put(_uses(keyed, put(able.select("term").distinct())))
        counts = uses.groupBy("term").agg(F.count("*").alias("n_t"))
        told = able.join(counts, "term").where(met("n_t")).select("term", share("n_t").alias("share")).where(F.col("share") >= disclosed)
        told = settle(told.groupBy("term").agg(F.max("share").alias("share")))
        return told, settle(uses.join(told, "term"))


def disclosing(docs: DataFrame, *, min_texts: int = MIN_TEXTS, disclosed: float = GENERALISE_FROM, meetings: int = 1) -> DataFrame:
    """(term, share) of the terms whose share of some entity's information is `disclosed` or more,
    with the largest such share.

    All counts are of distinct texts, over the whole corpus: n(e) texts have the entity, n(e, t) have
    the term in its context, n(t) have the term anywhere. The share is PMI(e; t) / I(e)
    = 1 + ln(n(e, t) / n(t)) / ln(N / n(e)). With `meetings` over 1, a term that stands in more than one
    text must have met the entity in so many.
    """
    return _disclosing(docs, min_texts, disclosed, meetings)[0]


@shielded
def find(docs: DataFrame, *, min_texts: int = MIN_TEXTS, disclosed: float = GENERALISE_FROM, meetings: int = 1) -> DataFrame:
    """`docs` with pii_spans: (start, rank, end, kind, value, share) of every match, and of every
    term (kind `term`, rank 4) whose share of some entity's information is `disclosed` or more,
    wherever it stands: a term that gives an entity away does so in other texts, too. `meetings` over 1
    leaves out terms that met their entity once: see `disclosing`.

    Nulls: a null text is empty; doc_id is not looked at, repeated rows get equal spans; an empty
    table gives an empty one. A column named pii_spans is replaced, others are carried along.
    """
    docs = docs.drop("pii_spans")
    own = docs.columns
    _, uses = _disclosing(docs, min_texts, disclosed, meetings)
    extra = uses.groupBy("__t1", "__t2").agg(F.map_from_entries(F.collect_set(F.struct("term", "share"))).alias("__shares"))
    extra = settle(extra).withColumnsRenamed({"__t1": "__x1", "__t2": "__x2"})
    t1, t2 = content_keys(text_or_empty())
    rows = with_matches(docs).select(*own, t1.alias("__t1"), t2.alias("__t2"), "__m")
    # the texts with terms grow with the input: the same plan at every size, and no sort of whole texts
    # (the hashed side has one row per text, so no key of it is hot)
    joined = rows.join(extra.hint("shuffle_hash"), (F.col("__t1") == F.col("__x1")) & (F.col("__t2") == F.col("__x2")), "left")
    base = F.transform("__m", lambda m: F.struct(m["start"].alias("start"), m["rank"].alias("rank"), m["end"].alias("end"), m["kind"].alias("kind"), m["value"].alias("value"), F.lit(None).cast("double").alias("share")))
    more = F.when(F.col("__shares").isNotNull(), _places(text_or_empty(), F.col("__shares"))).otherwise(F.array().cast(SPANS))
    every = F.array_sort(F.concat(base.cast(SPANS), more))
    return joined.select(*own, every.alias("pii_spans"))


@shielded
def sanitise(docs: DataFrame, *, remove_from: float = REMOVE_FROM, **options) -> DataFrame:
    """`docs` with pii_spans and clean_text: matches and disclosing terms are replaced by their kind
    in brackets; terms that reveal `remove_from` of an entity's information are removed. Where spans
    overlap, the one that begins first goes, and what it leaves of the others goes with it. Nulls,
    repeated rows and empty tables: as in `find`; a text without spans stays as it is."""
    text = text_or_empty()
    found = find(docs.drop("clean_text"), **options)
    spans = F.concat("pii_spans", F.array(F.struct(F.length(text).alias("start"), F.lit(9).alias("rank"), F.length(text).alias("end"), F.lit("").alias("kind"), F.lit("").alias("value"), F.lit(1.0).alias("share"))))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        name = F.when(s["share"] >= remove_from, F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        ahead = F.substring(text, at + 1, F.greatest(s["start"] - at, F.lit(0)))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, F.array(ahead, name)).otherwise(F.array().cast("array<string>"))

    clean = F.array_join(fold(spans, "array<string>", F.lit(0), step), "")
    return found.withColumn("clean_text", F.when(F.size("pii_spans") == 0, F.col("text")).otherwise(clean))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
