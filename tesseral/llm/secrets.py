"""Secrets, found once per content: a ledger of scanned blobs.

Every version that a path ever had is addressed by the SHA-256 of its text. The ledger has which rule
versions have been scanned on which blob and what they found, by place and never by value. A scan reads
the blobs that lack a rule version, for these rule versions only, and joins the findings of all blobs
back to all paths that have them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.working import file_system
from .common import bound, fold, shielded, text_or_empty, working


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: the leftmost non-overlapping matches of `pattern` that `keep` finds fit. A
    text without `hint` has none. A rule that changes takes another version, so that blobs which an
    earlier version has seen are scanned again. Look-behinds and possessive runs say the same as plain
    maximal runs would, without stopping at each short one."""

    kind: str
    pattern: str
    hint: str
    keep: str = "."
    version: int = 1

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


WORDS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
VALUE = "[A-Za-z0-9+/_.=-]"
#: Kinds in the order of the contract, then the operator's own: tokens with a public prefix, keys in
#: PEM, and credentials in addresses.
RULES = (
    Rule("assign", rf"""(?:{WORDS})["']?\x20*[:=]\x20*["']?{VALUE}+""", rf"""(?:{WORDS})["']?\x20*[:=]""", rf"""^[^:=]*[:=]\x20*["']?{VALUE}{{6}}"""),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]", "^.{20}"),
    Rule("hex", "(?<![0-9a-f])[0-9a-f]{24,}+", "[0-9a-f]{24}"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]{36}", "^.{40}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-", "^.{20}"),
    Rule("google", "AIza[A-Za-z0-9_-]+", "AIza[A-Za-z0-9_-]{35}", "^.{39}"),
    Rule("jwt", "(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_.-]++", "eyJ[A-Za-z0-9_-]", r"^eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url", r"://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@", r"://[^\x00-\x20/:@]+:"),
)
BASE = ("assign", "access", "hex")

PLACES = "array<struct<start:int,end:int,rule:string>>"
ENTRY = f"blob binary, rules array<string>, places {PLACES}"
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
#: Up to this many unseen blobs (32 bytes each) are broadcast, so that only their texts are moved.
BROADCAST_BLOBS = 1_000_000


def blob_of(text: Column) -> Column:
    """The address of a content, 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def places(text: Column, rule: Rule) -> Column:
    """Where the rule's matches stand (code points, end exclusive). What lies between matches and the
    matches themselves give the places as running sums of lengths."""
    none = F.array().cast(PLACES)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    pieces = lambda values: F.zip_with(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(values)), values, lambda b, v: F.struct(b.alias("before"), v.alias("value")))

    def step(at: Column, m: Column) -> tuple[Column, Column]:
        start = at + F.length(m["before"])
        end = start + F.length(m["value"])
        one = F.struct(start.alias("start"), end.alias("end"), F.lit(rule.id).alias("rule"))
        return end, F.when(m["value"].rlike(rule.keep), F.array(one)).otherwise(none)

    every = bound(found, lambda values: bound(pieces(values), lambda each: fold(each, PLACES, F.lit(0), step)))
    return F.when(text.rlike(rule.hint), every).otherwise(none)


def entries(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger's rows, or None if nothing has been committed."""
    files, at = file_system(spark, ledger)
    some = files.exists(at) and any(s.getPath().getName().startswith("commit=") for s in files.listStatus(at))
    return spark.read.schema(ENTRY).parquet(ledger).select("blob", "rules", "places") if some else None


def _commit(rows: DataFrame, ledger: str) -> None:
    """Adds rows to the ledger. They are written where readers do not look and get their place by one
    renaming, so that a scan which was broken off has left nothing, and the next one does it again."""
    name = uuid.uuid4().hex
    rows.write.parquet(f"{ledger}/_{name}")
    files, at = file_system(rows.sparkSession, f"{ledger}/_{name}")
    if not files.rename(at, file_system(rows.sparkSession, f"{ledger}/commit={name}")[1]):
        raise OSError(f"cannot commit to {ledger}")


def update(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES) -> None:
    """Scans the texts of `versions` that lack one of the rules, for what they lack, and commits what is
    found. Only addresses are compared with the ledger. Copies are merged in the tasks that read them;
    then each distinct text is moved once at most, and only if a rule has not seen it."""
    spark = versions.sparkSession
    with working(spark) as put:
        every = F.array(*(F.lit(r.id) for r in rules))
        rows = versions.select(blob_of(text_or_empty()).alias("blob"), text_or_empty().alias("text"))
        known = entries(spark, ledger)
        if known is None:
            texts = rows.dropDuplicates(["blob"]).withColumn("rules", every)
        else:
            done = known.select("blob", F.explode("rules").alias("rule"))
            lacking = rows.select("blob").distinct().select("blob", F.explode(every).alias("rule")).join(done, ["blob", "rule"], "left_anti")
            fresh = put(lacking.groupBy("blob").agg(F.collect_set("rule").alias("rules")))
            n = fresh.count()
            if n == 0:
                return
            if n <= BROADCAST_BLOBS:
                rows = rows.join(F.broadcast(fresh.select("blob")), "blob", "left_semi")
            texts = rows.dropDuplicates(["blob"]).join(fresh, "blob")
        none = F.array().cast(PLACES)
        found = F.concat(*(F.when(F.array_contains("rules", r.id), places(F.col("text"), r)).otherwise(none) for r in rules))
        _commit(texts.select("blob", F.array_sort("rules").alias("rules"), found.alias("places")), ledger)


@shielded
def scan(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """`versions` (any columns, a row for each text that a path has had) with secret_spans: (start,
    rank, end, kind) of all that the rules find in the text, by start, then rank, the rule's place in
    `rules`. The ledger, a folder that all executors share, is brought up to date first.

    A null text is empty; repeated rows, and paths of one content, get equal spans; no rows commit
    nothing. Matches of different rules may overlap. A column secret_spans is replaced, others are
    carried along.
    """
    versions = versions.drop("secret_spans")
    update(versions, ledger, rules)
    ids = F.array(*(F.lit(r.id) for r in rules))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    rows = versions.withColumn("__blob", blob_of(text_or_empty()))
    none = F.array().cast(SPANS)
    known = entries(versions.sparkSession, ledger)
    if known is None:
        return rows.drop("__blob").withColumn("secret_spans", none)
    now = F.filter("places", lambda p: F.array_contains(ids, p["rule"]))
    some = known.select("blob", now.alias("now")).where(F.size("now") > 0).select("blob", F.explode("now").alias("p"))

    def span(p: Column) -> Column:
        rank = F.array_position(ids, p["rule"]).cast("int") - 1
        return F.struct(p["start"].alias("start"), rank.alias("rank"), p["end"].alias("end"), F.get(kinds, rank).alias("kind"))

    # a set: two scans at a time may both have committed a blob
    by_blob = some.groupBy(F.col("blob").alias("__blob")).agg(F.array_sort(F.transform(F.collect_set("p"), span)).alias("__spans"))
    joined = rows.join(by_blob, "__blob", "left")
    return joined.select(*versions.columns, F.coalesce("__spans", none).alias("secret_spans"))
