"""What the corpus operators share: reading, whitespace, content keys and shared working tables."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.working import new_path, remove, settle, shared_dir, working

__all__ = [
    "BLOCK", "SPACE", "SPACE_CHARS", "bound", "content_keys", "fold", "has_word", "new_path", "paired", "partitions", "read_table",
    "remove", "settle", "shared_dir", "shielded", "sparing", "text_or_empty", "words_of", "working",
]

#: Characters that separate words wherever a contract speaks of white space.
SPACE = r"[\x20\x09-\x0D]"
BLOCK = 128
SPACE_CHARS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shielded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Operators name their own working columns with two leading underscores. Columns of the input
    that begin like that have other names while the operator runs, and their own in its result."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        away = {c: f"own{i}_{uuid.uuid4().hex}" for i, c in enumerate(docs.columns) if c.startswith("__")}
        out = operator(docs.withColumnsRenamed(away), *args, **options)
        return out.withColumnsRenamed({v: k for k, v in away.items()})

    return run


def sparing(work: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """For functions of mapInArrow: what Arrow keeps of freed batches is given back between batches and at
    the task's end. Spark's Python workers live on from stage to stage, beside the executor's JVM."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for made in work(batches):
                yield made
                del made
                pa.default_memory_pool().release_unused()
        finally:
            pa.default_memory_pool().release_unused()

    return run


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """The runs of characters other than white space, in order."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def has_word(text: Column) -> Column:
    return F.translate(text, SPACE_CHARS, "") != ""


def content_keys(*columns: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that together stand for the columns' values (128 bits)."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(0x5EED), *columns)


def paired(a: str, b: str, gap: int) -> Column:
    """Hashes of (a[i], b[i + gap]) for two arrays of equal length: how hashes of longer word windows
    are built from those of shorter ones without slicing any window out."""
    rest = f"greatest(size({a}) - {gap}, 0)"
    return F.expr(f"zip_with(slice({a}, 1, {rest}), slice({b}, {gap + 1}, {rest}), (x, y) -> xxhash64(x, y))")


def fold(items: Column, kind: str, start: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """A left fold over an array that collects an array: step(state, item) gives the next state and
    an array (of type `kind`) to append. Appending copies what is there, so the fold works on blocks
    of BLOCK items and appends block by block: an array of n items costs n * BLOCK + (n / BLOCK)^2."""
    none, nones = F.array().cast(kind), F.array().cast(f"array<{kind}>")
    count = F.ceil(F.size(items) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda b: F.slice(items, (b - 1) * BLOCK + 1, F.lit(BLOCK)))

    def inner(acc: Column, item: Column) -> Column:
        state, more = step(acc["state"], item)
        return F.struct(state.alias("state"), F.concat(acc["all"], more).alias("all"))

    def outer(acc: Column, block: Column) -> Column:
        begin = F.struct(acc["last"]["state"].alias("state"), none.alias("all"))
        last = F.aggregate(block, begin, inner)
        return F.struct(last.alias("last"), F.concat(acc["done"], F.array(acc["last"]["all"])).alias("done"))

    first = F.struct(F.struct(start.alias("state"), none.alias("all")).alias("last"), nones.alias("done"))
    return F.aggregate(blocks, first, outer, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["last"]["all"]))))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
