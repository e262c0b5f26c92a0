"""Best-fit packing of tokenised documents into sequences of a fixed length.

The plan is made over the histogram of piece lengths, never over documents: best-fit decreasing
places the count of each length into counted runs of equally filled sequences. Documents then take
the planned slots by joining on their rank within their length.
"""

from __future__ import annotations

import functools
import heapq
import json
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, settle, sparing

CONTEXT, END_ID = 4096, 1
#: Words whose ids a worker remembers; when full, the older half is forgotten.
CACHE_WORDS = 500_000
#: Plans of up to this many runs (about 40 bytes each) are broadcast; longer ones are joined by a shuffle.
BROADCAST_RUNS = 100_000
# How a tokenizer must normalise and cut texts for their stretches between blanks to be
# looked up one by one (its definition's own entries). Any other tokenizer gets whole texts.
STRETCHED = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Run(NamedTuple):
    """`length`-token pieces of rank first..last-1 fill sequences from `sequence` on, `each` per
    sequence, the first of them at `offset`."""

    length: int
    first: int
    last: int
    sequence: int
    each: int
    offset: int


def plan_best_fit(counts: dict[int, int], capacity: int = CONTEXT) -> list[Run]:
    """Best-fit decreasing over counts. Sequences with equal room form runs (first sequence, how
    many); a length takes the tightest runs that hold it, whole runs at a time. Each length splits
    at most one run and opens at most one, so the work follows the number of distinct lengths (at
    most `capacity`), not the number of pieces."""
    room: dict[int, list[tuple[int, int]]] = {}
    opened, plan = 0, []
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit into {capacity}")
        left, rank = counts[length], 0
        open_rooms = [r for r in room if r >= length]
        heapq.heapify(open_rooms)
        while left:
            if open_rooms:
                free = open_rooms[0]
                first, many = room[free].pop()
                if not room[free]:
                    heapq.heappop(open_rooms)
                    del room[free]
            else:
                free = capacity
                first, many = opened, -(-left // (capacity // length))
                opened += many
            each = free // length
            full = min(many, left // each)
            if full:
                plan.append(Run(length, rank, rank + full * each, first, each, capacity - free))
                rank, left = rank + full * each, left - full * each
                _put(room, free - each * length, first, full)
            if left and full < many:  # fewer than `each` are left: they share one sequence
                plan.append(Run(length, rank, rank + left, first + full, each, capacity - free))
                _put(room, free - left * length, first + full, 1)
                full, left = full + 1, 0
            if full < many:
                _put(room, free, first + full, many - full)
    return plan


def _put(room: dict[int, list[tuple[int, int]]], free: int, first: int, many: int) -> None:
    if free and many:
        room.setdefault(free, []).append((first, many))


class _Words(dict):
    """Ids, as bytes, of the stretches between blanks, for tokenizers that are STRETCHED. Blanks never fall inside a token of this
    tokenizer, so a text's ids are those of its stretches in turn. A stretch of Latin-1 letters goes
    to the tokenizer's model in lower case, with its trailing ASCII marks apart, as the tokenizer
    itself cuts there; any other stretch goes through the whole tokenizer."""

    LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
    MARKS = ".,;:!?%&*#$|-"

    def __init__(self, tokenizer):
        super().__init__({"": b""})
        self.tokenizer, self.older, self.letters = tokenizer, {}, frozenset(self.LETTERS)
        told = json.loads(tokenizer.to_str())
        marked = all("<|" in t["content"] and not t["normalized"] for t in told["added_tokens"])
        self.stretched = marked and told["model"]["type"] == "BPE" and all(told[k] == v for k, v in STRETCHED.items())
        if not self.stretched:
            return
        self.plain = {ord(c): tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in self.LETTERS}
        self.marks: dict[str, bytes] = {"": b""}
        self.tokenize = tokenizer.model.tokenize

    def __missing__(self, stretch: str) -> bytes:
        if (found := self.older.get(stretch)) is None:
            found = self._look(stretch)
        if len(self) >= CACHE_WORDS // 2:
            self.older = dict(self)
            self.clear()
            self[""] = b""
        self[stretch] = found
        return found

    def forget(self) -> None:
        """Ids are kept within a task: its worker lives on, and other stages need the memory."""
        self.clear()
        self.older = {}
        self[""] = b""

    def _look(self, stretch: str) -> bytes:
        stem = stretch.rstrip(self.MARKS)
        low = stem.lower()
        if low and len(low) == len(stem) and self.letters.issuperset(low) and max(stem) <= "\xff":
            if low != stretch:
                marks = stretch[len(stem) :]
                if (end := self.marks.get(marks)) is None:
                    end = self.whole(marks)
                    if len(self.marks) < 10_000:
                        self.marks[marks] = end
                return self[low] + end
            letters = low if low.isascii() else low.translate(self.plain)
            return array("I", [t.id for t in self.tokenize(letters)]).tobytes()
        return self.whole(stretch)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@functools.cache
def _words(path: str) -> _Words:
    from tokenizers import Tokenizer

    return _Words(Tokenizer.from_file(path))


def encode(text: str, words: _Words) -> bytes:
    """The text's ids as little-endian unsigned 32-bit numbers."""
    if not words.stretched:
        return words.whole(text)
    if "<|" not in text:  # there may be a special token, which is told by its case
        try:
            text.encode("latin-1")  # such texts are in composed form, and lower case keeps their letters
            text = text.lower()
        except UnicodeEncodeError:
            pass
    return b"".join(map(words.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenise(docs: DataFrame, *, tokenizer: str | None = None, context: int = CONTEXT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids. A
    document is its ids and `end_id`; only longer ones than `context` are cut, into whole contexts
    and a rest. A null text is empty: one piece with the end id alone."""
    path = tokenizer or default_tokenizer()
    end = np.asarray([end_id], "<u4").tobytes()

    @sparing
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        try:
            yield from encoded(batches, words)
        finally:
            words.forget()

    def encoded(batches: Iterator[pa.RecordBatch], words: _Words) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "", words) + end
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, context)):
                    own = ids[4 * start : 4 * (start + context)]
                    row = (doc_id, k, start, len(own) // 4, zlib.crc32(own), np.frombuffer(own, "<u4") if with_ids else None)
                    for column, value in zip(out, row):
                        column.append(value)
                    held += len(own)
                if held > 1 << 26:
                    yield _batch(out, with_ids)
                    out, held = [[], [], [], [], [], []], 0
            yield _batch(out, with_ids)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, PIECES + ", ids array<long>" * with_ids)


def _batch(out: list[list], with_ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


def ranked(pieces: DataFrame) -> DataFrame:
    """`pieces` with __rank, their number from 0 within their length. A length may hold a third of
    all rows, so rows are numbered within (length, share by hash) and moved on by the counts of the
    shares before: at most `context` lengths times as many shares as there are partitions."""
    share = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(partitions(pieces.sparkSession)))
    dealt = pieces.withColumn("__share", share)
    before = Window.partitionBy("length").orderBy("__share").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "__share").agg(F.count("*").alias("__n"))
    base = counts.select("length", "__share", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("length", "__share").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = dealt.withColumn("__nth", F.row_number().over(within))
    return numbered.join(base, ["length", "__share"]).withColumn("__rank", F.col("__base") + F.col("__nth") - 1)


def pack(pieces: DataFrame, *, context: int = CONTEXT) -> DataFrame:
    """`pieces` with sequence_id and offset: the place of each in as few sequences of `context`
    tokens as best-fit decreasing finds. `pieces` should be cheap to read again (see `settle`).

    Repeated rows each get a place of their own; null ids rank first. An empty table gives an empty
    result. Columns named sequence_id or offset are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_best_fit(counts, context)
    runs = spark.createDataFrame(plan, "length long, __first long, __last long, __sequence long, __each long, __offset long")
    if len(plan) <= BROADCAST_RUNS:
        runs = F.broadcast(runs)
    inside = (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__last"))
    placed = ranked(pieces).join(runs.withColumnRenamed("length", "__length"), (F.col("length") == F.col("__length")) & inside)
    along = F.col("__rank") - F.col("__first")
    return placed.select(
        *pieces.columns,
        (F.col("__sequence") + F.expr("(__rank - __first) div __each")).alias("sequence_id"),
        (F.col("__offset") + along % F.col("__each") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, *, tokenizer: str | None = None, context: int = CONTEXT, end_id: int = END_ID) -> DataFrame:
    """The pieces of `docs` with their places. Texts of any length, null (empty) ones, null ids and
    repeated rows all keep their pieces; other columns of `docs` are not looked at. Pieces of equal
    length are placed by rank: which of them gets which slot does not matter for the packing. An empty
    table gives none."""
    return pack(settle(tokenise(docs, tokenizer=tokenizer, context=context, end_id=end_id)), context=context)


def sequences(docs: DataFrame, *, tokenizer: str | None = None, context: int = CONTEXT, end_id: int = END_ID) -> DataFrame:
    """The packed training sequences themselves: sequence_id, ids, doc_ids and their offsets. A
    sequence holds `context` ids at most, so that is what meets in a group. Null and empty texts add
    their end id, null ids stay null, repeated rows are packed each, an empty table gives none."""
    pieces = settle(tokenise(docs, tokenizer=tokenizer, context=context, end_id=end_id, with_ids=True))
    part = F.struct("offset", "doc_id", "ids")
    grouped = pack(pieces, context=context).groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return grouped.select(
        "sequence_id",
        F.flatten("parts.ids").alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
        F.col("parts.offset").alias("offsets"),
    )
