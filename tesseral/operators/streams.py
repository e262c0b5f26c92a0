"""One sequential random stream, used by many tasks.

Python's generator is a Mersenne twister that rejects some of its outputs, so where the k-th decision
stands in the stream depends on all before it. Blocks of outputs are told by the generator's state at
their beginning; tasks count what their blocks decide, and the sums of those counts tell each block the
number of its first decision.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Outputs of a block at least, and blocks at most; a block's state has 2.5 kB.
BLOCK, BLOCKS = 1 << 20, 4096
STATES = "block int, key binary, pos int"


def _generator(key: bytes, pos: int) -> np.random.MT19937:
    bits = np.random.MT19937()
    bits.state = {"bit_generator": "MT19937", "state": {"key": np.frombuffer(key, np.uint32), "pos": pos}}
    return bits


def _decisions(key: bytes, pos: int, size: int) -> np.ndarray:
    """The choices between two that a block's outputs make: the upper two bits, where they are 0 or 1."""
    upper = _generator(key, pos).random_raw(size) >> 30
    return upper[upper < 2].astype(np.int8)


def _states(seed: int, blocks: int, size: int) -> list[tuple[int, bytes, int]]:
    """The generator's states at the beginnings of blocks. Only the states are kept."""
    *key, pos = random.Random(seed).getstate()[1]
    bits, out = _generator(np.array(key, np.uint32).tobytes(), pos), []
    for b in range(blocks):
        now = bits.state["state"]
        out.append((b, now["key"].astype(np.uint32).tobytes(), int(now["pos"])))
        bits.random_raw(size, output=False)
    return out


def two_way_shuffles(spark: SparkSession, seed: int, n: int, *, block: int = BLOCK) -> DataFrame:
    """(ordinal, swapped) for 0 to n - 1: what n shuffles of two items by `random.Random(seed)`, one
    after another, do to each. The driver runs through the stream once, without looking at it."""
    if n < 1:
        return spark.createDataFrame([], "ordinal long, swapped boolean")
    size = max(block, -(-2 * n // BLOCKS))
    blocks = math.ceil((2 * n + 12 * math.sqrt(2 * n) + 64) / size)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"block": rows.block, "n": [len(_decisions(k, p, size)) for k, p in zip(rows.key, rows.pos)]})

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for key, pos, first in zip(rows.key, rows.pos, rows.ordinal):
                made = _decisions(key, pos, size)[: max(n - first, 0)]
                yield pd.DataFrame({"ordinal": np.arange(first, first + len(made)), "swapped": made == 0})

    while True:
        known = _states(seed, blocks, size)
        states = spark.createDataFrame(known, STATES).repartition(min(blocks, 4 * spark.sparkContext.defaultParallelism))
        counts = {r.block: r.n for r in states.mapInPandas(counted, "block int, n long").collect()}
        if sum(counts.values()) >= n:
            break
        blocks *= 2
    firsts = np.concatenate([[0], np.cumsum([counts[b] for b in range(blocks)])[:-1]])
    rows = spark.createDataFrame([(*s, int(f)) for s, f in zip(known, firsts) if f < n], f"{STATES}, ordinal long")
    return rows.repartition(min(blocks, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(placed, "ordinal long, swapped boolean")
