"""Whitening of embeddings by matrix-free block Lanczos.

The covariance matrix is never formed. Each step multiplies it with a block of vectors in one pass over
the fit list: a task adds up C'(CQ) over its rows, and what comes back has the size of the block. The
driver holds the Krylov basis, whose size is that of the vectors and does not depend on their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shielded, working

#: An entry c becomes the integer floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Larger entries count as not finite, for their integers would not be exact.
LARGEST = 2.0**46
COMPONENTS = 16
#: Vectors in a block; twice the components, so that a pass over the rows goes twice as far.
BLOCK = 2 * COMPONENTS
#: The norm of a residual Vy - ey that counts as converged, and one from which a residual that no longer
#: falls does, as parts of the largest eigenvalue. With a full basis the result is exact in any case.
TOLERANCE, STALLED = 1e-14, 1e-12
#: What is left of a block's vector, as part of the largest eigenvalue, from which on it counts as lost.
BREAKDOWN = 1e-10
#: Eigenvalues from this part of the largest on are taken for zero: such a component has no spread.
NO_SPREAD = 1e-12
#: Numbers that a task computes with at once.
CELLS = 1 << 20
LONGEST = 2**63 - 1


@dataclass(frozen=True)
class Whitening:
    """The fit: n distinct integer vectors with these sums, the components in columns with their
    eigenvalues, their shares of the trace, and how far the whitened fit list is from white."""

    n: int
    sums: list[int]
    vectors: np.ndarray = field(repr=False)
    values: np.ndarray
    explained: list[float]
    identity_error: float


def usable(column: str) -> Column:
    """Whether a vector has entries and all are finite."""
    fine = lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False))
    return F.coalesce(F.forall(column, fine) & (F.size(column) > 0), F.lit(False))


def integers(column: str) -> Column:
    return F.transform(column, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)


def _blocks(x: pa.Array, d: int) -> Iterator[np.ndarray]:
    """The rows of an array of lists as matrices of CELLS numbers at most."""
    rows = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    step = max(CELLS // d, 1)
    for i in range(0, len(rows), step):
        yield rows[i : i + step]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: the integer part of the mean goes exactly, the rest is rounded once."""
    whole = np.array([s // n for s in sums])
    return (x - whole) - np.array([(s % n) / n for s in sums])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum over the dimensions of (n*x - S)^2 for each row, exact at any size."""
    about = ((_centred(x, n, sums) * float(n)) ** 2).sum(axis=1)
    if about.size and about.max() < 2.0**62 and max(map(abs, sums)) < 2**62 and float(np.abs(x).max()) * n < 2.0**62:
        return ((n * x - np.array(sums)) ** 2).sum(axis=1).tolist()
    return [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]


def _summed(fit: DataFrame, d: int, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of a matrix that `of` makes from a block of them. Each task adds up its
    own; the tasks' sums are added by row, so none meets more than one row of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for x in _blocks(batch.column(0), d):
                total = total + of(x)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["row", "v"])

    parts = fit.select("x").mapInArrow(run, "row int, v array<double>")
    rows = parts.groupBy("row").agg(F.array(*(F.sum(F.col("v")[j]) for j in range(width))).alias("v")).orderBy("row").collect()
    return np.array([r["v"] for r in rows])


def _totals(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows and the sum of each dimension, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, dtype=object)
        for batch in batches:
            n += batch.num_rows
            for x in _blocks(batch.column(0), d):
                fits = int(np.abs(x).max()) < 2**62 // len(x)
                total += np.array((x if fits else x.astype(object)).sum(axis=0).tolist(), dtype=object)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([str(v) for v in (n, *total)])], ["row", "v"])

    parts = fit.select("x").mapInArrow(run, "row int, v string")
    rows = parts.groupBy("row").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).orderBy("row").collect()
    every = [int(r["v"]) for r in rows] or [0] * (d + 1)
    return every[0], every[1:]


def _orthogonal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The block without its parts along the basis; twice, as once is not enough."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    return block


def _next_block(rest: np.ndarray, basis: np.ndarray, width: int, least: float, rng: np.random.Generator) -> np.ndarray:
    """An orthonormal block that goes on from what is left of the last product. Directions that are lost
    (breakdown: the Krylov space is exhausted along them) are restarted at random."""
    d, m = basis.shape
    left, sizes, _ = np.linalg.svd(rest, full_matrices=False)
    block = left[:, sizes > least]
    fresh = rng.standard_normal((d, max(width - block.shape[1], 0)))
    block = _orthogonal(np.hstack([block, fresh])[:, : d - m], basis)
    q, _ = np.linalg.qr(block)
    q, _ = np.linalg.qr(_orthogonal(q, basis))
    return q


def block_lanczos(product: Callable[[np.ndarray], np.ndarray], d: int, count: int, *, block: int = BLOCK, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues of a symmetric matrix without negative ones, falling, and unit
    eigenvectors in columns. `product` multiplies the matrix with a block of vectors. A block has no
    fewer vectors than are wanted: from a random one, each of equal eigenvalues is found as well."""
    rng, block = np.random.default_rng(seed), max(block, count)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    q, _ = np.linalg.qr(rng.standard_normal((d, min(block, d))))
    seen: list[float] = []
    while True:
        w = product(q)
        basis, image = np.hstack([basis, q]), np.hstack([image, w])
        small = basis.T @ image
        values, y = np.linalg.eigh((small + small.T) / 2)
        values, y = values[::-1][:count], y[:, ::-1][:, :count]
        largest = max(values[0], 0.0)
        residual = np.linalg.norm(image @ y - (basis @ y) * values, axis=0).max()
        seen.append(residual)
        enough = basis.shape[1] >= min(count, d)
        stalled = len(seen) > 3 and residual <= STALLED * largest and residual > min(seen[:-3]) / 2
        if basis.shape[1] == d or enough and (residual <= TOLERANCE * largest or stalled):
            vectors = basis @ y
            return values, vectors / np.linalg.norm(vectors, axis=0)
        q = _next_block(_orthogonal(w, basis), basis, block, BREAKDOWN * largest, rng)


def fit(rows: DataFrame, column: str = "embedding", *, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct integer vectors of `rows`; None if no vector is usable.

    Vectors that are null, empty, or have null, infinite, not-a-number or very large entries do not
    count, nor do those of another length than most (of equally frequent lengths the largest counts).
    Repeated vectors count once. Fewer components come out if the vectors are shorter or have less
    spread; one vector has none. Of equal eigenvalues any orthogonal components may come.
    """
    some = rows.where(usable(column)).select(integers(column).alias("x"))
    most = some.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not most:
        return None
    d = most[0]["d"]
    with working(rows.sparkSession) as put:
        listed = put(some.where(F.size("x") == d).distinct())
        n, sums = _totals(listed, d)
        values, vectors = block_lanczos(lambda q: _summed(listed, d, q.shape[1], lambda x: (lambda c: c.T @ (c @ q))(_centred(x, n, sums))) / n, d, components)
        spread = values > max(values[0], 0.0) * NO_SPREAD
        values, vectors = values[spread], vectors[:, spread]
        k = len(values)
        matrix = vectors / np.sqrt(values)

        def white(x: np.ndarray) -> np.ndarray:
            """z'z above, and the deviations' sum below."""
            z = _centred(x, n, sums) @ matrix
            spread = (_centred(x, n, sums) ** 2).sum()
            return np.vstack([z.T @ z, np.full((1, max(k, 1)), spread)]) if k else np.full((1, 1), spread)

        both = _summed(listed, d, max(k, 1), white) / n
    trace = both[-1, 0]
    error = float(np.abs(both[:-1] - np.eye(k)).max()) if k else 0.0
    return Whitening(n, sums, vectors, values, [float(e / trace) for e in values], error)


@shielded
def apply(rows: DataFrame, model: Whitening | None, column: str = "embedding") -> DataFrame:
    """The usable rows with deviation, the sum over the dimensions of (n*x - S)^2 (exact; null if it is
    too large for a long), and whitened, x - S/n projected on each component, over its spread.

    Rows whose vector is not usable, or has another length than the fit list, are dropped. Repeated
    rows fare alike. Columns named deviation or whitened are replaced, others are carried along.
    """
    from pyspark.sql.functions import arrow_udf

    rows = rows.drop(*({"deviation", "whitened"} - {column}))
    d = len(model.sums) if model else 0
    n, sums = (model.n, model.sums) if model else (1, [])
    matrix = model.vectors / np.sqrt(model.values) if model else np.zeros((0, 0))

    @arrow_udf("struct<deviation:bigint,whitened:array<double>>")
    def project(x: pa.Array) -> pa.Array:
        deviations, whitened = [], []
        for block in _blocks(x, d):
            deviations += _deviations(block, n, sums)
            whitened.append(_centred(block, n, sums) @ matrix)
        each = np.vstack(whitened) if whitened else np.zeros((0, matrix.shape[1]))
        offsets = np.arange(len(x) + 1, dtype=np.int32) * matrix.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(each.ravel(), pa.float64()))
        return pa.StructArray.from_arrays([pa.array([v if v <= LONGEST else None for v in deviations], pa.int64()), lists], ["deviation", "whitened"])

    out = rows.where(usable(column) & (F.size(column) == d)).withColumn("__w", project(integers(column)))
    return out.select(*(c for c in rows.columns if c not in ("deviation", "whitened")), "__w.deviation", "__w.whitened")
