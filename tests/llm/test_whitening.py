import math

import duckdb
import numpy as np
import pytest

from tesseral.llm import queries, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors, components=16):
    """Integers, covariance and eigenvectors in one place, by the whole matrix."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(col) for col in zip(*fit)]
    c = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in fit])
    values, vecs = np.linalg.eigh(c.T @ c / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    trace = sum(sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in fit) / n**3
    k = min(components, int((values > values[0] * 1e-12).sum()))
    rows = [[(n * a - s) / n for a, s in zip(row, sums)] for row in x]
    white = np.array(rows) @ vecs[:, :k] / np.sqrt(values[:k])
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, sums, white, deviations, values[:k] / trace


def same_but_signs(got, want, tolerance):
    for j in range(want.shape[1]):
        sign = np.sign(got[:, j] @ want[:, j])
        assert np.abs(got[:, j] * sign - want[:, j]).max() < tolerance


def test_query_equals_the_whole_matrix(spark):
    rows = duckdb.sql(f"select vec_id, embedding from read_parquet('{SF}/embeddings.parquet') order by 1").fetchall()
    n, _, white, deviations, explained = brute([v for _, v in rows])
    got = queries.QUERIES["op11_embedding_whitening"](spark, SF)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    got = got.orderBy("vec_id", "component").collect()
    assert len(got) == 16 * len(rows) and [r.component for r in got[:16]] == list(range(1, 17))
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    assert [r.deviation for r in got[::16]] == deviations
    assert np.allclose([r.explained for r in got[:16]], explained, rtol=1e-9)
    same_but_signs(np.array([r.whitened for r in got]).reshape(-1, 16), white, 1e-7)


def test_repeats_odd_vectors_and_clashing_names(spark):
    rng = np.random.default_rng(3)
    good = [[float(np.float32(a)) for a in v] for v in rng.normal(0, 2, (60, 5)) * [9, 5, 3, 2, 1]]
    odd = [None, [], [1.0, None, 1.0, 1.0, 1.0], [1.0, math.nan, 1.0, 1.0, 1.0], [math.inf, 1.0, 1.0, 1.0, 1.0], [1e30] * 5, [1.0, 2.0]]
    rows = [(i, v) for i, v in enumerate(good + good[:20] * 9 + odd)] + [(None, good[0]), (0, good[0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'own' as __w", "1 as whitened")
    model = whitening.fit(df)
    n, sums, white, deviations, explained = brute(good)
    assert (model.n, model.sums) == (n, sums) == (60, sums)
    assert model.identity_error < 1e-12 and np.allclose(model.explained, explained) and abs(sum(model.explained) - 1) < 1e-12
    out = whitening.apply(df, model)
    assert out.columns == ["vec_id", "embedding", "__w", "deviation", "whitened"]
    got = out.collect()
    assert len(got) == 60 + 180 + 2 and {r["__w"] for r in got} == {"own"}
    first = sorted((r for r in got if r.vec_id is not None and r.vec_id < 60), key=lambda r: r.vec_id)
    assert [r.deviation for r in first][1:] == deviations[:1] + deviations[1:]
    same_but_signs(np.array([r.whitened for r in first[1:]]), white, 1e-9)
    assert len({tuple(r.whitened) for r in got if r.vec_id in (None, 0, 60)}) == 1


@pytest.mark.parametrize("vectors,components", [([], 0), ([None], 0), ([[1.0, 2.0]], 0), ([[1.0, 2.0]] * 4, 0), ([[0.0, 0.0], [1.0, 1.0]], 1), ([[0.0], [1.0], [3.0]], 1)])
def test_little_or_no_spread(spark, vectors, components):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], SCHEMA)
    model = whitening.fit(df)
    got = whitening.apply(df, model).collect()
    assert len(got) == sum(v is not None for v in vectors) and all(len(r.whitened) == components for r in got)


def test_numbers_beyond_a_long(spark):
    vectors = [[2.0**40, 0.0], [-(2.0**40), 1.0], [0.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), SCHEMA)
    model = whitening.fit(df)
    got = {r.vec_id: r.deviation for r in whitening.apply(df, model).collect()}
    want = brute(vectors)[3]
    assert got == {i: v if v < 2**63 else None for i, v in enumerate(want)} and None in got.values()


class TestLanczos:
    def run(self, matrix, count, **options):
        passes = []

        def product(q):
            passes.append(q.shape[1])
            return matrix @ q

        values, vectors = whitening.block_lanczos(product, len(matrix), count, **options)
        assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-12
        return values, vectors, passes

    def test_stops_before_the_basis_is_full(self):
        rng = np.random.default_rng(1)
        q, _ = np.linalg.qr(rng.normal(size=(600, 600)))
        want = 0.8 ** np.arange(600)
        values, vectors, passes = self.run((q * want) @ q.T, 16)
        assert np.abs(values - want[:16]).max() < 1e-14 and sum(passes) < 300
        assert np.abs(np.abs(np.sum(vectors * q[:, :16], axis=0)) - 1).max() < 1e-12

    def test_restarts_on_breakdown_and_finds_equal_eigenvalues(self):
        rng = np.random.default_rng(2)
        q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
        want = np.array([3.0] * 6 + [1.0] * 2 + [0.0] * 32)
        values, vectors, passes = self.run((q * want) @ q.T, 10, block=2)
        assert np.abs(values - want[:10]).max() < 1e-13 and passes[0] == 10
        # what goes on from ten vectors has eight directions; two begin anew
        block = q[:, :10]
        rest = np.hstack([q[:, 10:18], np.zeros((40, 2))])
        more = whitening._next_block(rest, block, 10, 1e-9, rng)
        assert more.shape == (40, 10) and np.abs(np.hstack([block, more]).T @ np.hstack([block, more]) - np.eye(20)).max() < 1e-13
        assert np.linalg.norm(q[:, 10:18].T @ more, axis=1).min() > 1 - 1e-12
        assert np.linalg.norm(q[:, :6].T @ vectors[:, :6], axis=0).min() > 1 - 1e-12

    def test_nothing_at_all(self):
        values, vectors, _ = self.run(np.zeros((5, 5)), 3)
        assert (values == 0).all() and vectors.shape == (5, 3)
