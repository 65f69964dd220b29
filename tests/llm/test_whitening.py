"""Whitening against numpy's eigenvectors of the whole covariance."""

import math

import numpy as np
import pytest

from vacantia.llm import whitening
from vacantia.llm.queries import op13_whitening

from conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n double"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", 0.0) for i, v in vectors], SCHEMA)


def reference(vectors, components=32):
    """Kept rows and, for each, what the query returns, but for the signs of components."""
    rows = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(rows), x.sum(axis=0)
    dev = [int(sum((n * a - b) ** 2 for a, b in zip(r, s))) for r in x]
    y = np.array([[float(n * a - b) / n for a, b in zip(r, s)] for r in x])
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, int((e > 1e-20 * e[0]).sum() if e[0] > 0 else 0))
    return [i for i, _ in rows], dev, y, e, v[:, :k], k


def compared(df, vectors, components=32):
    ids, dev, y, e, v, k = reference(vectors, components)
    got = df.toPandas()
    assert len(got) == len(ids) * k and set(got.n) == {len(ids)} and sorted(got.component.unique()) == list(range(1, k + 1))
    for c in range(k):
        part = got[got.component == c + 1].sort_values(["vec_id", "deviation", "whitened"])
        want = y @ v[:, c] / np.sqrt(e[c])
        order = sorted(range(len(ids)), key=lambda i: ids[i])
        assert part.vec_id.tolist() == [ids[i] for i in order] and part.deviation.tolist() == [dev[i] for i in order]
        a, b = part.whitened.to_numpy(), want[order]
        sign = 1 if a @ b > 0 else -1
        assert np.allclose(a, sign * b, atol=1e-7)
        assert np.allclose(part.explained, e[c] / e.sum(), rtol=1e-9)
    assert got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1


def test_query_against_eigenvectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compared(op13_whitening(spark, SF), rows)


def test_odd_vectors(spark):
    random = np.random.default_rng(1)
    good = [(i, random.normal(0, [3, 1, 0.5, 2, 0.1]).astype(np.float32).tolist()) for i in range(40)]
    odd = [(50, None), (51, []), (52, [1.0, None, 0.0, 0.0, 0.0]), (53, [float("nan"), 0.0, 0.0, 0.0, 0.0]), (54, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    compared(whitening.whitened(table(spark, good + odd)), [r for r in good + odd if r[1] != []])
    other_length = [(60, [1.0, 2.0])]
    assert whitening.whitened(table(spark, good + other_length)).select("vec_id").distinct().count() == 40
    twice = whitening.whitened(table(spark, good + good + [(None, good[0][1])]))
    assert twice.filter("n = 81").count() == 81 * 5 and twice.filter("vec_id IS NULL").count() == 5


def test_degenerate_tables(spark):
    same = [(i, [0.5, 0.25]) for i in range(4)]
    assert whitening.whitened(table(spark, same)).collect() == []
    assert whitening.whitened(table(spark, [])).collect() == [] and whitening.whitened(table(spark, [(1, None)])).collect() == []
    line = [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)]  # one direction only
    compared(whitening.whitened(table(spark, line)), line)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_eigenvalues(spark, seed):
    """All directions alike: the vectors reached are exhausted at once and fresh ones go on."""
    unit = [(2 * i + (s > 0), [s * float(i == j) for j in range(4)]) for i in range(4) for s in (-1, 1)]
    got = whitening.whitened(table(spark, unit)).toPandas()
    assert len(got) == 8 * 4 and got.identity_error.max() < 1e-12 and np.allclose(got.explained, 0.25)


def test_bidiagonal_form(spark):
    """X V = U B with B bidiagonal and both sides orthonormal, on rows that the driver also holds."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").limit(100).collect()]
    _, _, y, _, _, _ = reference(rows)
    x = whitening.Centred(whitening.fixed_point(table(spark, rows)), 64, 100)
    v, alpha, beta = whitening.bidiagonalised(x, 20)
    assert np.allclose(v.T @ v, np.eye(20), atol=1e-12)
    u = np.linalg.solve((np.diag(alpha) + np.diag(beta, 1)).T, (y / 10 @ v).T).T
    assert np.allclose(u.T @ u, np.eye(20), atol=1e-9)


def test_long_deviations():
    x = np.array([[10**6, 5]])
    n, s = 10**9, np.array([10**9 * 5, 10**9 * 5])
    assert whitening._deviations(x, s // n, s, n) == [None]
    assert whitening._deviations(np.array([[7, 5]]), s // n, s, n) == [(2 * 10**9) ** 2]
