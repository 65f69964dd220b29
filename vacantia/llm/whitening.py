"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation over distributed rows.

X holds the centred rows over the square root of their number, so that its squared singular values are the eigenvalues of
the covariance. Each step reads the rows once: a task works out Xv for its rows and adds up X'(Xv), U'(Xv) and the
square of Xv; Spark adds the tasks' sums per place. The left vectors have an entry per row and are never kept: each is X
times a short vector that the driver knows, and is worked out again beside Xv. Left vectors are made orthogonal to all
before through U'(Xv), right ones on the driver, where everything is as long as a row at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
#: Entries are cut to this, far beyond any embedding, so that none overflows.
FAR = float(1 << 40)


def fixed_point(table: DataFrame, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id, x: floor(scale * c) + shift of each entry c; rows that are null or hold a null or non-finite entry go."""
    finite = F.forall("embedding", lambda c: F.coalesce((c.cast("double") < float("inf")) & (c.cast("double") > float("-inf")), F.lit(False)))
    near = lambda c: F.least(F.greatest(c.cast("double") * scale, F.lit(-FAR)), F.lit(FAR))
    kept = table.filter(F.col("embedding").isNotNull() & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: F.floor(near(c)).cast("long") + shift).alias("x"))


def _matrix(batch, d: int):
    import numpy as np

    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _summed(rows: DataFrame, d: int, of, kind: str = "double"):
    """Sums over all rows of `of(matrix) -> vector`: added up in the tasks, then for each place by Spark."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        total = None
        for b in batches:
            if b.num_rows:
                now = of(_matrix(b, d))
                total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "value"])

    got = rows.select("x").mapInArrow(run, f"i bigint, value {kind}").groupBy("i").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(got), np.int64 if kind == "bigint" else np.float64)
    for r in got:
        out[r.i] = r.value
    return out


class Centred:
    """The rows of x, less their mean, over the square root of their number."""

    def __init__(self, rows: DataFrame, d: int, n: int):
        import numpy as np

        self.rows, self.d, self.n = rows, d, n
        self.sums = _summed(rows, d, lambda x: x.sum(axis=0), "bigint")
        # n * x - sums without a long product: the mean's whole part is taken off first.
        self.whole, self.rest = self.sums // n, (self.sums % n) / n
        self.root = np.sqrt(n)

    def centred(self):
        whole, rest = self.whole, self.rest
        return lambda x: (x - whole) - rest

    def products(self, p, left):
        """For u = Xp: X'u, U'u and u'u, where U = X `left`."""
        import numpy as np

        centred, root, all_ = self.centred(), self.root, np.column_stack([p, left])

        def of(x):
            y = centred(x) / root
            u = y @ all_
            return np.concatenate([y.T @ u[:, 0], u[:, 1:].T @ u[:, 0], [u[:, 0] @ u[:, 0]]])

        out = _summed(self.rows, self.d, of)
        return out[: self.d], out[self.d : -1], out[-1]

    def trace(self) -> float:
        centred, root = self.centred(), self.root
        return float(_summed(self.rows, self.d, lambda x: ((centred(x) / root) ** 2).sum(axis=0)).sum())


def _orthogonal(v, to):
    for _ in range(2):
        v = v - to @ (to.T @ v)
    return v


def bidiagonalised(x: Centred, steps: int, seed: int = 7):
    """V, alpha, beta: right vectors (columns) and the upper bidiagonal matrix that X is between them and left ones.

    Where the vectors reached are exhausted, a random right vector goes on, its beta 0. A vector that X takes to the
    span of the left ones before has alpha 0.
    """
    import numpy as np

    d, random = x.d, np.random.default_rng(seed)
    fresh = lambda to: (lambda v: v / np.linalg.norm(v))(_orthogonal(random.standard_normal(d), to))
    right, left, back = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # V, P with U = XP, X'U
    alpha, beta, scale = [], [], 0.0
    v, b, last = fresh(right), 0.0, np.zeros(d)
    for _ in range(steps):
        right = np.column_stack([right, v])
        p = v - b * last
        for again in (False, True):
            z, w, s = x.products(p, left)
            p, z = p - left @ w, z - back @ w
            if w @ w <= 1e-10 * s:  # else most of Xp was in the span and what is left needs a second look
                break
        a = np.sqrt(max(s - w @ w, 0.0))
        scale = max(scale, a)
        if a > 1e-13 * scale and a > 0:
            last = p / a
            left, back, alpha = np.column_stack([left, last]), np.column_stack([back, z / a]), [*alpha, a]
            v = _orthogonal(z / a - a * v, right)
            b = float(np.linalg.norm(v))
        else:
            alpha, last, b = [*alpha, 0.0], np.zeros(d), 0.0
        if right.shape[1] == d:
            break
        scale = max(scale, b)
        if b > 1e-13 * scale and b > 0:
            v = v / b
        else:
            v, b, last = fresh(right), 0.0, np.zeros(d)
        beta.append(b)
    return right, np.array(alpha), np.array(beta[: len(alpha) - 1])


def principal(x: Centred, components: int = 32, steps: int | None = None):
    """Eigenvalues (falling) and unit eigenvectors (columns) of the covariance, `components` at most, none of deviation 0."""
    import numpy as np

    v, alpha, beta = bidiagonalised(x, min(steps or x.d, x.d))
    _, s, r = np.linalg.svd(np.diag(alpha) + np.diag(beta, 1))
    keep = int((s[:components] > 1e-12 * s[0]).sum()) if s[0] > 0 else 0
    return s[:keep] ** 2, v @ r[:keep].T


def _deviations(x, whole, sums, n):
    """Per row the sum of (n * x - sums)^2, exact; None beyond a long."""
    import numpy as np

    rest = sums - n * whole  # below n
    y = x - whole
    if n * float(np.abs(y).max(initial=0) + 1) < 2**31 / max(1, x.shape[1]) ** 0.5:
        return ((n * y - rest) ** 2).sum(axis=1).tolist()
    out = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, rest, strict=True)) for row in y]
    return [v if v < 1 << 63 else None for v in out]


def whitened(table: DataFrame, components: int = 32, steps: int | None = None) -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1, falling), n, deviation, whitened, explained, identity_error.

    `steps` passes over the rows, by default as many as a vector has entries, which finds repeated eigenvalues as well.
    `table` has vec_id and embedding; other columns aren't read. Rows whose vector is null or holds null or non-finite
    entries are left out, and those that have not as many entries as most (of two such numbers the larger). Entries are
    cut to 2^40 / 64. Repeated rows and ids and null ids each count and give their rows. Components without deviation
    can't be whitened and are left out, so equal vectors and an empty table give no rows. `deviation` is null beyond a
    long.
    """
    import numpy as np

    spark = table.sparkSession
    rows = written(fixed_point(table), "vectors")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None or not sizes.d:
        return spark.createDataFrame([], OUT)
    d, n = sizes.d, sizes["count"]
    rows = rows.filter(F.size("x") == d)
    x = Centred(rows, d, n)
    e, v = principal(x, components, steps)
    k = len(e)
    if not k:
        return spark.createDataFrame([], OUT)
    centred, down, whole, sums, explained = x.centred(), v / np.sqrt(e), x.whole, x.sums, e / x.trace()

    def moments(m):
        w = centred(m) @ down
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    got = _summed(rows, d, moments)
    mean = got[k * k :] / n
    error = float(np.abs(got[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                m = _matrix(part, d)
                rows_, each = len(m), np.repeat(np.arange(len(m)), k)
                dev = pa.array(_deviations(m, whole, sums, n), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_)), pa.array(np.full(rows_ * k, n)), dev.take(pa.array(each)), pa.array((centred(m) @ down).ravel()), pa.array(np.tile(explained, rows_)), pa.array(np.full(rows_ * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, OUT)
