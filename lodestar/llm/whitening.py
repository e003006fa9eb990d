"""Whitening of vectors: principal directions from singular values of the centred rows, found without a covariance matrix.

Tasks reduce their centred rows to triangles by blockwise QR and triangles are merged sixteen at a time, so rows are
never squared and no task holds more than a few blocks. What is left, one triangle of the vectors' dimension, is brought
to bidiagonal form by Householder reflections; the differential qd algorithm with shifts finds its singular values, and
a twisted factorisation for each gives its direction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.int_vectors import EXACT_DOUBLE, matrix, usable, whole
from lodestar.llm.tables import Saved

COMPONENTS = 4
#: Rows reduced at once, and triangles that one task merges.
BLOCK, FAN_IN = 2048, 16
_EPS = float(np.finfo(float).eps)
_TINY = float(np.finfo(float).tiny)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of Q' r W, and W: Householder reflections from the left and right by turns."""
    a = np.array(r, float)
    d = a.shape[1]
    if len(a) < d:
        a = np.vstack([a, np.zeros((d - len(a), d))])
    w = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        v = x.copy()
        size = np.abs(x).max(initial=0.0)
        if not size or not np.abs(x[1:]).max(initial=0.0):
            return v, 0.0
        v /= size
        v[0] += math.copysign(math.sqrt(v @ v), v[0])
        return v, 2.0 / (v @ v)

    for k in range(d):
        v, beta = reflector(a[k:, k])
        if beta:
            a[k:, k:] -= np.outer(beta * v, v @ a[k:, k:])
        if k < d - 2:
            v, beta = reflector(a[k, k + 1 :])
            if beta:
                a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ v, beta * v)
                w[:, k + 1 :] -= np.outer(w[:, k + 1 :] @ v, beta * v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def _dqds(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """One step of the shifted differential qd transform; None if the shift was too large."""
    nq, ne = [], []
    q, e = q.tolist(), e.tolist()
    d = q[0] - shift
    for last, after in zip(e, q[1:], strict=True):
        if d < 0:
            return None
        nq.append(max(d + last, _TINY))
        t = after / nq[-1]
        ne.append(last * t)
        d = d * t - shift
    return None if d < 0 else (np.array([*nq, d]), np.array(ne))


def _least_bound(q: np.ndarray, e: np.ndarray) -> float:
    """A lower bound of the least eigenvalue: one over the trace of the inverse, whose recurrence only adds."""
    q = q.tolist()
    if min(q) <= 0:
        return 0.0
    total = column = 1.0 / q[0]
    for last, after in zip(e.tolist(), q[1:], strict=True):
        column = (1.0 + last * column) / after
        total += column
    return 1.0 / total if math.isfinite(total) else 0.0


def singular_values_squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of the bidiagonal matrix (a, b), falling, each to high relative accuracy.

    Shifts are lower bounds of the least eigenvalue, so steps hardly ever fail; a last or inner off-diagonal that is
    negligible beside its neighbours parts the problem.
    """
    found: list[float] = []
    todo = [(a * a, b * b, 0.0)]
    while todo:
        q, e, sigma = todo.pop()
        while len(q):
            small = np.flatnonzero(e <= _EPS * _EPS * (sigma + np.minimum(q[:-1], q[1:])))
            if len(small):
                at = int(small[-1])
                todo.append((q[: at + 1], e[:at], sigma))
                q, e = q[at + 1 :], e[at + 1 :]
                continue
            if len(q) == 1:
                found.append(sigma + q[0])
                break
            if q[-1] > q[0]:  # small values belong at the end
                q, e = q[::-1].copy(), e[::-1].copy()
            shift = _least_bound(q, e) * (1 - 16 * _EPS)
            step = _dqds(q, e, shift)
            if step is None:
                shift, step = 0.0, _dqds(q, e, 0.0)
            q, e = step
            sigma += shift
    return np.sort(np.array(found))[::-1]


def twisted_vector(a: np.ndarray, b: np.ndarray, value: float, rank: int = 0) -> np.ndarray:
    """The unit eigenvector of B'B, B the bidiagonal (a, b), for an eigenvalue, from L D L' - value and U D U' - value.

    The two meet where the twist is least; for an eigenvalue that repeats, `rank` takes the next least.
    """
    d, l, n = (a * a).tolist(), (b / a[:-1]).tolist(), len(a)
    guard = lambda x: x if abs(x) > _TINY else math.copysign(_TINY, x or 1.0)
    s, down = [-value], []
    for k in range(n - 1):
        down.append(d[k] * l[k] / guard(d[k] + s[k]))
        s.append(down[k] * l[k] * s[k] - value)
    p, up = [d[-1] - value], []
    for k in range(n - 2, -1, -1):
        t = d[k] / guard(d[k] * l[k] * l[k] + p[-1])
        up.append(l[k] * t)
        p.append(p[-1] * t - value)
    p, up = p[::-1], up[::-1]
    gamma = np.abs(np.array(s) + np.array(p) + value)
    at = int(np.argsort(gamma, kind="stable")[min(rank, n - 1)])
    z = [0.0] * n
    z[at] = 1.0
    for k in range(at - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(at + 1, n):
        z[k] = -up[k - 1] * z[k - 1]
    out = np.array(z)
    out /= np.abs(out).max()
    return out / math.sqrt(out @ out)


def directions(r: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of r'r, falling, and their unit vectors in columns: `components` of them, fewer if r has a lower rank.

    Vectors of values that nearly repeat are made orthogonal to those before. The largest entry of each is positive.
    """
    a, b, w = bidiagonal(r)
    top = float(max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0)))
    if not top:
        return np.empty(0), np.empty((r.shape[1], 0))
    # scaled to order one; what rounding can't tell from zero is parted, and a zero on the diagonal is the least number beside the largest
    signs = np.cumprod(np.concatenate([[1.0], np.where(a[:-1] * b < 0, -1.0, 1.0)]))  # with these, no entry is negative
    a, b = np.maximum(np.abs(a) / top, _EPS * _EPS), np.abs(b) / top
    b[b <= _EPS * _EPS] = 0.0
    values = singular_values_squared(a, b)
    values = values[: min(components, int((values > (max(r.shape) * _EPS) ** 2 * values[0]).sum()))]
    vectors = np.empty((len(a), len(values)))
    for k, value in enumerate(values):
        rank = sum(abs(other - value) <= 1e-12 * value for other in values[:k])
        z = twisted_vector(a, b, float(value), rank)
        for _ in range(2):
            z = z - vectors[:, :k] @ (vectors[:, :k].T @ z)
            z /= math.sqrt(z @ z)
        vectors[:, k] = z
    vectors = w @ (signs[:, None] * vectors)
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return values * top * top, vectors


@dataclass
class Whitening:
    """Sums and number of the fitted vectors, the variances and unit directions of the components, and the total variance."""

    n: int
    sums: list[int]
    variances: np.ndarray
    directions: np.ndarray
    total: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: whole parts first, exactly, so a large mean costs no digits."""
        return (x - np.array([s // self.n for s in self.sums], np.int64)).astype(np.float64) - np.array([s % self.n / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.directions / np.sqrt(self.variances))

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """For each row the sum over dimensions of (n x - S)^2, exactly; OverflowError beyond 63 bits."""
        widest = max((self.n * int(np.abs(x[:, k]).max()) + abs(s) for k, s in enumerate(self.sums)), default=0) if len(x) else 0
        if len(self.sums) * widest * widest < 1 << 63:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1)
        return np.array([sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()], np.int64)


def _triangles(model: Whitening):
    """Of all rows of a task one triangle, by QR of what there is and the next block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.empty((0, len(model.sums)))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                r = np.linalg.qr(np.vstack([r, model.centred(matrix(batch.column(0).slice(at, BLOCK)))]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()])], ["part", "r"])

    return run


def _merged(dim: int):
    def run(t: pa.Table) -> pa.Table:
        rows = t.sort_by("part")
        r = np.linalg.qr(np.vstack([np.frombuffer(x, np.float64).reshape(-1, dim) for x in rows.column("r").to_pylist()]), mode="r")
        return pa.table({"part": pa.array([rows.column("part")[0].as_py() // FAN_IN], pa.int64()), "r": pa.array([r.tobytes()])})

    return run


def fit(vectors: DataFrame, components: int = COMPONENTS, vector_col: str = "x") -> Whitening | None:
    """A whitening of the rows of vectors, arrays of longs of one length, none of them null; None if there are no rows.

    The driver sees sums by dimension and one triangle, whatever the number of rows.
    """
    saved = Saved(vectors.sparkSession)
    entries = vectors.select(F.posexplode(vector_col).alias("k", "c"))
    sums = entries.groupBy("k").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n"), F.max(F.abs("c")).alias("far")).orderBy("k").collect()
    if not sums:
        return None
    n = sums[0]["n"]
    if any(r["n"] != n for r in sums):
        raise ValueError("vectors aren't equally long")
    if max(r["far"] for r in sums) >= EXACT_DOUBLE:
        raise OverflowError("entries beyond 2**53 aren't exact")
    model = Whitening(n, [int(r["s"]) for r in sums], np.empty(0), np.empty((len(sums), 0)), 0.0)
    dim = len(sums)
    parts = saved.save(vectors.select(vector_col).mapInArrow(_triangles(model), "part long, r binary"))
    last = parts.agg(F.max("part")).first()[0]
    while last:
        parts = parts.groupBy(F.floor(F.col("part") / FAN_IN).alias("g")).applyInArrow(_merged(dim), "part long, r binary")
        last //= FAN_IN
    r = np.frombuffer(parts.first()["r"], np.float64).reshape(-1, dim)
    values, model.directions = directions(r, components)
    model.variances, model.total = values / n, float((r * r).sum()) / n
    return model


def identity_error(vectors: DataFrame, model: Whitening, vector_col: str = "x") -> float:
    """The largest absolute entry of the covariance of the whitened rows less the identity, taken over the rows themselves."""
    c = len(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = model.whitened(matrix(batch.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array(w[:, k].copy()) for k in range(c)], [f"w{k}" for k in range(c)])

    rows = vectors.select(vector_col).mapInArrow(run, ", ".join(f"w{k} double" for k in range(c)))
    # Spark's covariances are merged from centred moments
    found = rows.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i in range(c) for j in range(i + 1)]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i in range(c) for j in range(i + 1))


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each component of each row of vectors.

    A component of a vector, as a double, is 256 times itself rounded down. The fit is on distinct such vectors, each once, so copies
    have no weight. Rows whose vector is null or empty or holds a null or non-finite component are left out; a null id is carried along; rows
    that repeat an id are rows each; an empty table gives none. Components are those with a positive variance, so vectors that are all
    equal give none either. Vectors of unlike length raise ValueError, whole numbers beyond what is exact OverflowError.
    """
    spark = vectors.sparkSession
    saved = Saved(spark)
    rows = vectors.where(usable(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), whole(vector_col).alias("x"))
    distinct = saved.save(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"))
    model = fit(distinct, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.variances):
        return spark.createDataFrame([], schema)
    error = identity_error(distinct, model)
    saved.drop(distinct)
    c = len(model.variances)
    share = model.variances / model.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                m = len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(np.arange(m), c))),
                        pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * c, model.n, np.int64)),
                        pa.array(np.repeat(model.deviations(x), c)),
                        pa.array(model.whitened(x).ravel()),
                        pa.array(np.tile(share, m)),
                        pa.array(np.full(m * c, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
