import numpy as np
import pytest

from lodestar.llm.whitening import bidiagonal, directions, fit, identity_error, singular_values_squared, twisted_vector, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x string, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "c") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, components=4):
    """{(vec_id, component): values} from a covariance matrix, sums in whole numbers."""
    kept = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    if not kept:
        return []
    u = np.unique(np.array([x for _, x in kept]), axis=0)
    n, s = len(u), u.sum(axis=0)
    c = u - s / n
    e, w = np.linalg.eigh(c.T @ c / n)
    e, w = e[::-1], w[:, ::-1]
    m = min(components, int((e > 1e-9 * max(e[0], 1e-300)).sum()) if e[0] > 1e-12 else 0)
    out = []
    for i, x in kept:
        deviation = sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s, strict=True))
        out += [(i, k + 1, n, deviation, float((x - s / n) @ w[:, k] / np.sqrt(e[k])), float(e[k] / e.sum())) for k in range(m)]
    return out


def agree(got, rows, components=4):
    want = brute(rows, components)
    # equal (id, component) rows of repeated ids pair up by deviation
    got = sorted(got, key=lambda r: (r.component, r.vec_id is None, r.vec_id or 0, r.deviation))
    want = sorted(want, key=lambda r: (r[1], r[0] is None, r[0] or 0, r[3]))
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in got] == [r[:4] for r in want]
    for k in {r.component for r in got}:
        a = np.array([r.whitened for r in got if r.component == k])
        b = np.array([r[4] for r in want if r[1] == k])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7
    assert np.allclose([r.explained for r in got], [r[5] for r in want], rtol=1e-9)
    assert len({r.identity_error for r in got}) <= 1 and all(r.identity_error < 1e-9 for r in got)


@pytest.mark.parametrize("shape", [(9, 1), (40, 7), (5, 9), (300, 33)])
def test_solver_against_numpy(shape):
    rng = np.random.default_rng(shape[0])
    r = np.linalg.qr(rng.standard_normal(shape) * np.exp(rng.uniform(-6, 6, shape[1])), mode="r")
    a, b, w = bidiagonal(r)
    made = np.diag(a) + np.diag(b, 1)
    assert np.allclose(w.T @ w, np.eye(len(w)), atol=1e-13)
    assert np.allclose(w @ made.T @ made @ w.T, r.T @ r, rtol=0, atol=1e-11 * np.abs(r.T @ r).max())
    values, vectors = directions(r, 99)
    want = np.linalg.svd(r, compute_uv=False)
    assert np.allclose(np.sqrt(values), want[: len(values)], rtol=0, atol=1e-13 * want[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-10)
    assert np.abs(r.T @ (r @ vectors) - vectors * values).max() < 1e-11 * values[0]


def test_small_values_keep_their_digits():
    # a graded bidiagonal matrix: singular values over 24 orders of magnitude, known from higher precision
    a, b = np.array([10.0 ** -(3 * k) for k in range(9)]), np.array([10.0 ** -(3 * k + 2) for k in range(8)])
    from fractions import Fraction

    got = singular_values_squared(a, b)
    # the product of all squared values is that of the diagonal, exactly; the sum is the squared Frobenius norm
    exact = 1
    for x in a:
        exact *= Fraction(float(x)) ** 2
    product = 1
    for x in got:
        product *= Fraction(float(x))
    assert abs(product / exact - 1) < 1e-12
    assert np.isclose(got.sum(), (a**2).sum() + (b**2).sum(), rtol=1e-14)


def test_values_that_repeat_and_parts():
    assert np.allclose(singular_values_squared(np.ones(5), np.zeros(4)), 1)
    values, vectors = directions(np.eye(6) * 3, 6)
    assert np.allclose(values, 9) and np.allclose(vectors.T @ vectors, np.eye(6), atol=1e-12)
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((8, 8)))[0]
    values, vectors = directions(np.diag([5.0, 5, 5, 2, 2, 1, 1e-3, 0]) @ q, 8)
    assert np.allclose(np.sqrt(values), [5, 5, 5, 2, 2, 1, 1e-3], atol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(7), atol=1e-10)
    z = twisted_vector(np.array([3.0, 2.0]), np.array([1.0]), float(np.linalg.eigvalsh(np.array([[9.0, 3], [3, 5]]))[1]))
    assert np.allclose(np.array([[9.0, 3], [3, 5]]) @ z, np.linalg.eigvalsh(np.array([[9.0, 3], [3, 5]]))[1] * z)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.standard_normal(6) * [9, 7, 5, 3, 2, 1] / 8).tolist()) for k in range(150)]
    rows += [(500, rows[0][1])] * 60 + [(None, rows[1][1]), (3, rows[7][1])]  # copies weigh nothing
    odd = [(600, None), (601, []), (602, [1.0, None, 1, 1, 1, 1]), (603, [float("nan")] * 6), (604, [float("inf")] + [0.0] * 5)]
    agree(whiten(table(spark, rows + odd)).collect(), rows)


def test_whitening_of_odd_rows_in_floats(spark):
    rng = np.random.default_rng(6)
    rows = [(k, (rng.standard_normal(6) * [9, 7, 5, 3, 2, 1] / 8).tolist()) for k in range(150)]
    rows += [(500, rows[0][1])] * 60 + [(None, rows[1][1]), (3, rows[7][1])]  # copies weigh nothing
    odd = [(600, None), (601, []), (602, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (603, [float("nan")] * 6), (604, [float("inf")] + [0.0] * 5)]
    agree(whiten(table(spark, rows + odd)).collect(), rows)


def test_degenerate_tables(spark):
    assert whiten(table(spark, [(1, None)]).limit(0)).count() == 0
    assert whiten(table(spark, [(1, None)])).count() == 0
    assert whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # nothing varies
    line = [(k, [float(k), 2.0 * k, 0.0]) for k in range(9)]  # one direction alone
    agree(whiten(table(spark, line)).collect(), line)
    with pytest.raises(Exception, match="equally long"):
        whiten(table(spark, [(1, [1.0]), (2, [1.0, 2.0])])).collect()


def test_a_large_mean_costs_no_digits(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(-50, 50, (400, 5)) + 10**11
    model = fit(spark.createDataFrame([(r,) for r in x.tolist()], "x array<long>").repartition(5), 5)
    c = (x - 10**11) - (x - 10**11).mean(axis=0)
    assert np.allclose(model.variances, np.linalg.eigvalsh(c.T @ c / 400)[::-1], rtol=1e-12)
    assert identity_error(spark.createDataFrame([(r,) for r in x.tolist()], "x array<long>"), model) < 1e-10


def test_triangles_of_many_tasks_are_merged(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-90, 90, (600, 4))
    model = fit(spark.createDataFrame([(r,) for r in x.tolist()], "x array<long>").repartition(40), 4)
    c = x - x.mean(axis=0)
    assert np.allclose(model.variances, np.linalg.eigvalsh(c.T @ c / 600)[::-1], rtol=1e-12)


def test_query_against_a_covariance_matrix(spark, sample):
    from lodestar.llm import queries

    rows = [(r.vec_id, r.embedding) for r in queries.read(spark, sample, "embeddings").collect()]
    agree(queries.op11_whitening(spark, sample).collect(), rows)
