import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import hard_negatives as module
from lodestar.llm import queries
from lodestar.llm.hard_negatives import hard_negatives
from lodestar.llm.int_vectors import products, usable, whole


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2]]
    out = []
    for i, label, x in rows:
        if i % every:
            continue
        score = lambda y: sum(a * b for a, b in zip(x, y, strict=True))
        scored = sorted((-score(y), j, other) for j, other, y in rows)
        for below, p, _ in [s for s in scored if s[2] == label and s[1] != i][:positives]:
            window = [(j, -s) for s, j, other in scored if other != label and low * -below <= 100 * -s <= high * -below]
            out += [(i, p, k + 1, j, -below, s) for k, (j, s) in enumerate(window[:negatives])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", "s") for r in rows], "id long, label int, x array<long>, key string, scores string").repartition(4)


def found(spark, rows, every=50, **options):
    return sorted(map(tuple, hard_negatives(table(spark, rows), F.col("id") % every == 0, **options).collect()))


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_loops(spark, seed, monkeypatch):
    monkeypatch.setattr(module, "ROWS", 64)
    monkeypatch.setattr(module, "ANCHORS", 8)
    rng = np.random.default_rng(seed)
    # few values, so many ties, scores below zero, and limits that several positives share
    rows = [(k, int(rng.integers(0, 4)), rng.integers(-3, 4, 5).tolist()) for k in range(400)]
    want = brute(rows, 10)
    assert found(spark, rows, 10) == want and want
    assert found(spark, rows, 10, positives=2, negatives=7, low=20, high=100) == brute(rows, 10, 2, 7, 20, 100)


def test_a_third_of_the_rows_is_one_vector_of_one_label(spark, monkeypatch):
    monkeypatch.setattr(module, "ROWS", 128)
    rng = np.random.default_rng(9)
    rows = [(k, 1, [20, 20, 20]) if k % 3 == 0 else (k, int(rng.integers(0, 3)), rng.integers(10, 30, 3).tolist()) for k in range(900)]
    assert found(spark, rows, 30) == brute(rows, 30)


def test_odd_rows(spark):
    rows = [(0, 1, [5, 5]), (1, 1, [4, 4]), (2, 2, [3, 3]), (3, 2, [3, 3]), (4, None, [3, 3]), (5, 2, None), (None, 2, [3, 3]), (6, 2, []), (50, 7, [1, 1]), (100, 2, [-1, -1])]
    assert found(spark, rows) == brute(rows) == [(0, 1, 1, 2, 40, 30), (0, 1, 2, 3, 40, 30)]  # 50 has no positive, 100's score below zero
    assert found(spark, []) == [] and found(spark, [(1, 1, [1])]) == [] and found(spark, [(50, 1, [1])]) == []
    twice = [(0, 1, [5, 5]), (0, 1, [5, 5]), (1, 1, [4, 4]), (2, 2, [3, 3])]
    assert found(spark, twice) == brute(twice) == [(0, 1, 1, 2, 40, 30)] * 2
    with pytest.raises(Exception, match="components|equally long"):
        found(spark, [(0, 1, [1, 2]), (1, 1, [1])])


def test_products_are_exact():
    a = np.array([[2**24, 1], [2**25 - 1, 3]])
    assert products(a, a).tolist() == (a.astype(object) @ a.T.astype(object)).tolist()
    with pytest.raises(OverflowError):
        products(np.array([[2**40]]), np.array([[2**40]]))


def test_quantised_vectors(spark):
    rows = [(1, [0.1, -0.1]), (2, None), (3, []), (4, [None, 1.0]), (5, [float("nan")]), (6, [float("-inf")]), (7, [-0.0, 1 / 256])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {r.id: r.x for r in df.where(usable("v")).select("id", whole("v").alias("x")).collect()}
    assert got == {1: [25, -26], 7: [0, 1]}


def test_query_against_plain_loops_and_sql(spark, sample):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sample}/embeddings.parquet')")
    got = sorted(map(tuple, queries.op13_hard_negatives(spark, sample).collect()))
    assert got == sorted(con.execute(queries.OP13_SQL).fetchall())
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, np.floor(256 * np.array(r.embedding, np.float64)).astype(int).tolist()) for r in queries.read(spark, sample, "embeddings").collect()]
    assert got == brute(rows)
